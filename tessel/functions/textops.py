"""String primitives as Column expressions; all stay inside the JVM.

`(?U)` together with `\\x1c-\\x1f` makes Java's white space equal to the 29
Unicode white space characters; Java's default has six of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WHITE_SPACE = r"[\s\x1c-\x1f]"
WHITE_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
OPTION_LINE = rf"(?U)^{WHITE_SPACE}*[1-9][0-9]?{WHITE_SPACE}"
OPTION_AFTER_LINE_FEED = r"(?U)\n[\s\x1c-\x1f&&[^\n]]*[1-9][0-9]?[\s\x1c-\x1f&&[^\n]]"
LEADING_NUMBER = r"(?U)^\D*([1-9][0-9]?)"


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACES))


def lines(c: Column) -> Column:
    """Lines of the stripped text; trailing empty lines do not occur."""
    return F.split(strip(c), "\n", -1)


def is_option_line(line: Column) -> Column:
    """White space, a number from 1 to 99, white space; `1.` and `1)` do not count."""
    return line.rlike(OPTION_LINE)


def after_last(c: Column, marker: str) -> Column:
    """What follows the last `marker`; the whole text without one."""
    return F.substring_index(c, marker, -1)


def without_prefix(c: Column, prefix: Column) -> Column:
    return F.when(F.startswith(c, prefix), F.substr(c, F.length(prefix) + F.lit(1))).otherwise(c)


def preview(c: Column, n: int = 100) -> Column:
    return F.substring(c, 1, n)
