"""Helpers for building Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once for each row, also where lambdas in `body` use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(columns: Iterable[str], name: str) -> str:
    """`name`, made longer until no column is called so (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
