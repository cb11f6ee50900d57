"""Classify a question and split it into stem and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import textops as X
from tessel.functions.columns import unused


def option_count(text: Column) -> Column:
    """Option lines of a text, counted without lambdas so that it stays in generated code."""
    return F.regexp_count(F.concat(F.lit("\n"), X.strip(text)), F.lit(X.OPTION_AFTER_LINE_FEED))


def is_multiple_choice(text: Column) -> Column:
    return option_count(text) >= 2


def options_of(lines: Column) -> Column:
    return F.transform(F.filter(lines, X.is_option_line), X.strip)


def stem_of(lines: Column) -> Column:
    """The other lines, each stripped, joined by one space; empty ones stay."""
    return F.array_join(F.transform(F.filter(lines, lambda x: ~X.is_option_line(x)), X.strip), " ")


def options(text: Column) -> Column:
    return options_of(X.lines(text))


def stem(text: Column) -> Column:
    return stem_of(X.lines(text))


def with_question(df: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """Adds n_options, is_mc, question and options, each computed once.

    A null text raises when `strict`; otherwise the four columns are null.
    """
    source = F.col(text)
    if strict:
        source = F.when(source.isNotNull(), source).otherwise(F.raise_error(F.lit("a question is null")).cast("string"))
    asked, lines = unused(df.columns, "__asked"), unused(df.columns, "__lines")
    split = df.withColumn(asked, source).withColumn(lines, X.lines(F.col(asked)))
    return split.withColumns(
        {
            "n_options": option_count(F.col(asked)).cast("long"),
            "question": stem_of(F.col(lines)),
            "options": options_of(F.col(lines)),
        }
    ).withColumn("is_mc", F.col("n_options") >= 2).drop(asked, lines)


def option_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line: (key, line_no, line, is_option)."""
    return df.select(key, F.posexplode(X.lines(F.col(text))).alias("line_no", "line")).withColumn(
        "is_option", X.is_option_line(F.col("line"))
    )
