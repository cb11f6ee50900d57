"""CSV source and sink of questions and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.align import with_ordinal
from tessel.sources.shared import materialize

BOM = "\ufeff"
QUESTIONS = "Question STRING"
SUBMISSION = "ID STRING, Answer STRING"


def read_csv(spark: SparkSession, path: str | list[str], schema: str, line_sep: str | None = None) -> DataFrame:
    """Reads cells with line breaks and doubled quotes; a leading byte order mark is consumed.

    `line_sep` should be the file's record separator where cells hold `\\r\\n`.
    """
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.csv(path)


def read_questions(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """Questions with their position: (row_idx, Question), 0 and up without gaps.

    Several files follow one another in the order of their paths. A file with
    multi-line cells is one partition, so ids grow in file order; the result is
    dealt out by position.
    """
    df = read_csv(spark, path, QUESTIONS, line_sep)
    placed = materialize(df.select("Question", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")), "questions")
    return with_ordinal(placed, "file", "at").select("row_idx", "Question")


def _write(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_questions(df: DataFrame, path: str, order: str) -> None:
    """One file of the column Question, in the order of `order`."""
    _write(df.orderBy(order).select("Question").coalesce(1), path)


def write_submission(df: DataFrame, path: str, order: str) -> None:
    """One UTF-8 file with a byte order mark, in the order of `order`, which is not written."""
    first, *rest = [c for c in df.columns if c != order]
    _write(df.orderBy(order).select(F.col(first).alias(BOM + first), *rest).coalesce(1), path)
