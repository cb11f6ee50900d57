"""The answering flow over a stream; it keeps no state, so the batch plan serves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tessel.plans.answering import answer


def answer_stream(stream: DataFrame, text: str, generate: Callable[[Column], Column], **options) -> DataFrame:
    return answer(stream, text, generate, **options)


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what the source holds now, writes Parquet exactly once, and reads it back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
