"""Row positions, batches and the positional one-to-one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.columns import unused
from tessel.sources.shared import materialize


def with_ordinal(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Adds the 0-based position in the order of `order`.

    A range-partitioned sort is written once, then each partition's offset (one
    number for each partition, all that the driver sees) is added. No partition
    holds more than its range, unlike a window without partitions.
    """
    part, at, first = (unused([*df.columns, name], x) for x in ("__part", "__at", "__start"))
    placed = materialize(
        df.orderBy(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ordinal"
    )
    counts = placed.groupBy(part).count().orderBy(part).collect()
    offsets, total = {}, 0
    for row in counts:
        offsets[row[part]] = total
        total += row["count"]
    if not offsets:
        return placed.drop(part, at).withColumn(name, F.lit(0).cast("long"))
    start = df.sparkSession.createDataFrame(list(offsets.items()), f"{part} int, {first} long")
    within = F.col(at) - F.shiftleft(F.col(part).cast("long"), 33)
    # One row for each partition of a sort: bounded by the number of tasks.
    return placed.join(F.broadcast(start), part).withColumn(name, F.col(first) + within).drop(part, at, first)


def batch_id(row_idx: Column, size: int = 8) -> Column:
    return F.floor(row_idx / size).cast("long")


def positional_join(left: DataFrame, right: DataFrame, idx: str = "row_idx") -> DataFrame:
    """Joins rows of equal position; raises if a position of either side is missing or repeated on the other."""
    sides = [x.groupBy(idx).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "a"), (right, "b"))]
    alone = sides[0].join(sides[1], idx, "full_outer").where("coalesce(a, 0) <> 1 OR coalesce(b, 0) <> 1")
    if not alone.isEmpty():
        raise ValueError(f"{left.count()} rows cannot be aligned with {right.count()}: their positions differ or are repeated")
    return left.join(right, idx)
