"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize, remove


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): neighbours are tied to the smallest of them.

    The large star moves larger neighbours, the small star the node itself and
    its smaller ones. The minimum is a partial aggregate, so a centre with very
    many neighbours is no more than one row for each task that holds it.
    """
    if large:
        sides = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of `edges` (a, b); component is the smallest id reachable.

    Alternates large and small stars until nothing changes; each round is
    written to the shared folder, so a lost executor costs one round at most.
    Nulls and loops are ignored. An empty table gives an empty one.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        nxt = materialize(_stars(_stars(now, True), False), "edges")
        row = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(now)
        now = nxt
        if (row[0], row[1]) == state or not row[0]:
            break
        state = (row[0], row[1])
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
