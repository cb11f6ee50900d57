"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

Codes are split into m segments; each is an index. Step t looks up all values
of segment t % m that differ from the query's own in t // m bits. A code at
distance t or less has a segment s at distance (t - s) // m or less, so after step t
every code within distance t was met. A query ends when its k-th verified distance
is t or less; the others go on. Once a query has k, the join itself verifies
distances and passes on only codes that are no farther than its k-th so far.
Equal codes are one entry with their k least ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import materialize, remove

#: Least and most segments.
SEGMENTS = (2, 16)
#: An index entry holds about 2**FULL codes: to compare a code costs less than to make and look up a key.
FULL = 2
#: Masks of the first steps together, which no bound cuts yet, and of later ones.
MASKS = (128, 512)
#: Masks that are broadcast at most (16 bytes each).
BROADCAST_MASKS = 1_000_000


def segments(codes: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment: about log2 of the codes less `FULL` bits, so that an index entry holds about 2**FULL."""
    n = min(max(round(64 / max(math.log2(max(codes, 2)) - FULL, 1)), SEGMENTS[0]), SEGMENTS[1])
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def steps(cut: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of successive steps: (last step, its masks as (segment, radius)); after the last all codes were met."""
    out, now, n = [], [], 0
    for t in range(65):
        radius, seg = divmod(t, len(cut))
        size = math.comb(cut[seg][1], radius)
        if now and n + size > MASKS[bool(out)]:
            out.append((t - 1, now))
            now, n = [], 0
        now, n = [*now, (seg, radius)], n + size
    return [*out, (64, now)]


def code(vector: Column, dims: int = 64) -> Column:
    """Signs of the first `dims` (64 at most) elements as bits; a missing or null element counts as not positive."""
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(dims)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _masks(spark, cut: list[tuple[int, int]], group: list[tuple[int, int]]) -> DataFrame:
    """(seg, mask): all masks of the group's radii, made where they are used: bit after bit, each above the last."""
    out = None
    for seg, radius in group:
        bits = cut[seg][1]
        masks = spark.range(1).select(F.lit(seg).alias("seg"), F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("last"))
        for left in range(radius, 0, -1):
            here = F.explode(F.sequence(F.col("last") + 1, F.lit(bits - left)))
            masks = masks.select("seg", "mask", here.alias("last")).select("seg", F.expr("mask | shiftleft(1L, last)").alias("mask"), "last")
        masks = masks.select("seg", "mask")
        out = masks if out is None else out.union(masks)
    few = sum(math.comb(cut[seg][1], radius) for seg, radius in group) <= BROADCAST_MASKS
    return F.broadcast(out) if few else out


def _segments(c: str, cut: list[tuple[int, int]]) -> Column:
    part = lambda s, at, bits: F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << bits) - 1)).alias("val"))
    return F.explode(F.array(*(part(s, *x) for s, x in enumerate(cut))))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest of `rows` (id, code) for each of `queries` (query_id, code).

    Ties are broken by id; a query that is among `rows` finds itself. Fewer than k rows give all of them. Null ids
    and codes do not take part; repeated (id, code) rows are one; an id with
    several codes counts with each. Other columns are not read.
    """
    spark = rows.sparkSession
    nearest = Window.partitionBy("code").orderBy("id")
    entries = (
        rows.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).dropna().distinct()
        .withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    entries = materialize(entries, "codes")
    total, distinct = entries.agg(F.sum(F.size("ids")), F.count(F.lit(1))).first()
    cut, want = segments(distinct), min(k, total or 0)
    index = materialize(entries.select("ids", "code", _segments("code", cut).alias("s")).select("s.seg", "s.val", "code", "ids"), "index")
    asked = queries.select("query_id", F.col("code").cast("long").alias("q")).dropna().distinct()
    # q and the distance beyond which a code is of no use.
    todo, best, results = materialize(asked.select("q", F.lit(64).alias("reach")).distinct(), "todo"), None, []
    w = Window.partitionBy("q").orderBy("distance", "id")
    for last, group in steps(cut) if want else ():
        masks = _masks(spark, cut, group)
        probe = todo.select("q", "reach", _segments("q", cut).alias("s")).select("q", "reach", "s.*").join(masks, "seg").select("q", "reach", "seg", F.col("val").bitwiseXOR(F.col("mask")).alias("val"))
        here = index.where(F.col("seg").isin(sorted({s for s, _ in group})))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = probe.alias("p").join(here.alias("i"), (F.col("p.seg") == F.col("i.seg")) & (F.col("p.val") == F.col("i.val")) & (distance <= F.col("reach")))
        found = met.select("q", "code", "ids", distance.alias("distance")).dropDuplicates(["q", "code"])
        # Only what can still be among the k: codes, each standing for its k least ids.
        near = found.withColumn("place", F.rank().over(Window.partitionBy("q").orderBy("distance"))).where(F.col("place") <= k)
        ids = near.select("q", "distance", F.explode("ids").alias("id"))
        if best is not None:
            ids = ids.union(best.join(todo, "q", "left_semi").select("q", "distance", "id")).distinct()
        best = materialize(ids.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
        state = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where(F.col("n") >= want)
        sure = state.where(F.col("far") <= last)
        results.append(best.join(sure, "q", "left_semi").select("q", "id", "distance", "rank"))
        left = todo.join(state, "q", "left").where(F.col("far").isNull() | (F.col("far") > last))
        left = materialize(left.select("q", F.coalesce("far", "reach").cast("int").alias("reach")), "todo")
        remove(todo)
        todo = left
        if todo.isEmpty():
            break
    out = results[0] if results else spark.createDataFrame([], "q long, id long, distance int, rank int")
    for r in results[1:]:
        out = out.union(r)
    return asked.join(out, "q").select("query_id", "id", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


def sql(k: int = 10) -> str:
    """Brute force in DuckDB's SQL over `embeddings`: queries are the ids divisible by 100."""
    bits = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))
    return (
        f"WITH c AS (SELECT vec_id, {bits} AS code FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, bit_count(xor(a.code, b.code))::BIGINT AS distance "
        "FROM c a JOIN c b ON a.vec_id % 100 = 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) "
        f"SELECT query_id, id, distance, rank FROM r WHERE rank <= {k}"
    )
