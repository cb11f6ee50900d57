"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by the power of two of their number of shingles. An item of n
shingles is indexed under its least shingle hashes (a bottom-k MinHash sketch): one
more than it may lack, KEEP at most. A document that contains enough of an item has
one of them, by the pigeonhole principle for small items, and else but for a
probability of 0.2 ** KEEP. A document, however long, is looked up by its own shingle
hashes: by those up to the largest minimum of the partitions whose items are not too
large for it. What is met is verified by the exact share of the item's shingles, as
strings, that the document has. An item of fewer words than a shingle is one run of
its own width.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import let, materialize, small

#: Minima of an item at most: a pair at the least containment of 0.8 is missed with a probability of 1e-7.
KEEP = 10


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for null, empty and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")


def _runs(w: Column, make: Callable[[Column, Column], Column], width: int, kind: str) -> Column:
    """make(items, start) for each run of `width` items of array `w`."""
    none = F.array().cast(f"array<{kind}>")
    last = F.size(w) - width
    return F.when(last >= 0, let(w, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - width), lambda i: make(x, i)))).otherwise(none)


def hashes(w: Column, width: int) -> Column:
    """A hash of each run of `width` words."""
    return _runs(F.transform(w, lambda x: F.xxhash64(x)), lambda h, i: F.xxhash64(*(F.get(h, i + k) for k in range(width))), width, "bigint")


def texts(w: Column, width: int) -> Column:
    """Distinct runs of `width` words as strings."""
    return F.array_distinct(_runs(w, lambda x, i: F.concat_ws(" ", F.slice(x, i + 1, width)), width, "string"))


def sketches(items: DataFrame, percent: int, width: int) -> DataFrame:
    """(item_id, width, own, n_item, part, minima) of the items that have words.

    own: distinct runs as strings; part: the power of two of their number, or minus the
    width of an item of fewer than `width` words, which is one run.
    """
    split = items.select("item_id", words(F.col("text")).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    short = lambda make, kind: F.coalesce(*(F.when(F.size("w") == v, make(F.col("w"), v)) for v in range(1, width)), F.array().cast(f"array<{kind}>")) if width > 1 else F.array().cast(f"array<{kind}>")
    of = lambda make, kind: F.when(F.size("w") < width, short(make, kind)).otherwise(make(F.col("w"), width))
    known = split.select("item_id", F.least(F.size("w"), F.lit(width)).alias("width"), of(texts, "string").alias("own"), F.array_sort(F.array_distinct(of(hashes, "bigint"))).alias("h"))
    n = F.size("own")
    keep = F.least(F.lit(KEEP), (F.floor(n * (100 - percent) / 100) + 1).cast("int"))
    part = F.when(F.col("width") < width, -F.col("width")).otherwise(F.floor(F.log2(n)).cast("int"))
    return known.select("item_id", "width", "own", n.alias("n_item"), part.alias("part"), F.slice("h", F.lit(1), keep).alias("minima"))


def _contained(docs: DataFrame, items: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, key, item_id, n_item, n_shared); key is the hash of the document's text."""
    known = materialize(sketches(items, percent, width), "items")
    # One row for each power of two and each width below `width`: fewer than 70.
    parts = known.groupBy("part").agg(F.max(F.array_max("minima")).alias("top"), F.min("n_item").alias("least")).collect()
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).where("doc_id IS NOT NULL")
    if not parts:
        none = F.lit(None).cast("long")
        return known.select(none.alias("doc_id"), none.alias("key"), "item_id", F.col("n_item").cast("long").alias("n_item"), none.alias("n_shared")).where("false")
    index = materialize(known.select("item_id", F.explode("minima").alias("h")), "index")
    n = F.size("w") - (width - 1)
    reach = [F.when(n * 100 >= p.least * percent, F.lit(p.top)) for p in parts if p.part >= 0]
    shorter = sorted(-p.part for p in parts if p.part < 0)
    tops = {-p.part: p.top for p in parts if p.part < 0}
    up_to = lambda h, top: F.filter(h, lambda x: x <= top)
    none = F.array().cast("array<bigint>")
    asked = [F.coalesce(let(F.greatest(*reach, F.lit(None).cast("long")), lambda top: up_to(hashes(F.col("w"), width), top)), none)] if reach else []
    asked += [up_to(hashes(F.col("w"), v), F.lit(tops[v])) for v in shorter]
    probed = read.select("doc_id", "key", words(F.col("text")).alias("w")).select("doc_id", "key", F.explode(F.concat(*asked)).alias("h"))
    found = materialize(probed.join(small(index), "h").select("doc_id", "key", "item_id").distinct(), "found")
    weight = F.length(F.concat_ws("", "own")) * 2 + F.size("own") * 32
    pairs = found.join(small(known.select("item_id", "n_item", "own"), weight), "item_id")
    ids = materialize(found.select("doc_id", "key").distinct(), "ids")
    runs = F.array_distinct(F.concat(*(texts(F.col("w"), v) for v in [*shorter, width])))
    there = read.join(small(ids), ["doc_id", "key"], "left_semi").select("doc_id", "key", words(F.col("text")).alias("w")).select("doc_id", "key", runs.alias("has"))
    exact = pairs.join(there, ["doc_id", "key"]).select(
        "doc_id", "key", "item_id", F.col("n_item").cast("long").alias("n_item"), F.size(F.array_intersect("own", "has")).cast("long").alias("n_shared")
    )
    return exact.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each pair with 100 * n_shared >= percent * n_item.

    n_item: distinct shingles of the item; n_shared: those that the document
    has. An item of fewer than `width` words is one run of all its words, which a document has or not. Items
    without words, null texts and rows without an id match nothing. Of rows that repeat an id the largest
    n_shared counts. Other columns of `docs` (doc_id, text) and `items` (item_id, text) are not read.
    """
    best = _contained(docs, items, percent, width).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """`docs` without the rows whose text contains an item; all columns stay.

    Of rows that repeat a doc_id with different texts each is judged by its own text; null texts and rows without an id stay.
    """
    gone = materialize(_contained(docs, items, percent, width).select("doc_id", "key").distinct(), "contaminated")
    same = (F.col("doc_id").cast("long") == F.col("__found.__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__found.__key"))
    return docs.alias("__docs").join(small(gone.toDF("__id", "__key")).alias("__found"), same, "left_anti").select(docs.columns)


def sql(percent: int = 80, width: int = 5) -> str:
    """The same in DuckDB's SQL, by counting all shared shingles."""
    split = "SELECT {id}, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM {table}"
    runs = lambda i, m, table: f"SELECT DISTINCT {i}, array_to_string(w[i:i + {m} - 1], ' ') AS s FROM (SELECT {i}, w, unnest(range(1, len(w) - {m} + 2)) AS i FROM {table})"
    lesser = " UNION ".join(f"SELECT doc_id, s FROM ({runs('doc_id', v, 'dw')}) WHERE EXISTS (SELECT 1 FROM bw WHERE len(w) = {v})" for v in range(1, width))
    return (
        f"WITH bw AS ({split.format(id='item_id', table='benchmark')}), dw AS ({split.format(id='doc_id', table='documents')}), "
        f"q AS ({runs('item_id', width, 'bw')} UNION SELECT item_id, array_to_string(w, ' ') FROM bw WHERE len(w) BETWEEN 1 AND {width - 1}), "
        f"d AS ({runs('doc_id', width, 'dw')} UNION {lesser}), n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id), "
        "p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (s) GROUP BY doc_id, item_id) "
        f"SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM p JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * {percent}"
    )
