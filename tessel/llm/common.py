"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.columns import let, unused  # noqa: F401
from tessel.sources.shared import materialize, new_path, remove  # noqa: F401

#: Bytes that are broadcast at most, as `small` counts them.
BROADCAST_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, row_bytes: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its rows come to at most `limit` bytes, else as it is (a shuffled join).

    `row_bytes`: the bytes of a row, 16 where it is absent (one or two ids), besides 32 for its place in a
    hash table. `df` should be materialised: it is read for this sum.
    """
    total = df.agg(F.sum((F.lit(16) if row_bytes is None else row_bytes).cast("long") + 32)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def words(text: str | None) -> list[bytes]:
    """Words of the whole text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: each bit of the input moves each bit of the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _STEP
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words.

    A text of fewer words is one run; without words the result is empty.
    """
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(width, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, k, np.uint64)
        for i in range(k):
            acc = (acc ^ (acc >> np.uint64(31))) * _STEP + h[i : i + n]
    return np.unique(mixed(acc))


def batches(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of record batches, so that long texts do not pile up in Python."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
