"""Substring deduplication over sliding runs of sentences.

A text is cut into sentences, a sentence of more than LONG words into pieces. A
piece begins at a word whose hash is the least among its NEAR neighbours on either
side, so that the same passage is cut alike whatever stands before it; where no
such word comes within LONG words (in repetitive text), at the word of least hash
in reach. Every run of RUN consecutive sentences is hashed; the hashes are joined
over all documents; sentences covered by a run that is not the first of its kind
are removed. A text of fewer than RUN sentences has no run and stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import batches, materialize, mixed

RUN, LONG, NEAR = 3, 16, 3
_END = re.compile(r"(?<=[.!?\u061f\u06d4\u0964])\s+|(?<=[\u3002\uff01\uff0e\uff1f\uff61])\s*|\n+")
#: Scripts that put no spaces between words: each character counts as a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_DENSE}]|[^\s{_DENSE}]+")
_SPACED = re.compile(r"\S+")
_HAS_DENSE = re.compile(f"[{_DENSE}]")


def _starts(ws: list[str]) -> list[int]:
    """Numbers of the words at which the pieces of a long sentence begin."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = len(h) - 2 * NEAR
    mid = h[NEAR : NEAR + n]
    # Of equal words the first counts: less than those before, not more than those after.
    least = np.logical_and.reduce([mid < h[i : i + n] for i in range(NEAR)] + [mid <= h[i : i + n] for i in range(NEAR + 1, 2 * NEAR + 1)])
    out = [0]
    for stop in [*(np.flatnonzero(least) + NEAR).tolist(), len(h)]:
        while stop - out[-1] > LONG:
            at = out[-1] + NEAR + 1
            out.append(at + int(np.argmin(h[at : min(out[-1] + LONG, stop - NEAR - 1) + 1])))
        out.append(stop)
    return out[:-1]


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised text, words) of each sentence or piece, in order."""
    out, at = [], 0
    dense = not text.isascii() and _HAS_DENSE.search(text)
    cuts = [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]
    for stop, nxt in cuts:
        part = text[at:stop]
        ws = _WORD.findall(part.lower()) if dense else part.lower().split()
        if 0 < len(ws) <= LONG:
            out.append((stop - len(part.lstrip()), at + len(part.rstrip()), " ".join(ws), len(ws)))
        elif ws:
            found = list((_WORD if dense else _SPACED).finditer(text, at, stop))
            ws = [w.group().lower() for w in found]
            starts = _starts(ws)
            for i, j in zip(starts, [*starts[1:], len(ws)], strict=True):
                out.append((found[i].start(), found[j - 1].end(), " ".join(ws[i:j]), j - i))
        at = nxt
    return out


def _hashes(text: str | None) -> np.ndarray:
    """Hash of the run that begins at each sentence, as far as there is one."""
    s = sentences(text or "")
    n = len(s) - RUN + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x[2]) for x in s), np.uint64, len(s))
    acc = h[:n]
    for i in range(1, RUN):
        acc = mixed(acc) + h[i : i + n]
    return mixed(acc).view(np.int64)


def runs(text: str | None) -> list[tuple[int, int]]:
    """(hash, number of the first sentence) of each run, however few words it has."""
    return [(h, i) for i, h in enumerate(_hashes(text).tolist())]


def without(text: str, firsts: list[int]) -> tuple[str, int]:
    """The text without the sentences of the runs that begin at `firsts`, and their number.

    What stays keeps its own white space; a removed stretch leaves one line feed
    between its neighbours.
    """
    s = sentences(text)
    gone = sorted({k for i in firsts for k in range(i, min(i + RUN, len(s)))})
    out, at, k = [], 0, 0
    while k < len(gone):
        j = k
        while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
            j += 1
        out.append(text[at : s[gone[k]][0]].rstrip())
        at, k = s[gone[j]][1], j + 1
    out.append(text[at:].lstrip() if out else text)
    return "\n".join(x for x in out if x), len(gone)


def _emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        found = [_hashes(t) for t in b.column(2).to_pylist()]
        counts = [len(h) for h in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64()),
                pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts), pa.int64()),
                pa.array(np.repeat(b.column(1).to_numpy(zero_copy_only=False), counts), pa.int64()),
                pa.array(np.concatenate([np.empty(0, np.int32), *(np.arange(n, dtype=np.int32) for n in counts)]), pa.int32()),
            ],
            names=["h", "doc_id", "key", "at"],
        )


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        rows = [without(t, f) for t, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), b.column(4)],
            names=["doc_id", "key", "text", "n_removed", "first_doc_ids"],
        )


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text); key is the text's hash, so that an id with several texts is as many documents."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, first_doc_id): each run (number of its first sentence) that occurs earlier,
    and the document of its first occurrence.

    Occurrences are ordered by doc_id, key and position; only the least is kept for
    each hash before anything is joined, so a frequent run is one row for each
    task, and a join that Spark may split. The runs are written once and read twice.
    """
    read = _read(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    spans = materialize(read.mapInArrow(_emit, "h long, doc_id long, key long, at int"), "spans")
    first = spans.groupBy("h").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spans.join(first.select("h", "first"), "h").where(
        F.struct("doc_id", "key", "at") != F.col("first")
    ).select("doc_id", "key", "at", F.col("first.doc_id").alias("first_doc_id"))


def _changed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, n_removed, first_doc_ids) of the texts that lose sentences."""
    spans = repeated_spans(docs)
    per_doc = spans.groupBy("doc_id", "key").agg(F.collect_set("at").alias("at"), F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    return _read(docs).join(per_doc, ["doc_id", "key"]).select("doc_id", "key", "text", "at", "first_doc_ids").mapInArrow(
        _cut, "doc_id long, key long, text string, n_removed long, first_doc_ids array<long>"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed, first_doc_ids) of the documents that lose sentences.

    n_removed: sentences (or pieces of long ones) taken out; first_doc_ids: where
    they stay. Documents without repeats, null and empty texts and rows without
    doc_id are not returned. Rows that repeat a doc_id with the same text are one
    document, and are returned as often; with different texts they are several.
    Other columns are not read.
    """
    return _changed(docs).drop("key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all rows, repeats removed; a text of repeats only becomes empty.

    Repeated rows, null texts and rows without doc_id stay.
    """
    new = _changed(docs).select("doc_id", "key", F.col("text").alias("new")).dropDuplicates(["doc_id", "key"])
    return _read(docs).join(new, ["doc_id", "key"], "left").select("doc_id", F.coalesce("new", "text").alias("text"))
