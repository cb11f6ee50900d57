"""Toxicity scores from averaged subword embeddings and a linear softmax.

A text is lower-cased and cut into words; every character n-gram of three to six
bytes within a word and its two borders has a hashed embedding. Passages of
PASSAGE words are averaged and classified by a linear softmax; a text is as toxic
as its most toxic passage, so one insult in a very long text counts as much as
in a short one. Embeddings and softmax are trained jointly in numpy (Adagrad);
misspellings that were never seen share most n-grams with what was. For scoring
the product of embeddings and softmax is one number for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize, remove

SIZES = (3, 4, 5, 6)
BITS, DIM, PASSAGE = 18, 8, 32
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_KEEP = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789@$":
    _KEEP[_c] = _c
_KEEP[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Bounds:
    """The fit reads at most `rows` labelled rows of each class and `chars` characters in all."""

    rows: int = 2500
    chars: int = 16_000_000


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # a number for each n-gram bucket
    bias: float


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket of each n-gram, its passage, number of passages) of the whole text."""
    a = _KEEP[np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)]
    a = np.concatenate(([0], a, [0])).astype(np.uint8)
    gap = a == 0
    a = a[~(gap & np.concatenate(([False], gap[:-1])))]  # one border between words
    gap = a == 0
    n_words = int(gap.sum()) - 1
    if n_words <= 0:
        return np.empty(0, np.int32), np.empty(0, np.int32), 1
    passage = ((np.cumsum(gap) - 1) // PASSAGE).astype(np.int32)
    inner = np.concatenate(([0], np.cumsum(gap)))
    ids, where = [], []
    h = a.astype(np.uint64)
    code = h[: len(a) - 1] | (h[1:] << np.uint64(8))
    with np.errstate(over="ignore"):
        for k, size in enumerate(SIZES):
            m = len(a) - size + 1
            if m <= 0:
                break
            code = code[:m] | (h[size - 1 :] << np.uint64(8 * (size - 1)))
            ok = np.flatnonzero(inner[size - 1 : size - 1 + m] == inner[1 : 1 + m])
            ids.append((code[ok] * _MUL[k] >> np.uint64(64 - BITS)).astype(np.int32))
            where.append(passage[ok])
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.int32), 1
    return np.concatenate(ids), np.concatenate(where), (n_words - 1) // PASSAGE + 1


def _softplus_grad(z: float | np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def logit(model: Model, text: str | None) -> float:
    ids, where, n = grams(text)
    if not len(ids):
        return model.bias
    total = np.bincount(where, model.weight[ids], n)
    return model.bias + float((total / np.maximum(np.bincount(where, minlength=n), 1)).max())


def fit(texts: list[str], toxic: list[int], prior: float | None = None, epochs: int = 15, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax. `prior`: the share of toxic texts to expect, else as given.

    Without a text of either class the model is a constant.
    """
    y = np.array(toxic, np.float64)
    share = y.mean() if len(y) else 0.0
    prior = share if prior is None else prior
    if not 0 < share < 1:
        return Model(np.zeros(1 << BITS, np.float32), 10.0 if share == 1 else -10.0)
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    e2, s2, b2 = np.full(1 << BITS, 1e-4, np.float32), np.full_like(softmax, 1e-2), np.full(2, 1e-2)
    feats = []
    for t in texts:
        ids, where, n = grams(t)
        order = np.argsort(where, kind="stable")  # so that a passage is a slice
        feats.append((ids[order], np.concatenate(([0], np.cumsum(np.bincount(where, minlength=n)))) if len(ids) else None))
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        order = rng.permutation(len(feats))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            w = (embedding @ (softmax[:, 1] - softmax[:, 0]).astype(np.float32)).astype(np.float32)
            picked, g = [], []
            for k in part:
                ids, cut = feats[k]
                if not len(ids):
                    continue
                means = np.add.reduceat(w[ids], cut[:-1]) / (cut[1:] - cut[:-1])
                best = int(means.argmax())
                p = _softplus_grad(means[best] + bias[1] - bias[0])
                picked.append(ids[cut[best] : cut[best + 1]])
                g.append(p - y[k])
            if not picked:
                continue
            g = np.array(g)
            sizes = np.array([len(x) for x in picked])
            rows = np.repeat(np.arange(len(picked)), sizes)
            flat = np.concatenate(picked)
            means = np.add.reduceat(embedding[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
            diff = softmax[:, 1] - softmax[:, 0]
            two = np.stack([-g, g], 1)
            grad_s, grad_b = means.T @ two / len(g), two.mean(0)
            # Embedding rows: the sum over their n-grams of g / size, times the direction.
            uniq, inv = np.unique(flat, return_inverse=True)
            amount = np.bincount(inv, (g / sizes)[rows], len(uniq))
            step = amount[:, None] * diff[None, :]
            e2[uniq] += (step**2).mean(1).astype(np.float32)
            embedding[uniq] -= (0.5 * rate * step / np.sqrt(e2[uniq])[:, None]).astype(np.float32)
            s2 += grad_s**2
            b2 += grad_b**2
            softmax -= 0.1 * rate * grad_s / np.sqrt(s2)
            bias -= 0.1 * rate * grad_b / np.sqrt(b2)
    odds = lambda p: np.log(p / (1 - p))
    shift = odds(np.clip(prior, 1e-3, 1 - 1e-3)) - odds(share)
    return Model((embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; those without an id are among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fits on the labelled rows of `labels` (doc_id, toxic) that are not held out.

    The sample is bounded: of each class the `bounds.rows` rows of least hash,
    and `bounds.chars` characters; texts enter whole. The driver first sees the
    lengths and then fetches only the texts within the bound. Null labels are
    skipped; an id with several labels counts as toxic if one is, and one with
    several rows enters with the shortest text.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return fit([], [])
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bounds.rows) for c in (0, 1)]
    # At most two times bounds.rows ids.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = materialize(sample.join(F.broadcast(picked[0].union(picked[1])), "doc_id").withColumn("n", F.length("text")), "sample")
    order = lambda r: hash((r.doc_id * 0x9E3779B97F4A7C15) % 2**61)
    chosen, left = [], bounds.chars
    for r in sorted(sample.groupBy("doc_id").agg(F.min("n").alias("n")).collect(), key=order):
        if left >= r.n:
            left -= r.n
            chosen.append((r.doc_id, r.n))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, n int"))
    rows = sorted(sample.join(wanted, ["doc_id", "n"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect(), key=order)
    remove(sample)
    texts, toxic = [r.text for r in rows], [r.toxic for r in rows]
    return fit(texts, toxic, counts.get(1, 0) / sum(counts.values()))


def scorer(df: DataFrame, model: Model):
    """A Column function: probability that a text is toxic. Null and empty texts have the model's constant."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in it:
            yield pd.Series(_softplus_grad(np.array([logit(m, t) for t in s], np.float64)), dtype="float64")

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double").asNondeterministic()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text); other columns are not read."""
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `limit` or more; all columns stay, in whatever names."""
    name = "__toxic"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, scorer(docs, model)(F.col("text").cast("string"))).where(F.col(name) < limit).select(docs.columns)
