"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file. The trie lies in two
arrays (base and check) over bytes, so a step for all positions of a batch at
once is an index and a comparison. Matches are found from every position in
step; then the best path is taken offset by offset for all units together.

A unit is a run of white space markers with what follows, or a line feed: no
piece of a usual vocabulary crosses such a border (this is checked when the
vocabulary is loaded; otherwise a whole text is the unit), so the best paths of
units put together are the best path of the text, and equal units are solved
once. A character without a piece of its own becomes its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import batches

MARK = "▁"
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_COST = 10.0
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class DoubleArray:
    """A trie of byte strings: child c of s is base[s] + c, if check of that is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        self_value = [-1]
        for i, key in enumerate(keys):
            s = 0
            for c in key:
                t = children[s].get(c)
                if t is None:
                    t = len(children)
                    children[s][c] = t
                    children.append({})
                    self_value.append(-1)
                s = t
            self_value[s] = i
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        # Only children fill gaps from below; larger families are sought from where the last one fitted.
        place, todo, low, tail = {0: 0}, [0], 256, 1
        taken = bytearray(1) + bytearray(size - 1)
        taken[0] = 1
        while todo:
            s = todo.pop()
            at = place.pop(s)
            value[at] = self_value[s]
            kids = sorted(children[s])
            if not kids:
                continue
            if len(kids) == 1:
                while taken[low]:
                    low += 1
                b = low - kids[0]
            else:
                b, tries = tail, 0
                while any(taken[b + c] for c in kids):
                    b += 1
                    tries += 1
                if tries > 64:
                    tail = b
            if b + 768 >= len(taken) or low + 768 >= len(taken):
                grow = len(taken)
                taken += bytearray(grow)
                base = np.concatenate((base, np.zeros(grow, np.int32)))
                check = np.concatenate((check, np.full(grow, -1, np.int32)))
                value = np.concatenate((value, np.full(grow, -1, np.int32)))
            base[at] = b
            for c in kids:
                t = children[s][c]
                taken[b + c] = 1
                check[b + c] = at
                place[t] = b + c
                todo.append(t)
        used = np.frombuffer(bytes(taken), np.uint8)
        last = int(np.flatnonzero(used)[-1]) + 257
        pad = max(0, last - len(base))
        fit = lambda x, fill: np.concatenate((x, np.full(pad, fill, np.int32)))[:last]
        self.base, self.check, self.value = fit(base, 0), fit(check, -1), fit(value, -1)

    def matches(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every key found at `starts` in `data`, which ends in a zero byte."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, state, depth = starts, np.zeros(len(starts), np.int32), 0
        while len(at):
            nxt = self.base[state] + data[np.minimum(at + depth, len(data) - 1)]
            ok = self.check[nxt] == state
            at, state = at[ok], nxt[ok]
            depth += 1
            v = self.value[state]
            hit = v >= 0
            out.append((at[hit], at[hit] + depth, v[hit]))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out, strict=True))


class Solved:
    """Ids of units met before, `limit` units at most (about 50 MB) and those of one batch."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.counts, self.start = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(counts) - counts))
        self.pool, self.counts = np.concatenate((self.pool, ids)), np.concatenate((self.counts, counts))


@dataclass
class Vocabulary:
    """Pieces, scores and ids. `normal`: the id of each key of the trie."""

    trie: DoubleArray
    normal: np.ndarray
    scores: np.ndarray
    bytes_ids: np.ndarray  # id of each byte's piece
    worst: float
    cut: bool
    surface: list[bytes]  # bytes that each id stands for, with the marker as a space

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[str]) -> Vocabulary:
        """kinds: normal, byte, or other (control and unknown pieces, which stand for nothing)."""
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        keys = [pieces[i].encode() for i in normal]
        of_byte = np.full(256, -1, np.int32)
        surface = []
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                of_byte[int(p[3:5], 16)] = i
            surface.append(bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"")
        if (of_byte < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        cut = not any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in normal)
        own = np.array([scores[i] for i in normal])
        return cls(DoubleArray(keys), np.array(normal, np.int32), own, of_byte, float(own.min()) - UNKNOWN_COST, cut, surface)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file; only its list of pieces is used."""
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls.of([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [kind(i) for i in n])

    def solve(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one behind the other, their number for each unit)."""
        if not units:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lens = np.array([len(u) for u in units], np.int64)
        data = np.frombuffer(b"".join(u + b"\0" for u in units) or b"\0", np.uint8)
        first = np.concatenate(([0], np.cumsum(lens + 1)[:-1])).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), lens + 1)
        live = np.ones(len(data), bool)
        live[first + lens] = False
        lead = live & ((data & 0xC0) != 0x80)
        starts = np.flatnonzero(lead)
        s, e, v = self.trie.matches(data, starts)
        inside = e <= (first + lens)[unit[s]]
        s, e, v = s[inside], e[inside], v[inside]
        # The end of the character at each start, and those without a piece.
        step = np.where(data[starts] < 0x80, 1, np.where(data[starts] < 0xE0, 2, np.where(data[starts] < 0xF0, 3, 4)))
        char_end = np.zeros(len(data) + 1, np.int64)
        char_end[starts] = starts + step
        single = np.zeros(len(data), bool)
        single[s[e == char_end[s]]] = True
        lost = starts[~single[starts]]
        s, e = np.concatenate((s, lost)), np.concatenate((e, char_end[lost]))
        cost = np.concatenate((self.scores[v], np.full(len(lost), self.worst)))
        v = np.concatenate((v, np.full(len(lost), -1, v.dtype)))
        # All matches by the offset of their end in the unit, then by end, then by start.
        offset = e - first[unit[s]]
        order = np.lexsort((s, e, offset))
        s, e, v, cost, offset = s[order], e[order], v[order], cost[order], offset[order]
        best = np.full(len(data) + 1, -np.inf)
        best[first] = 0
        back = np.full(len(data) + 1, -1, np.int64)
        levels = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1]))) if len(s) else np.empty(0, np.int64)
        for lo, hi in zip(levels, np.append(levels[1:], len(s)), strict=True):
            total = best[s[lo:hi]] + cost[lo:hi]
            group = np.flatnonzero(np.concatenate(([True], e[lo + 1 : hi] != e[lo : hi - 1])))
            top = np.maximum.reduceat(total, group)
            size = np.diff(np.append(group, hi - lo))
            won = np.flatnonzero(total == np.repeat(top, size))
            which = np.repeat(np.arange(len(group)), size)[won]
            keep = np.concatenate(([True], which[1:] != which[:-1]))  # the earliest start among equals
            won = won[keep]
            best[e[lo + won]] = total[won]
            back[e[lo + won]] = lo + won
        # Back from the ends of all units together.
        at = (first + lens).copy()
        who = np.flatnonzero(lens > 0)
        trail: list[tuple[np.ndarray, np.ndarray]] = []
        at = at[who]
        while len(who):
            m = back[at]
            trail.append((who, m))
            at = s[m]
            more = at > first[who]
            who, at = who[more], at[more]
        if not trail:
            return np.empty(0, np.int32), np.zeros(len(units), np.int64)
        who, m = (np.concatenate(x) for x in zip(*trail, strict=True))
        order = np.lexsort((s[m], who))
        who, m = who[order], m[order]
        wide = np.where(v[m] < 0, e[m] - s[m], 1)
        ids = np.repeat(np.where(v[m] < 0, 0, self.normal[np.maximum(v[m], 0)]), wide).astype(np.int32)
        raw = np.flatnonzero(np.repeat(v[m] < 0, wide))
        within = np.arange(len(ids)) - np.repeat(np.cumsum(wide) - wide, wide)
        ids[raw] = self.bytes_ids[data[np.repeat(s[m], wide)[raw] + within[raw]]]
        counts = np.bincount(who, wide, len(units)).astype(np.int64)
        return ids, counts

    def encode(self, texts: list[str | None], known: Solved | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number for each text). A null or empty text has none.

        `known` carries solved units from call to call.
        """
        known = known if known is not None else Solved()
        if len(known.number) > known.limit:
            known.clear()
        number, before = known.number, len(known.number)
        of_text, sizes = [], []
        for t in texts:
            marked = MARK + t.replace(" ", MARK) if t else ""
            found = _UNIT.findall(marked) if self.cut else [marked] if marked else []
            of_text.extend([number.setdefault(u, len(number)) for u in found])
            sizes.append(len(found))
        known.add(*self.solve([u.encode("utf-8", "replace") for u in islice(number, before, None)]))
        seq = np.array(of_text, np.int64)
        start, n = known.start[seq], known.counts[seq]
        ids = known.pool[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(total[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts; markers are spaces, the first one goes, and bytes that are no UTF-8 become U+FFFD."""
        out, at = [], 0
        for n in counts.tolist():
            text = b"".join(map(self.surface.__getitem__, ids[at : at + n].tolist())).decode("utf-8", "replace")
            out.append(text.removeprefix(" "))
            at += n
        return out


_ENCODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for each row of `docs` (doc_id, text).

    round_trip: decoding the ids gives the text again (false only where a text
    holds the marker character itself). A null text counts as empty: no ids.
    Other columns are not read; repeated rows are returned as often.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # a few MB: grows with the vocabulary only

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = shared.value, Solved()
        for b in batches(it, 128):
            texts = b.column(1).to_pylist()
            ids, counts = vocabulary.encode(texts, known)
            same = [(t or "") == x for t, x in zip(texts, vocabulary.decode(ids, counts), strict=True)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for each row of `encoded` (doc_id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 128):
            rows = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            texts = shared.value.decode(np.concatenate(rows) if rows else np.empty(0, np.int64), np.array([len(x) for x in rows], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
