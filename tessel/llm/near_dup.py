"""MinHash near-duplicate detection by a multi-index Hamming join.

Each text's set of word shingles gets a signature of SYMBOLS minhash values,
each cut to 16 bits. Two signatures differ in as many places as their symbols
differ. They are split into CHUNKS of four symbols. By the pigeonhole principle
two signatures that differ in fewer than 2 * CHUNKS symbols differ in at most
one symbol of some chunk, so an index of each chunk with each one of its symbols
left out (the allowed chunk errors) brings together every pair within that
distance. At 32 symbols the distance is 15 and a pair of the least allowed
similarity (0.8) is missed with a probability of 1e-6.

Found pairs are confirmed on the full sets. Copies with equal sets are one
node. Within an index entry all members are first held against its leader (the
smallest node), and those tied by these links get a common label. What an entry then
holds under several labels is compared further, each pair in the first entry that
holds it. An entry of more than one block first loses the members that share too
few shingles with any other to be linked (those that only one of the members has
are counted), then its other labels are held against a second leader, the member that shares
most; at last the members of its most frequent label are dealt out to blocks
and the few others are held against each block. So no table of all pairs exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import batches, materialize, remove, shingles, small
from tessel.llm.graph import connected_components

SYMBOLS, CHUNK = 32, 4
CHUNKS = SYMBOLS // CHUNK
#: Pairs that differ in more symbols are not confirmed; far beyond the guaranteed distance.
FAR = 22
#: Members of a block, and bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 2048, 24 << 20
#: A text class with more than this share of all rows is joined by a broadcast: there are no more than so many of them.
HOT = 1000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_SALT = _rng.integers(0, 2**63, CHUNKS * CHUNK, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of permuted hashes, 16 bits of each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            part = s[at : at + 4096]
            for i in range(SYMBOLS):
                least[i] = min(least[i], (part * _MUL[i] + _ADD[i]).min())
        return ((least ^ (least >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(48)).astype(np.uint16)


def entries(sig: np.ndarray) -> np.ndarray:
    """Keys of the index: for each chunk and each symbol left out of it, a hash of the rest."""
    out = np.empty((CHUNKS, CHUNK), np.uint64)
    with np.errstate(over="ignore"):
        c = sig.astype(np.uint64).reshape(CHUNKS, CHUNK)
        for p in range(CHUNK):
            rest = [i for i in range(CHUNK) if i != p]
            packed = (c[:, rest[0]] << np.uint64(32)) | (c[:, rest[1]] << np.uint64(16)) | c[:, rest[2]]
            h = (packed + _SALT[p::CHUNK]) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, p] = (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFFE0)
        out |= np.arange(CHUNKS * CHUNK, dtype=np.uint64).reshape(CHUNKS, CHUNK)
    return out.reshape(-1)


_SIGNED = pa.schema(
    [("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("sig", pa.binary()), ("entries", pa.list_(pa.int64()))]
)


def _sign(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n, same, sig, keys = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                if len(s):
                    x = signature(s)
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(x.tobytes())
                    keys.append(entries(x).view(np.int64))
                else:
                    same.append(None), sig.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                schema=_SIGNED,
            )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _confirm_leader(percent: int, width: int):
    """Rows (leader, id, text) in the order of leader, its own row first: pairs that are linked.

    Only the leader's set is held, however many members follow.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches(it):
            out = []
            for leader, i, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if leader == i:
                    now, own = leader, shingles(text, width)
                elif leader == now and _linked(own, shingles(text, width), percent):
                    out.append((leader, i))
            yield _links(out)

    return run


def first_entry(match: np.ndarray) -> np.ndarray:
    """For pairs' symbol matches (pairs, SYMBOLS): the number of the first entry that both are in, or -1."""
    m = match.reshape(len(match), CHUNKS, CHUNK)
    n = m.sum(2)
    hit = n >= CHUNK - 1
    chunk = hit.argmax(1)
    row = np.arange(len(m))
    gap = np.where(n[row, chunk] == CHUNK, 0, (~m[row, chunk]).argmax(1))
    return np.where(hit.any(1), chunk * CHUNK + gap, -1)


def _groups(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Lists of neighbouring rows with equal first `keys` columns."""
    now, rows = None, []
    for b in batches(it, 4096):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield rows
                now, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


_BLOCK = pa.schema(
    [("entry", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("node", pa.int64()), ("label", pa.int64()), ("major", pa.bool_()), ("n", pa.int64()), ("cap", pa.int64()), ("sig", pa.binary())]
)
_BLOCK_DDL = "entry long, block int, blocks int, node long, label long, major boolean, n long, cap long, sig binary"


def _candidates(rows: list[tuple], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block (in the order of _BLOCK): the later rows that it must be compared with here.

    Two members of no frequent label lie together in every block; their pair belongs to one of them.
    """
    entry, block, blocks = rows[0][0] & 31, rows[0][1], rows[0][2]
    sigs = np.frombuffer(b"".join(r[8] for r in rows), np.uint16).reshape(-1, SYMBOLS)
    nodes, labels, sizes, caps = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 6, 7))
    major = np.array([r[5] for r in rows], bool)
    for k in range(len(rows)):
        if major[k]:
            break  # these come last, and are of one label
        others = np.arange(k + 1, len(rows))
        # An intersection is no larger than either set, nor than what either shares with any other member.
        most = np.minimum(caps[others], caps[k])
        fits = (labels[others] != labels[k]) & (100 * most >= percent * (sizes[others] + sizes[k] - most))
        if blocks > 1:
            fits &= major[others] | ((nodes[others] + nodes[k]) % blocks == block)
        others = others[fits]
        if len(others):
            match = sigs[others] == sigs[k]
            others = others[(match.sum(1) >= SYMBOLS - FAR) & (first_entry(match) == entry)]
            if len(others):
                yield k, others


def _pick(percent: int):
    """Rows of blocks that have something to be compared with."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(it, 2):
            if len(rows) > 1:
                used = set()
                for k, others in _candidates(rows, percent):
                    used.add(k)
                    used.update(others.tolist())
                if used:
                    cols = zip(*(rows[k] for k in sorted(used)), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, _BLOCK.types, strict=True)], schema=_BLOCK
                    )

    return run


def _compare(percent: int, width: int):
    """Blocks with texts: links between labels that are not linked yet."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(it, 2):
            root = {r[4]: r[4] for r in rows}

            def find(c, root=root):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            sets: dict[int, np.ndarray] = {}

            def full(k, rows=rows, sets=sets):
                if k not in sets:
                    sets[k] = shingles(rows[k][9], width)
                return sets[k]

            out = []
            for k, others in _candidates(rows, percent):
                for o in others.tolist():
                    a, b = find(rows[k][4]), find(rows[o][4])
                    if a != b and _linked(full(k), full(o), percent):
                        root[max(a, b)] = min(a, b)
                        out.append((rows[k][4], rows[o][4]))
            yield _links(out)

    return run


def _tokens(width: int):
    """(node, shingle) of rows (node, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 64):
            sets = [shingles(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            nodes = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(sets), pa.int64())], names=["node", "token"])

    return run


def _unlinked_members_out(member: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """`member` (entry, node, label, n, k) of entries of several blocks without those that cannot be linked there; adds cap.

    cap bounds what a member's set shares with any other: its shingles less those that no other
    member of these entries has. A link needs (100 + percent) * intersection >= percent * both sizes.
    """
    nodes = materialize(member.select("node").distinct(), "crowded")
    tokens = texts.join(small(nodes), "node", "left_semi").select("node", "text").mapInArrow(_tokens(width), "node long, token long")
    alone = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    own = materialize(alone.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "own")
    least = member.groupBy("entry").agg(F.min("n").alias("least"))
    capped = member.join(own, "node", "left").withColumn("cap", F.col("n") - F.coalesce("own", F.lit(0))).join(least, "entry")
    out = capped.where((100 + percent) * F.col("cap") >= percent * (F.col("n") + F.col("least"))).select("entry", "node", "label", "n", "cap")
    remove(nodes)
    return out


def _led(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): which of the distinct `pairs` (leader, node) are linked; the members of a leader are dealt out to tasks."""
    wanted = materialize(pairs.union(pairs.select("leader", F.col("leader").alias("node")).distinct()), "wanted")
    # Few leaders have more members than one task is to hold; the others need no join by their key.
    spread = materialize(wanted.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("parts")).where("parts > 1"), "spread")
    rows = wanted.join(small(spread), "leader", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select(
        "leader", "node", F.when(F.col("leader") == F.col("node"), F.sequence(F.lit(0), F.col("parts") - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("node"), "parts").cast("int"))).alias("part"),
    ).select("leader", "node", F.explode("part").alias("part"))
    led = rows.join(texts, "node").repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("leader") != F.col("node"))
    links = materialize(led.select("leader", "node", "text").mapInArrow(_confirm_leader(percent, width), "a long, b long"), "links")
    remove(wanted)
    remove(spread)
    return links


def _led_again(rest: DataFrame, texts: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """`rest` (entry, node, label, n, cap) with new labels, and the links (a, b) of labels that gave them.

    The second leader of an entry is the member that shares most with others; it is held against all of other labels.
    """
    leader = rest.groupBy("entry").agg(F.max(F.struct("cap", "node", "label")).alias("l")).select("entry", F.col("l.node").alias("leader"), F.col("l.label").alias("to"))
    pairs = materialize(rest.join(leader, "entry").where("label <> to").select("leader", "to", "node", "label").distinct(), "pairs")
    links = _led(pairs.select("leader", "node").distinct(), texts, percent, width)
    tied = materialize(pairs.join(links.toDF("leader", "node"), ["leader", "node"]).select(F.col("to").alias("a"), F.col("label").alias("b")).distinct(), "tied")
    moved = tied.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
    again = rest.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    out = materialize(again.select("entry", "node", "label", "n", "cap"), "rest")
    for t in (pairs, links, rest):
        remove(t)
    return out, tied


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("bytes") * 8 / BLOCK_BYTES)).cast("int")


def _judged(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, h, n, component) of each row; h is the hash of its text. Rows of one text are one node."""
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    signed = materialize(read.mapInArrow(_sign(width), "id long, h long, n long, same binary, sig binary, entries array<long>"), "signed")
    known = signed.where("id IS NOT NULL AND n > 0")
    classes = known.groupBy("same").agg(F.min(F.struct("id", "h", "n", "sig", "entries")).alias("r"), F.count(F.lit(1)).alias("members"))
    reps = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "same", "members", "r.*"), "reps")
    keyed = reps.select("node", "n", F.explode("entries").alias("entry"))
    full = keyed.groupBy("entry").agg(
        F.min("node").alias("leader"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("bytes")
    ).where("members > 1")
    shared = materialize(keyed.join(full, "entry"), "shared")

    # Texts of all that share an entry, read once more; of repeated rows, which only a class of several rows can have, one.
    involved = materialize(shared.select("node").distinct().join(reps.select("node", "id", "h", "members"), "node"), "involved")
    found_texts = materialize(read.join(small(involved, F.lit(40)), ["id", "h"]).select("node", "members", "text"), "texts")
    texts = found_texts.where("members = 1").select("node", "text").union(found_texts.where("members > 1").select("node", "text").dropDuplicates(["node"]))

    # Round 1: each entry's members against its leader.
    pairs = shared.select("leader", "node").where("leader <> node").distinct()
    found = _led(pairs, texts, percent, width)
    # A label is the least leader within four links; a leader is less than its members.
    hop = found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    for _ in range(2):
        hop = hop.join(hop.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    labels = materialize(hop, "labels")

    # Round 2: what one entry holds under several labels.
    member = shared.join(labels, "node", "left").select("entry", "node", F.coalesce("label", "node").alias("label"), "n")
    member = materialize(member, "member")
    sums = (F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("bytes"))
    mixed_up = materialize(member.groupBy("entry").agg(*sums).where("lo <> hi").select("entry", _blocks().alias("blocks")), "mixed")
    crowds = mixed_up.where("blocks > 1")
    placed = member.join(mixed_up.where("blocks = 1"), "entry").select("entry", F.lit(0).alias("block"), "blocks", "node", "label", F.lit(False).alias("major"), "n", F.col("n").alias("cap"))
    scrap, tied = [], None
    if not crowds.isEmpty():
        rest = materialize(_unlinked_members_out(member.join(crowds, "entry", "left_semi"), texts, percent, width), "rest")
        rest, tied = _led_again(rest, texts, percent, width)
        left = rest.groupBy("entry").agg(*sums).where("lo <> hi").select("entry", _blocks().alias("blocks"))
        most = rest.groupBy("entry", "label").count().groupBy("entry").agg(F.max(F.struct("count", "label"))["label"].alias("top"))
        dealt = rest.join(left.join(most, "entry"), "entry").withColumn("major", (F.col("label") == F.col("top")) & (F.col("blocks") > 1))
        block = F.when(F.col("major"), F.array(F.pmod(F.xxhash64("node"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = placed.union(dealt.select("entry", F.explode(block).alias("block"), "blocks", "node", "label", "major", "n", "cap"))
        scrap += [rest, tied]
    whole = placed.join(reps.select("node", "sig"), "node").select(_BLOCK.names)
    order = ("entry", "block", "major", "node")
    near = materialize(whole.repartition("entry", "block").sortWithinPartitions(*order).mapInArrow(_pick(percent), _BLOCK_DDL), "near")
    joined = near.join(texts, "node").select(*_BLOCK.names, "text").repartition("entry", "block").sortWithinPartitions(*order)
    more = materialize(joined.mapInArrow(_compare(percent, width), "a long, b long"), "links")

    # A node's label, the label's component, and the least doc_id of that.
    of_a, of_b = (labels.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}")) for n in ("a", "b"))
    ties = found.join(of_a, "a", "left").join(of_b, "b").select(F.coalesce("label_a", "a").alias("a"), F.col("label_b").alias("b")).where("a <> b")
    all_ties = ties.union(more) if tied is None else ties.union(more).union(tied)
    further = connected_components(all_ties).select(F.col("id").alias("label"), "component")
    named = reps.select("node", "same", "id", "members").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_node = materialize(named.join(further, "label", "left").select("same", "id", "members", F.coalesce("component", "label").alias("root")), "roots")
    least = of_node.groupBy("root").agg(F.min("id").alias("component"))
    total = signed.count()
    of_class = materialize(of_node.join(least, "root").where("members > 1 OR component <> id").select("same", "component", (F.col("members") * HOT > total).alias("hot")), "classes")
    cols = [F.col("id"), F.col("h"), F.col("n")]
    some, none = signed.where("same IS NOT NULL").select("id", "h", "n", "same"), signed.where("same IS NULL").select(*cols, F.col("id").alias("component"))
    # Fewer than HOT classes hold a HOT-th of all rows each; no other key of the second join has as many rows.
    hot = F.broadcast(of_class.where("hot").select("same", "component"))
    done = some.join(hot, "same").select(*cols, "component")
    other = some.join(hot, "same", "left_anti").join(of_class.where("NOT hot").select("same", F.col("component").alias("c")), "same", "left").select(*cols, F.coalesce("c", "id").alias("component"))
    for t in (reps, shared, involved, found_texts, labels, member, mixed_up, near, found, more, of_node, *scrap):
        remove(t)
    # A row without an id belongs to nothing, whatever its text.
    return done.union(other).union(none).withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text).

    Texts whose sets of `width`-word shingles have 100 * intersection >=
    percent * union are linked; component_id is the smallest doc_id reachable
    and kept marks it. A null or empty text, or one without words, has no
    shingles and is linked with nothing. Rows that repeat a doc_id with the same
    text are one document and are all returned, with the same result; if their
    texts differ, each row has its own n_shingles and the component of its own text.
    A row without doc_id has a null component, links nothing and is kept. Other
    columns, whatever their names, are not read. An empty table gives an empty
    one.
    """
    out = _judged(docs, percent, width).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """`docs` without the rows whose doc_id is not the smallest of their component; all columns stay.

    Of rows that repeat a doc_id with different texts each is judged by its own text.
    """
    gone = materialize(_judged(docs, percent, width).where("id <> component").select("id", "h").distinct(), "dropped")
    key = (F.col("doc_id").cast("long") == F.col("__dropped.id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__dropped.h"))
    return docs.alias("__docs").join(small(gone).alias("__dropped"), key, "left_anti").select(docs.columns)


def sql(percent: int = 85, width: int = 5) -> str:
    """Exact components in DuckDB's SQL, by counting the shared shingles of all pairs (small tables only)."""
    return (
        "WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
        f"s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, least(len(w), 1) + 1))) AS i FROM d)), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
        "p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y), "
        f"e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)), "
        "both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), "
        "c AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT y, r FROM c JOIN both_ways ON x = doc_id WHERE r < y), "
        "m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept "
        "FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"
    )
