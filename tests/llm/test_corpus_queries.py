"""Corpus operators against SQL or brute force, and their edge cases."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import chat, decontaminate, graph, hamming_search, html_text, near_dup, pii, queries, sentencepiece, substring_dedup, toxicity, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, score double, label long"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df, rel = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    pick = lambda rows, cols: sorted(repr([r[cols.index(c)] for c in order]) for r in rows)
    assert pick([tuple(r) for r in df.collect()], list(df.columns)) == pick(rel.fetchall(), list(rel.columns))


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in zip(ids, texts)], DOCS)


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts, percent):
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_brute_force(spark, percent):
    rnd = random.Random(percent)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    texts = [None, "", " \t\n", "one", "One", "a b c", "a  b\tc", " ".join(base), " ".join(base).upper()]
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["x " * 30000, "x " * 100]
    root, sizes = components(texts, percent)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(spark, texts), percent).collect()}
    assert [(got[i].component_id, got[i].n_shingles, got[i].kept) for i in range(len(texts))] == [(r, n, r == i) for i, (r, n) in enumerate(zip(root, sizes))]


def test_near_duplicates_blocks_are_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    test_near_duplicates_brute_force(spark, 80)


def test_near_duplicates_edges(spark):
    empty = near_dup.near_duplicates(docs_of(spark, []))
    assert empty.count() == 0
    same = near_dup.near_duplicates(docs_of(spark, ["a b c d e f"] * 3 + [None], [5, 5, 9, None]))
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in same.collect()) == [(-1, None, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    kept = near_dup.drop_near_duplicates(docs_of(spark, ["a b c d e f"] * 2))
    assert kept.columns == ["doc_id", "text", "key", "score", "label"] and [r.doc_id for r in kept.collect()] == [0]


def test_near_duplicates_repeated_ids(spark):
    """Texts under one id are judged one by one; none that is linked with nothing goes."""
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    texts = [words("a"), words("a") + " more", words("b"), words("c"), words("c"), None, words("a")]
    df = docs_of(spark, texts, [1, 2, 2, 3, 3, 2, None])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, 36, None, True), (1, 36, 1, True), (2, 0, 2, True), (2, 36, 2, True), (2, 37, 1, False), (3, 36, 3, True), (3, 36, 3, True)]
    kept = near_dup.drop_near_duplicates(df.withColumn("id", F.lit(7)).withColumn("h", F.lit(1))).collect()
    assert sorted(r.text or "" for r in kept) == sorted((texts[i] or "") for i in (0, 2, 3, 4, 5, 6))


def test_near_duplicates_rows_are_linear(spark, monkeypatch):
    """A group of near copies, many of them below the threshold: rows compared grow as the group, and components are exact."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 64)
    seen = {}
    keep = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, name: seen.update({name: keep(df, name)}) or seen[name])
    monkeypatch.setattr(near_dup, "remove", lambda df: None)
    rows = {}
    for n in (300, 900):
        rnd = random.Random(n)
        base, texts = [f"w{i}" for i in range(150)], []
        for _ in range(n):
            w = list(base)
            for _ in range(min(int(rnd.expovariate(0.5)), 15)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**9)}"
            texts.append(" ".join(w))
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(spark, texts)).collect()}
        rows[n] = seen["near"].count()
        if n == 300:
            assert [got[i] for i in range(n)] == components(texts, 80)[0]
    assert rows[900] <= 4.5 * max(rows[300], n)


def test_index_covers_every_pair_within_the_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**16, near_dup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(near_dup.SYMBOLS, 15, replace=False)] ^= 1
        assert set(near_dup.entries(a)) & set(near_dup.entries(b))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_substring_dedup(spark):
    rnd = random.Random(1)
    sentence = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(6, 25))) + "."
    shared = [sentence() for _ in range(6)]
    own = lambda n: [sentence() for _ in range(n)]
    texts = [" ".join(own(3) + shared + own(2)), " ".join(own(2)) + "\n" + " ".join(shared), " ".join(own(20)), None, "", " ".join(shared), "Word. " * 50000]
    got = {r.doc_id: r for r in substring_dedup.deduplicated(docs_of(spark, texts)).collect()}
    assert set(got) == {1, 5, 6} - ({6} if substring_dedup.runs(texts[6]) == [] else set())
    assert got[5].text == "" and got[5].first_doc_ids == [0] and all(s not in got[1].text for s in shared)
    whole = {r.doc_id: r.text for r in substring_dedup.deduplicate(docs_of(spark, texts)).collect()}
    assert len(whole) == 7 and whole[2] == texts[2] and whole[0] == texts[0] and whole[3] is None
    assert substring_dedup.deduplicated(docs_of(spark, [])).count() == 0


def test_substring_dedup_short_sentences(spark):
    """Lists, verse and dialogue repeat too: runs of few words count as all others do."""
    dialogue = "\n".join(f"No {i}! Who?" for i in range(40))
    texts = [dialogue, f"Before it.\n{dialogue}\nAnd what follows.", dialogue, "Yes. No. Maybe.", "Yes. No. Maybe.", "Yes. No.", "Yes. No."]
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs_of(spark, texts)).collect()}
    assert got == {1: "Before it.\nAnd what follows.", 2: "", 4: ""}


def test_substring_dedup_lead_ins(spark):
    """Text without sentence ends: a passage is found behind any lead-in, and nothing else goes (brute force)."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    words = lambda n: [word() for _ in range(n)]
    texts, shared = [], []
    for n in [50] * 20 + [60] * 20 + [120, 500] * 5:
        passage = words(n)
        texts += [" ".join(words(5) + passage + words(20)), " ".join(words(8 + rnd.randrange(16)) + passage + words(7))]
        shared.append(passage)
    han = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(80))
    texts += [f"\u4e00\u4e01{han}", f"\u4e03{han}", "same " * 5000, "x " + "same " * 200]
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs_of(spark, texts)).collect()}
    for i, passage in enumerate(shared):
        before, left = texts[2 * i + 1].split(), got[2 * i + 1].split()
        lead = " ".join(before).index(" ".join(passage))
        lead = len(" ".join(before)[:lead].split())
        gone = len(before) - len(left)
        at = next(k for k in range(len(left) + 1) if before[:k] + before[k + gone :] == left)
        assert lead <= at and at + gone <= lead + len(passage) and gone >= 12
        assert len(passage) < 120 or gone >= 0.6 * len(passage)
    n = 2 * len(shared)
    assert all(2 * i not in got for i in range(len(shared))) and len(got[n + 1]) <= 41 and len(got[n + 3].split()) < 40


def test_substring_dedup_repeated_ids(spark):
    """Each text under an id keeps its own; equal rows are one document."""
    own = lambda k: " ".join(f"{k}{i} {k}." for i in range(6))
    texts = [own("a"), own("a"), own("b") + " " + own("a"), own("c"), own("a"), None]
    df = docs_of(spark, texts, [1, 1, 2, 2, None, 2])
    assert sorted((r.doc_id or 0, r.text or "") for r in substring_dedup.deduplicate(df).collect()) == [(0, own("a")), (1, own("a")), (1, own("a")), (2, ""), (2, own("b")), (2, own("c"))]


def test_substring_dedup_whole_table(spark):
    """All documents against a second reading of the rule: the first sight of a run stays, later ones go."""
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")
    seen, want = set(), {}
    for i, text in zip(t.doc_id, t.text):
        cut = substring_dedup.sentences(text or "")
        said = [c[2] for c in cut]
        gone = set()
        for k in range(len(said) - 2):
            run = tuple(said[k : k + 3])
            if run in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(run)
        if gone:
            want[i] = [said[k] for k in range(len(said)) if k not in gone]
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op1_substring_dedup(spark, SF).collect()}
    assert got.keys() == want.keys() and want
    for i, left in want.items():
        assert "".join(got[i][0].lower().split()) == "".join("".join(left).split())


def test_hamming_search_brute_force(spark):
    rnd = random.Random(2)
    codes = [rnd.getrandbits(64) - 2**63 for _ in range(300)]
    codes += [c ^ (1 << rnd.randrange(63)) for c in codes[:60]] + [codes[0]] * 40
    rows = spark.createDataFrame([(i, c, "x") for i, c in enumerate(codes)] + [(None, 1, "x"), (999, None, "x")], "id long, code long, q string")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "code")
    got = collections.defaultdict(list)
    for r in hamming_search.top_k(rows, asked, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    m = 2**64 - 1
    for i in range(0, 400, 50):
        assert got[i] == sorted(((codes[i] ^ c) & m).bit_count() * 1000 + j for j, c in enumerate(codes))[:5] or got[i] == sorted((((codes[i] ^ c) & m).bit_count(), j) for j, c in enumerate(codes))[:5]
    assert hamming_search.top_k(rows.limit(0), asked, 5).count() == 0
    assert hamming_search.top_k(rows.limit(3), asked.limit(1), 5).count() == 3


@pytest.mark.parametrize("m", [2, 3])
def test_hamming_search_few_segments(spark, monkeypatch, m):
    """What tables beyond 2 ** 18 codes use: few long segments, masks of any radius."""
    monkeypatch.setattr(hamming_search, "segments", lambda n: [(64 * i // m, 64 * (i + 1) // m - 64 * i // m) for i in range(m)])
    rnd = random.Random(m)
    base = [rnd.getrandbits(64) - 2**63 for _ in range(8)]
    flip = lambda c, n: c ^ sum(1 << b for b in rnd.sample(range(63), n))
    codes = base + [flip(c, rnd.randrange(4)) for c in base for _ in range(6)]
    rows = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    asked = rows.where("id < 8").select(F.col("id").alias("query_id"), "code")
    got = collections.defaultdict(list)
    for r in hamming_search.top_k(rows, asked, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    for q in range(8):
        assert got[q] == sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), j) for j, c in enumerate(codes))[:5]


def test_contained_items(spark):
    item = " ".join(f"w{i}" for i in range(30))
    filler = " ".join(f"f{i}" for i in range(15000))
    texts = [f"{filler} {item.upper()} {filler}", filler, None, "", item.replace("w3 ", "z "), " ".join(item.split()[:20])]
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "not there", "x"), (None, item, "x"), (4, item, "x")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained(docs_of(spark, texts), items).collect())
    assert got == [(0, 1, 26), (0, 4, 26), (4, 1, 22), (4, 4, 22)]
    assert decontaminate.contained(docs_of(spark, texts), items.limit(0)).count() == 0
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, texts), items).orderBy("doc_id").collect()] == [1, 2, 3, 5]


def test_contained_short_items(spark):
    """Items of fewer words than a shingle are one run; a document with several texts under one id loses only the one that holds an item."""
    texts = ["the quick brown fox jumps over", "quick brown fox", "Quick\tbrown fox jumps", "yes", "a yes b", "fox jumps quick brown", None, ""]
    items = spark.createDataFrame([(1, "quick brown fox jumps"), (2, "yes"), (3, "not there"), (4, ""), (5, " ")], "item_id long, text string")
    df = docs_of(spark, texts)
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared, r.containment) for r in decontaminate.contained(df, items).collect())
    assert got == [(0, 1, 1, 1, 1.0), (2, 1, 1, 1, 1.0), (3, 2, 1, 1, 1.0), (4, 2, 1, 1, 1.0)]
    repeated = docs_of(spark, texts, [0, 1, 1, 2, 2, 3, 3, None])
    assert [r.text for r in decontaminate.drop_contaminated(repeated.withColumn("__id", F.lit(1)), items).orderBy("doc_id", "text").collect()] == ["", "quick brown fox", None, "fox jumps quick brown"]


def test_contained_brute_force(spark):
    """Random items of 1 to 60 words in texts that hold a part of them, against counting."""
    rnd = random.Random(12)
    words = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    items = [words(n) for n in [1, 2, 3, 4, 5, 6, 7, 9] + [rnd.randint(10, 60) for _ in range(30)]]
    texts = []
    for _ in range(250):
        w = list(rnd.choice(items))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
        texts.append(words(rnd.randrange(80)) + w[: rnd.randint(max(1, len(w) - 6), len(w))] + words(rnd.randrange(80)))
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, item in enumerate(items):
        k = min(5, len(item))
        own = runs(item, k)
        want |= {(d, i, len(own & runs(t, k))) for d, t in enumerate(texts) if 100 * len(own & runs(t, k)) >= 80 * len(own)}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained(docs_of(spark, [" ".join(t) for t in texts]), table).collect()}
    assert got == want and len(want) > 100


def test_chat_round_trip():
    rnd = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|", "<|", "\\", "\n", "%0A", "a", "<", "|", "漢"]
    word = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))
    for _ in range(500):
        messages = [(rnd.choice(["user", "assistant", word()]), word()) for _ in range(rnd.randrange(5))]
        r = chat.render(messages)
        assert chat.parse(r.text) == messages
        assert chat.masked(r) == "".join(t for role, t in messages if role == "assistant")


def test_chat_events(spark):
    log = [
        (1, 3, "delta", None, "lo", None), (1, 2, "message", "assistant", "hel", None), (1, 1, "message", "user", "hi", None),
        (1, 4, "regenerate", None, None, 1), (1, 5, "message", "assistant", "yes", None), (1, 6, "edit", None, "hey", 0), (1, 7, "edit", None, "?", 9),
        (2, 1, "delta", None, "lost", None), (None, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, type string, role string, text string, target int")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(df).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "yes")], 2: [], None: [("", "")]}
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
    none = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}[2]
    assert (none.n_turns, none.turns_sha256) == (0, hashlib.sha256(b"").hexdigest())


MODEL = queries.PIECES


def test_sentencepiece_against_library():
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    rnd = random.Random(6)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -(1 + rnd.random() * 9) * math.sqrt(len(p.piece))
    library = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    n = range(library.get_piece_size())
    kind = lambda i: "byte" if library.is_byte(i) else "other" if library.is_control(i) or library.is_unknown(i) else "normal"
    own = sentencepiece.Vocabulary.of([library.id_to_piece(i) for i in n], [library.get_score(i) for i in n], [kind(i) for i in n])
    alphabet = "ab the  \n\té漢𝄞<x>0 ing"
    texts = ["", " ", "\n", "  a", "a  "] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    texts += pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:40]
    ids, counts = own.encode(texts)
    at, different = 0, 0
    for t, k in zip(texts, counts.tolist()):
        got, want = ids[at : at + k].tolist(), library.encode(t)
        at += k
        if got != want:  # the library adds in 32 bits: ties and long texts may differ, in nothing but rounding
            cost = lambda x: sum(own_score.get(i, 0) for i in x)
            own_score = {int(i): s for i, s in zip(own.normal, own.scores)}
            assert cost(got) >= cost(want) - 1e-3
            different += 1
    assert different < 0.02 * len(texts)
    assert own.decode(ids, counts) == texts


def test_sentencepiece_against_plain_dynamic_programming():
    """Ids of whole texts, one position after the other, with the scores of the file."""
    v = sentencepiece.Vocabulary.load(MODEL)
    score = {v.surface[i].replace(b" ", sentencepiece.MARK.encode()): (s, int(i)) for i, s in zip(v.normal, v.scores)}
    longest = max(map(len, score))

    def plain(text):
        if not text:
            return []
        data = (sentencepiece.MARK + text.replace(" ", sentencepiece.MARK)).encode()
        starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
        best = {0: (0.0, 0, None)}
        for k, end in enumerate(starts[1:], 1):
            for start in starts[:k]:
                piece = data[start:end] if end - start <= longest else b""
                found = score.get(piece)
                if found is None and start == starts[k - 1]:
                    found = (v.worst, None)
                if found and (end not in best or best[start][0] + found[0] > best[end][0]):
                    best[end] = (best[start][0] + found[0], start, found[1])
        out, at = [], len(data)
        while at:
            _, start, i = best[at]
            out[:0] = [int(v.bytes_ids[b]) for b in data[start:at]] if i is None else [i]
            at = start
        return out

    rnd = random.Random(16)
    texts = ["", " ", "  a  b", "\n\n", "漢𝄞é", "a\x00b"] + ["".join(rnd.choice("the ing\n\tAé漢𝄞 0.") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += [t[:300] for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:60]]
    ids, counts = v.encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == plain(t), t
        at += n


def test_sentencepiece_stage(spark):
    texts = ["Hello  world\n漢𝄞", None, "", "x" * 50000, "a▁b"]
    out = {r.doc_id: r for r in sentencepiece.encode(docs_of(spark, texts), MODEL).collect()}
    assert [out[i].round_trip for i in range(5)] == [True, True, True, True, False] and out[1].ids == [] and out[0].n_tokens == len(out[0].ids)
    back = sentencepiece.decode(spark.createDataFrame(list(out.values())), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {0: texts[0], 1: "", 2: "", 3: texts[3], 4: "a b"}
    assert sentencepiece.encode(docs_of(spark, []), MODEL).count() == 0


def test_pii(spark):
    texts = [
        "Mr. John Smith, Mrs. Jane Smith, +1 (743) 555-3824 or +1-743-555-3824.", "a.b@mail.example.com A.B@MAIL.EXAMPLE.COM 4111111111111111 4111 1111 1111 1112 10.0.0.1",
        None, "", "clean text 12", "господин Иван Петров " * 3000, "a.b@mail.example.com",
    ]
    df = docs_of(spark, texts)
    out = {r.doc_id: r.text for r in pii.replaced(df, "k").collect()}
    assert set(out) == {0, 1, 5, 6}
    m = re.fullmatch(r"Mr\. (\w+) (\w+), Mrs\. (\w+) (\w+), \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4})\.", out[0])
    ends = lambda name, gender: name.endswith(tuple(pii.ENDINGS[gender, "latin"].split()))
    assert m[2] == m[4] and m[1] != m[3] and ends(m[1], "m") and ends(m[3], "f") and m.group(5, 6, 7) == m.group(8, 9, 10)
    lower, upper, good, *rest = out[1].split(" ")
    assert lower == upper.lower() == out[6] and "@" in lower and lower != texts[6]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10
    assert luhn(good) == 0 and luhn("".join(rest[:4])) != 0 and re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", rest[4])
    assert not re.search("John|Smith|Jane|743|4111|Петров", "".join(out.values()))
    every = pii.anonymize(df, "k")
    assert every.columns == df.columns and every.count() == 7
    assert pii.replaced(docs_of(spark, []), "k").count() == 0


def test_pii_names(spark):
    """A name once found is replaced wherever it occurs in its text, alike each time, in its script and gender."""
    texts = [
        "Mr. John Smith came. John Smith left. Smith slept; Smithers did not. Dr. Adam West too, West said.", "Smith and John stay.",
        "Κυρία Ελένη Παπά και Mr. Νίκος Παπάς. Παπάς!", "Mr. 王, Mrs. 김지은; господин Иван Петров, Петров.", "jürgen@müller.de иван@почта.рф",
        "to DE89 3704 0044 0532 0130 00 now", "at 2001:db8:0:0:0:0:2:1 or fe80:1::2, 12:30:45", "Mrs. Smith, Mr. Smith's",
    ]
    df = docs_of(spark, texts).withColumn("__pii_map", F.lit(1)).withColumn("__pii", F.lit(2))
    rows = pii.anonymize(df, "k").collect()
    assert rows[0].asDict().keys() == set(df.columns) and len(rows) == len(texts)
    out = {r.doc_id: r.text for r in rows}
    assert out[1] == texts[1]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) (\w+) left\. (\w+) slept; Smithers did not\. Dr\. (\w+) (\w+) too, (\w+) said\.", out[0])
    assert m[1] == m[3] and m[2] == m[4] == m[5] and m[7] == m[8] and len({m[1], m[2], m[6], m[7]}) == 4
    assert not re.search(r"\b(John|Smith|Adam|West)\b", out[0])
    g = re.fullmatch(r"Κυρία (\w+) (\w+) και Mr\. (\w+) (\w+)\. (\w+)!", out[2])
    greek = re.compile("[\u0370-\u03ff]+")
    assert g[4] == g[5] and g[2] != g[4] and all(greek.fullmatch(x) for x in g.groups()) and not re.search("Ελένη|Παπά|Νίκος", out[2])
    s = re.fullmatch(r"Mr\. ([\u4e00-\u9fff]+), Mrs\. ([\uac00-\ud7a3]+); господин ([\u0400-\u04ff]+) ([\u0400-\u04ff]+), ([\u0400-\u04ff]+)\.", out[3])
    assert s[4] == s[5] and not re.search("王|김지은|Иван|Петров", out[3])
    assert "@" in out[4] and not re.search("jürgen|müller|иван|почта", out[4])
    iban = re.fullmatch(r"to (DE\d\d( \d{4}){4} \d\d) now", out[5])[1]
    assert iban not in texts[5] and int("".join(str(int(c, 36)) for c in iban.replace(" ", "")[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"at ([0-9a-f]{1,4}:){7}[0-9a-f] or [0-9a-f]{4}:[0-9a-f]::[0-9a-f], 12:30:45", out[6]) and "2001:db8" not in out[6] and "fe80" not in out[6]
    t = re.fullmatch(r"Mrs\. (\w+), Mr\. (\w+)'s", out[7])
    assert t[1] == t[2] == m[2]
    with pytest.raises(ValueError):
        pii.anonymize(df, "")


def test_pii_nothing_survives(spark):
    """Random texts of known entities: none is left anywhere in its text, and different ones stay different (brute force)."""
    rnd = random.Random(21)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)).capitalize()
    make = {
        "name": lambda: f"{rnd.choice(['Mr.', 'Mrs.', 'Dr', 'Herr', 'Frau'])} {name()} {name()}", "mail": lambda: f"{name().lower()}{digits(3)}@{name().lower()}.example.com",
        "phone": lambda: f"+1 ({rnd.randint(200, 999)}) {digits(3)}-{digits(4)}", "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "card": lambda: digits(16),
    }
    texts, held = [], []
    for _ in range(300):
        own = [make[rnd.choice(list(make))]() for _ in range(rnd.randrange(4))]
        again = [x.split()[-1] for x in own if x[:1].isalpha() and "@" not in x]
        texts.append(", then ".join(["so", *own, *own[:1], *again, "end"]))
        held.append({w for x in own for w in (x.split()[1:] if x[:1].isalpha() and "@" not in x else [x])})
    out = {r.doc_id: r for r in pii.replaced(docs_of(spark, texts), "k").collect()}
    assert set(out) == {i for i, h in enumerate(held) if h}
    one_way = {}
    for i, r in out.items():
        left, new = texts[i].split(", then "), r.text.split(", then ")
        assert len(left) == len(new) and not any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", r.text) for w in held[i])
        for a, b in zip(left, new):
            if "@" in a or a[:1] in "+0123456789":
                assert one_way.setdefault(a, b) == b
    assert len(set(one_way.values())) == len(one_way)


def test_pii_phone_formats(spark):
    """A number keeps its calling code and layout, and has one surrogate in all formats."""
    forms = [
        "+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+49 30 12345678", "+493012345678", "+49 151 23456789", "+4915123456789",
        "+33 6 12 34 56 78", "555.123.4567", "555 123 4567", "555-123-4567",
    ]
    others = ["version 1.555.123.4567", "1 555 123 4567 8", "in 2024 100 200 of 3000"]
    out = {r.doc_id: r.text for r in pii.replaced(docs_of(spark, [f"call {x}, now" for x in forms] + others), "k").collect()}
    assert set(out) == set(range(len(forms)))
    made = [re.fullmatch("call (.*), now", out[i])[1] for i in range(len(forms))]
    digits = [re.sub(r"\D", "", x) for x in made]
    for before, after in zip(forms, made, strict=True):
        assert before != after and re.sub(r"\d", "0", before) == re.sub(r"\d", "0", after)
    assert digits[0] == digits[1] == digits[2] and digits[3] == digits[4] and digits[5] == digits[6] and digits[8] == digits[9] == digits[10]
    assert all(x.startswith("+1") for x in made[:3]) and all(x.startswith("+49") for x in made[3:7]) and made[7].startswith("+33")


def test_iban_check_digits(spark):
    """A valid number stays valid, another does not become so, and country, length and layout stay."""
    mod97 = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    good = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    bad = ["DE88370400440532013000", "GB00NWBK60161331926819", *(f"NL{i:02d}ABNA0417164300" for i in range(100) if i != 91)]
    assert [mod97(x) for x in good] == [1] * 3
    out = [r.text for r in pii.replaced(docs_of(spark, [f"to {x} now" for x in good + bad]), "k").orderBy("doc_id").collect()]
    assert len(out) == len(set(out)) == len(good + bad)
    for before, text in zip(good + bad, out, strict=True):
        m = re.fullmatch("to (.*) now", text)
        shape = lambda x: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x))
        assert m[1] != before and m[1][:2] == before[:2] and shape(m[1]) == shape(before)
        assert (mod97(m[1]) == 1) == (mod97(before) == 1)


def test_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(60)] + [("given_m_latin", f"n{i}") for i in range(40)], "kind string, norm string")
    got = pii.surrogates(entities, "k").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == len(got) == 100
    taken = {r.norm for r in got if r.kind == "ssn"}
    assert not taken & {r.surrogate for r in got if r.kind == "ssn"}


def test_toxicity():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 9)))
    texts, y = [], []
    for i in range(2400):
        w = [word() for _ in range(rnd.randint(5, 200))]
        if i % 4 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["grumble", "blockhead", "nincompoop"])
        texts.append(" ".join(w)), y.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:2000], y[:2000])
    right = sum((toxicity.logit(model, t) >= 0) == bool(k) for t, k in zip(texts[2000:], y[2000:]))
    assert right >= 0.95 * 400
    assert toxicity.logit(model, "you blockheadd there") > 0 > toxicity.logit(model, "you there") and toxicity.logit(model, None) == model.bias
    assert toxicity.logit(model, "a" * 200000) < 50


def test_toxicity_stage(spark):
    texts = ["a fine day", "you nasty fool", None, ""]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(0, 0, "x"), (1, 1, "x"), (2, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    out = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    kept = toxicity.drop_toxic(df, toxicity.train(df, labels.limit(0)))
    assert kept.count() == 4 and kept.columns == df.columns


def test_toxicity_held_out(spark):
    """Accuracy on labelled documents that no fit has seen."""
    sf = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    # A fit on 352 toxic texts; ten times as many find nine of ten (README).
    assert len(toxic) > 30 and np.mean([s >= 0.5 for s in toxic]) >= 0.6 and np.mean([s >= 0.5 for s in clean]) <= 0.03
    ranks = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert ranks >= 0.93


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Only texts within the bound reach the fit, whole; of repeated rows the shortest."""
    rows = [(i, "x" * n) for i, n in enumerate([10, 20, 5000, 30, 40, 7, 9, 3, 60, 50])] + [(i, None) for i in (20, 21)] + [(3, "y" * 900)] * 50
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, prior=None: seen.update(texts=texts, toxic=toxic))
    toxicity.train(docs, labels, toxicity.Bounds(rows=100, chars=300))
    learned = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    want = sorted((t or "", i % 2) for i, t in rows if learned(i) and len(t or "") < 900)
    assert sorted(zip(seen["texts"], seen["toxic"], strict=True)) == want
    toxicity.train(docs, labels, toxicity.Bounds(rows=100, chars=0))
    assert set(seen["texts"]) <= {""}


def visible(page):
    return [b.text for b in html_text.parse(page)[0] if not b.marked]


def test_html_fixtures():
    page = """<html><head><title>T</title></head><body><nav>menu</nav><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1>
    <p>one <b>two</b><br>three<p>four<ul><li>x<li>y</ul><aside>side</aside><div class="comments"><p>me too</p></div><script>var a="<p>";</script></article>
    <form><input></form><footer>f</footer></body></html>"""
    assert visible(page) == ["A & B", "one two three", "four", "x", "y"]
    assert visible(None) == visible("") == visible("<script>x") == []
    assert visible("plain < text > &copy;") == ["plain < text > ©"]
    assert len(html_text.parse("<p>" * 20000 + "x" * 100000)[0]) == 1


def test_html_long_attributes():
    """A quoted value may have any length; a quote without an end does not swallow or leak its tag."""
    long = "ab/+ <" * 17000
    page = f"""<body><p>one</p><img src="data:{long}"><aside data-props='{long}'>side</aside><p title="{long}">two</p></body>"""
    texts = visible
    assert texts(page) == ["one", "two"]
    assert texts('<p>one</p><p title="open>two</p><p>three</p>') == ["one", "two", "three"]
    assert texts("<p>it</p>" + "<b \"<i '" * 30000 + f"<p {'a' * 200000}>end</p>")[-1] == "end"


def test_html_names_do_not_drop_pages(spark):
    """A word of noise within a class of the page, its article or their ancestors drops nothing."""
    texts = visible
    for opened, closed in [
        ('<body class="has-sidebar">', "</body>"), ('<body class="sidebar no-comments">', "</body>"), ('<html id="nav"><body>', "</body></html>"),
        ('<body><div id="content" class="with-sidebar">', "</div></body>"), ('<body><article class="post has-comments">', "</article></body>"),
        ('<body><main class="related">', "</main></body>"), ('<body><div class="social"><article>', "</article>like us</div></body>"),
        ('<div class="banner">ad<section><div role="main">', "</div></section></div>"),
    ]:
        assert texts(f'{opened}<p>Text.</p><div class="ad">buy</div>{closed}') == ["Text."], opened
    assert texts('<div hidden><article>no</article></div><article>yes<div class="comments"><article>me too</article></div></article>') == ["yes"]
    made = lambda i: (i, "http://n.example/p", f'<body class="has-sidebar"><div class="cookie-bar">We bake.</div><div class="with-sidebar">Story {i}.</div></body>')
    df = spark.createDataFrame([made(i) for i in range(8)], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == [f"Story {i}." for i in range(8)]


def test_html_site_style_tree(spark):
    made = lambda i: (i, "http://h.example/p", f'<body><div class="top">Welcome to us</div><div class="body"><p>Story {i} of its own.</p></div></body>', 1)
    rows = [made(i) for i in range(8)] + [(90, None, None, 1), (91, "http://h.example/x", "", 1), (92, "http://other/", "<p>alone</p>", 1), (92, "http://other/", "<p>alone</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got[:8] == [(i, f"Story {i} of its own.", 19) for i in range(8)] and got[8:] == [(90, "", 0), (91, "", 0), (92, "alone", 5), (92, "alone", 5)]
    assert html_text.extract(df.limit(0)).count() == 0


def article_text(page):
    body = re.search("<article>(.*)</article>", page, re.DOTALL)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " " if "<br" in b else "", b))).strip() for b in re.split("</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_html_articles_are_whole(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    got = {r.page_id: r.text for r in queries.op8_html_text(spark, SF).collect()}
    for i, page in zip(pages.page_id, pages.html):
        assert got[i] == article_text(page)


def test_html_entropy_alone(spark):
    """Without any list of tags and names the style tree finds menus, adverts and footers: on a host of many pages, on
    small hosts by their domain, and whole branches at once; an only page keeps all that it shows."""
    rnd = random.Random(5)
    sentence = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(8))
    pool = [sentence() for _ in range(3)]

    def made(i, host):
        story = [sentence() for _ in range(rnd.randint(2, 5))]
        body = "".join(f"<p>{x}</p>" for x in story)
        menu = "".join(f"<li><a href='/{k}'>{k}</a></li>" for k in ("home", "news", "about"))
        page = f"<body><nav><ul>{menu}</ul></nav><div class='top{i}'><div>{rnd.choice(pool)}</div></div><div class='s'>{body}</div><footer><p>{pool[0]}</p></footer></body>"
        return (i, f"http://{host}/{i}", page), "\n".join(story)

    pages = [made(i, "large.example.com") for i in range(80)] + [made(100 + i, f"h{i}.example.org") for i in range(40)]
    alone = (500, "http://only.example.net/", "<nav>menu</nav><p>text</p>")
    df = spark.createDataFrame([p for p, _ in pages] + [alone], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df, marks=False).collect()}
    assert {p[0]: text for p, text in pages} | {500: "menu\ntext"} == got


def test_html_importance_brute_force(spark):
    """Importance and noise of every style node, computed page by page in plain Python."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    same = spark.createDataFrame([(1000 + i, f"http://s.example.edu/{i}", f"<body><p id='a'>all</p><div><p id='b'>{i % 4}</p><ul><li>{i}</ul>{'<i>x</i>' * (i % 3)}</div></body>") for i in range(40)], rows.schema)
    df = rows.union(same)
    parsed = html_text.sited(html_text.parsed_pages(df)).cache()
    got = {(r.site, r.node): r.importance for r in html_text.importance(parsed).collect()}
    noise = {(r.site, r.node) for r in html_text.noise_nodes(parsed).collect()}
    sites = collections.defaultdict(dict)
    for r in parsed.collect():
        page = sites[r.site].setdefault(r.page_key, (set(), set()))
        page[0].update((b.node, b.content) for b in r.blocks)
        page[1].update((t.node, tuple(t.up), t.style) for t in r.tree)
    want, low = {}, set()
    for site, by_key in sites.items():
        n, shown, styles, up = len(by_key), collections.Counter(), collections.defaultdict(collections.Counter), {}
        for blocks, tree in by_key.values():
            shown.update(blocks)
            for node, above, style in tree:
                styles[node][style] += 1
                up[node] = above
        log = lambda x, n=n: math.log(x, n) if n > 1 else 0.0
        for node in up:
            own = [k for (b, _), k in shown.items() if node == b or node in up[b]]
            if own:
                entropy = -sum(k / n * log(k / n) for k in styles[node].values())
                want[site, node] = 0.9 * sum(k * (1 - log(k)) for k in own) / sum(own) + 0.1 * min(entropy, 1)
        for node in up:
            below = [want[site, d] for d in up if (d == node or node in up[d]) and (site, d) in want]
            if below and max(below) < html_text.LOW:
                low.add((site, node))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert noise == low and len(noise) >= 2


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("Example.org", "/a/", "block"), ("example.org", "/a/b", "allow"), ("example.org", "/a/b/c", "block"), ("org", "/a/b/", "block"), ("x", None, "block"), (None, "/", "block")]
    urls = ["http://www.EXAMPLE.org/a/b/c?x", "http://example.org/a/", "http://n.org/a/b/", "http://myexample.org/a/", "no url", None, "://", "s://x", "s://y.x#f", "http://com/a"] * 2
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, "http://org/", "r")], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table).collect()}
    clean = [((h or "").lower(), p or "", a) for h, p, a in rules if h]
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), len(h), h, p, a) for h, p, a in clean if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else None
        assert got[i] == (host, path, best and best[2] + best[3], best[4] if best else "allow")
    assert got[None][2] == "org/" and url_rules.judge(pages, table.limit(0)).where("rule IS NULL").count() == 21
    assert url_rules.judge(pages.limit(0), table).count() == 0


def test_url_rules_random(spark, monkeypatch):
    """Random nested rules and urls, in sweeps of few urls, against trying every rule."""
    monkeypatch.setattr(url_rules, "SWEEP", 25)
    rnd = random.Random(3)
    label = lambda: rnd.choice(["a", "b", "ab", "a:8", "", "é"])
    host = lambda n: ".".join(label() for _ in range(n)) + rnd.choice([".x", ".y"])
    path = lambda: rnd.choice(["", "/"]) + "/".join(rnd.choice(["a", "b", "aa", "é", ""]) for _ in range(rnd.randrange(4)))
    rules = [(rnd.choice(["x", "y", host(1), host(2)]), path(), rnd.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"s://{host(rnd.randint(1, 3))}{p if p[:1] in ('', '/') else '/' + p}" for p in (path() for _ in range(400))]
    urls += ["s://x/"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"), "none").collect()}
    actions = {}
    for h, p, a in rules:
        actions[h, p] = min(a, actions.get((h, p), a))
    for i, u in enumerate(urls):
        h = re.match("[^/]*", u[4:])[0]
        fit = [(len(rh + rp), len(rh), rh, rp, a) for (rh, rp), a in actions.items() if (h == rh or h.endswith("." + rh)) and u[4 + len(h) :].startswith(rp)]
        best = max(fit) if fit else None
        assert got[i] == ((best[2] + best[3], best[4]) if best else (None, "none")), u


def test_url_sweeps_are_whole(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SWEEP", 2)
    test_url_rules(spark)


def test_pipeline_stages_brute_force(spark, tmp_path):
    """Nulls, empty texts, repeats and ties through every stage, each judged on its own input by a plain second reading."""
    rnd = random.Random(31)
    words = lambda n: [f"w{rnd.randrange(2000)}" for _ in range(n)]
    item = words(20)
    texts = [None, "", "  ", "one", "one", "Mr. John Smith wrote to a.b@example.com today, and John slept well there"]
    for _ in range(12):
        base = words(60)
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "end"])]
    texts += [" ".join(words(10) + item + words(30)), " ".join(words(30)), " ".join(words(5) + ["nincompoop"] * 3)] + [" ".join(words(12)) + " nincompoop " * 4 for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (3, "another text under three", "en", "s", 5), (None, "no id here", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("nincompoop" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = near_dup.materialize(stages["toxicity"](spark, docs, str(tmp_path)), "kept")
    assert plain(kept) == sorted(((i, t) for i, t, *_ in rows if toxicity.logit(model, t) < 0), key=repr)
    assert kept.columns == docs.columns and 30 < kept.count() < len(rows)

    before = plain(kept)
    kept = near_dup.materialize(stages["near_dedup"](spark, kept, str(tmp_path)), "kept")
    known = sorted({x for x in before if x[0] is not None}, key=lambda x: x[0])
    root, _ = components([t for _, t in known], 80)
    least = {x: known[r][0] for x, r in zip(known, root)}
    assert plain(kept) == [x for x in before if x[0] is None or least[x] == x[0]] and kept.columns == docs.columns

    before = plain(kept)
    kept = near_dup.materialize(stages["decontamination"](spark, kept, str(tmp_path)), "kept")
    own = shingled(" ".join(item))
    dirty = lambda t: 100 * len(own & shingled(t)) >= 80 * len(own)
    assert plain(kept) == [x for x in before if x[0] is None or not dirty(x[1])] and len(before) > kept.count() and kept.columns == docs.columns

    before = dict.fromkeys(plain(kept))
    kept = near_dup.materialize(stages["pii"](spark, kept, str(tmp_path)), "kept")
    changed = [x for x in plain(kept) if x not in before]
    assert len(changed) == 1 and changed[0][0] == 5 and not re.search("John|Smith|a.b@", changed[0][1]) and kept.columns == docs.columns

    last = stages["sentencepiece"](spark, kept, str(tmp_path))
    back = {(r.doc_id, r.text) for r in sentencepiece.decode(last, MODEL).collect()}
    assert back == {(i, t or "") for i, t in plain(kept)} and last.count() == kept.count()


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and 0 < got.count() < docs.count()
