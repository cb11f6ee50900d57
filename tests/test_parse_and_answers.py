import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import answers, generate, parse, prompts
from tessel.plans.answering import answer

SPLIT = [
    ["q?\n1 a\n2 b", 2, "q?", ["1 a", "2 b"]],
    ["q?\n1. a\n2. b", 0, "q? 1. a 2. b", []],
    ["q?\n1) a\n2) b", 0, "q? 1) a 2) b", []],
    ["q?\n1 a", 1, "q?", ["1 a"]],
    ["q\n\n1 a\n2 b", 2, "q ", ["1 a", "2 b"]],
    ["q\n1\n2\n3", 0, "q 1 2 3", []],
    ["q\n1 \n2 ", 1, "q 2", ["1"]],
    ["q\n 10 a\n\t11 b", 2, "q", ["10 a", "11 b"]],
    ["q\n100 a\n200 b", 0, "q 100 a 200 b", []],
    ["q\n0 a\n01 b", 0, "q 0 a 01 b", []],
    ["q\r\n1 a\r\n2 b", 2, "q", ["1 a", "2 b"]],
    ["q\n　1 a\n　2 b", 2, "q", ["1 a", "2 b"]],
    ["q\n１ a\n２ b", 0, "q １ a ２ b", []],
    ["2 items\n3 more\nwhich?", 2, "which?", ["2 items", "3 more"]],
    ["1 a 2 b", 1, "", ["1 a 2 b"]],
    ["q\n1 a\n2 b\ntail", 2, "q tail", ["1 a", "2 b"]],
    ["", 0, "", []],
    ["  \n ", 0, "", []],
    ["q\n1\ta\n2　b", 2, "q", ["1\ta", "2　b"]],
]
ANSWERS = [
    ["P답변: 3", True, "P답변:", "3", "3"],
    ["P답변:", True, "P답변:", "미응답", "미응답"],
    ["P답변: 정답은 2번", True, "P답변:", "2", "2"],
    ["P답변: 12345", True, "P답변:", "12", "12"],
    ["P답변: 0", True, "P답변:", "0", "0"],
    ["P답변: 05", True, "P답변:", "0", "0"],
    ["P답변: 없음", True, "P답변:", "0", "0"],
    ["P답변: １ 3", True, "P답변:", "0", "0"],
    ["P생각 과정: 2", False, "P생각 과정:", "2", "P생각 과정: 2"],
    ["P답변: 1\n\n질문: x\n답변: 4", True, "P답변:", "4", "4"],
    ["P생각 과정: 설명", False, "P생각 과정:", "설명", "P생각 과정: 설명"],
    ["P생각 과정: a\n답변: b ", False, "P생각 과정:", "b", "b"],
    ["no prefix 7", True, "P답변:", "7", "7"],
    ["P답변: a\nb 3", True, "P답변:", "3", "3"],
    ["P생각 과정:   ", False, "P생각 과정:", "미응답", "P생각 과정:"],
    ["P답변: 3 답변:", True, "P답변:", "미응답", "미응답"],
]


def plain(text):
    """A scanner, character by character: (options, stem, option texts)."""
    rows, row = [], []
    for c in text + "\n":
        if c == "\n":
            rows.append(row)
            row = []
        else:
            row.append(c)
    while rows and all(c.isspace() for c in rows[0]):
        rows.pop(0)
    while rows and all(c.isspace() for c in rows[-1]):
        rows.pop()
    if rows:  # a number that ends the text is followed by nothing
        while rows[-1][-1].isspace():
            rows[-1].pop()
    stem, chosen = [], []
    for row in rows or [[]]:
        i = 0
        while i < len(row) and row[i].isspace():
            i += 1
        j = i
        while j < len(row) and row[j] in "0123456789":
            j += 1
        option = 1 <= j - i <= 2 and row[i] != "0" and j < len(row) and row[j].isspace()
        end = len(row)
        while end > i and row[end - 1].isspace():
            end -= 1
        (chosen if option else stem).append("".join(row[i:end]))
    return len(chosen), " ".join(stem), chosen


def test_split_golden(spark):
    df = parse.with_question(spark.createDataFrame([(r[0],) for r in SPLIT], "t string"), "t")
    got = [[r.t, r.n_options, r.question, r.options] for r in df.collect()]
    assert got == SPLIT


def test_split_random(spark):
    rnd = random.Random(5)
    alphabet = "ab12 0\n\t\r　\x1c\x85가.１"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    df = parse.with_question(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    for r in df.collect():
        assert (r.n_options, r.question, r.options) == plain(r.t)


def test_exploded_lines_agree(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(SPLIT)], "k int, t string")
    counts = {r.k: r.n for r in parse.option_lines(df, "k", "t").groupBy("k").agg(F.count_if("is_option").alias("n")).collect()}
    assert counts == {i: r[1] for i, r in enumerate(SPLIT)}


def test_answers_golden(spark):
    df = spark.createDataFrame(ANSWERS, "g string, mc boolean, p string, v2 string, v1 string")
    out = answers.with_answer(df, "g", "mc", "p", "c").select(
        "v2", "v1", "c", answers.extract(F.col("g"), F.col("mc"), F.col("p")).alias("a"), answers.extract_keeping_prompt(F.col("g"), F.col("mc")).alias("b")
    )
    for r in out.collect():
        assert (r.a, r.b, r.c) == (r.v2, r.v1, r.v2)


def test_first_option_mode(spark):
    df = spark.createDataFrame([("답변: none", "q\n1 a\n2 b", "1 a"), ("답변: 2", "q\n1 a\n2 b", "2")], "g string, q string, want string")
    out = df.select("want", answers.extract_or_first_option(F.col("g"), parse.is_multiple_choice(F.col("q")), parse.options(F.col("q"))).alias("a"))
    assert all(r.a == r.want for r in out.collect())


def test_escaped_separators(spark):
    df = spark.createDataFrame([("q\n1 a\n2 b",), ("open?",)], "t string")
    for escaped in (False, True):
        t = prompts.Template(escaped=escaped)
        mc, free = (r.p for r in df.select(prompts.prompt(F.col("t"), "few_shot", t).alias("p")).collect())
        assert mc.endswith(f"1 a\n2 b{t.newline * 2}답변:") and free.endswith(f"open?{t.newline * 2}생각 과정:")


def test_prompt_layouts(spark):
    """Each layout written out; the first characters alone are the same."""
    df = spark.createDataFrame([("q\n1 a\n2 b",), ("open?",)], "t string")
    for n, escaped in (("\n", False), ("\\n", True)):
        t = prompts.Template("R", "C", "E", "S", "X", "I: ", escaped)
        want = {
            "zero_shot": ["R\n\nI: C\n\n질문: q\n선택지:\n1 a\n2 b\n\n답변:", "R\n\nI: E\n\n질문: open?\n\n답변:"],
            "zero_shot_legacy": [f"R{n}C\n\n질문: q\n선택지:\n1 a\n2 b\n\n답변:", f"R{n}E\n\n질문: open?\n\n답변:"],
            "few_shot": [f"R{n}C{n}{n}X{n}{n}질문: q{n}선택지:{n}1 a\n2 b{n}{n}답변:", f"R{n}S{n}{n}질문: open?{n}{n}생각 과정:"],
        }
        for strategy, both in want.items():
            short = {f"p{k}": prompts.preview(F.col("t"), k, strategy, t) for k in (1, 2, 9, 20, 100)}
            rows = df.select(prompts.prompt(F.col("t"), strategy, t).alias("p"), *(c.alias(k) for k, c in short.items())).collect()
            assert [r.p for r in rows] == both
            assert all(r[f"p{k}"] == r.p[:k] for r in rows for k in (1, 2, 9, 20, 100))


def test_null_question(spark):
    """Null in, null out: nothing is generated from a null question unless it raises."""
    df = spark.createDataFrame([(None,), ("q",)], "t string")
    model = generate.generator(generate.load_stub)
    with pytest.raises(Exception, match="question is null"):
        answer(df, "t", model).collect()
    out = answer(df, "t", model, strict=False).collect()
    assert [(r.prompt is None, r.generated is None, r.answer is None) for r in sorted(out, key=lambda r: r.t or "")] == [(True,) * 3, (False,) * 3]


def test_working_columns_do_not_clash(spark):
    df = spark.createDataFrame([("q\n1 a\n2 b", 1, 2, 3)], "t string, __lines int, __asked int, __body int")
    r = answer(df, "t", lambda p: F.concat(p, F.lit(" 2"))).first()
    assert (r["__lines"], r["__asked"], r["__body"], r.answer) == (1, 2, 3, "2")
