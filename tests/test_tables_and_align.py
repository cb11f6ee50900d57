import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessel.operators import align, generate
from tessel.sources import shared, tables


def test_submission_bytes(spark, tmp_path):
    rows = [("T_0", 'a,"b"'), ("T_1", " x\ny "), ("T_2", "미응답")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, ID string, Answer string")
    tables.write_submission(df, str(tmp_path / "out"), "i")
    (part,) = (tmp_path / "out").glob("part-*")
    pd.DataFrame(rows, columns=["ID", "Answer"]).to_csv(tmp_path / "want.csv", index=False, encoding="utf-8-sig")
    assert part.read_bytes() == (tmp_path / "want.csv").read_bytes()


@pytest.mark.parametrize("sep", ["\n", "\r\n"])
def test_multi_line_questions(spark, tmp_path, sep):
    path = tmp_path / "q.csv"
    path.write_bytes(("﻿Question" + sep + '"a\n1 x, ""y"""' + sep + "plain" + sep).encode())
    got = [r.Question for r in tables.read_questions(spark, str(path), sep).orderBy("row_idx").collect()]
    assert got == ['a\n1 x, "y"', "plain"]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 20])
def test_ordinals_and_batches(spark, n):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("k")).repartition(3)
    out = align.with_ordinal(df, "k").withColumn("b", align.batch_id(F.col("row_idx"))).orderBy("k").collect()
    assert [(r.row_idx, r.b) for r in out] == [(i, i // 8) for i in range(n)]


def test_alignment_needs_equal_lengths(spark):
    a, b = (spark.range(n).withColumnRenamed("id", "row_idx") for n in (3, 4))
    assert align.positional_join(a, a).count() == 3
    with pytest.raises(ValueError):
        align.positional_join(a, b)


def test_alignment_needs_equal_positions(spark):
    """As many rows at other positions, or a position twice, lose nothing silently."""
    a = spark.range(6).withColumnRenamed("id", "row_idx")
    for other in ([0, 1, 2, 8589934592, 8589934593, 8589934594], [0, 1, 2, 3, 4, 4]):
        with pytest.raises(ValueError):
            align.positional_join(a, spark.createDataFrame([(i,) for i in other], "row_idx long"))


def test_positions_over_several_files(spark, tmp_path):
    for name, rows in (("b", "four,five\n"), ("a", '"one\n1 x"\ntwo\nthree\n' * 50)):
        (tmp_path / f"{name}.csv").write_text("Question\n" + rows)
    got = [(r.row_idx, r.Question) for r in tables.read_questions(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], "\n").orderBy("row_idx").collect()]
    want = ["one\n1 x", "two", "three"] * 50 + ["four"]
    assert got == list(enumerate(want))
    template = spark.createDataFrame([(i, f"T{i}") for i in range(151)], "row_idx long, ID string")
    assert align.positional_join(template, tables.read_questions(spark, str(tmp_path / "*.csv"), "\n")).count() == 151


def test_ordinals_keep_columns(spark):
    df = spark.createDataFrame([(2, "x", 1, 0), (1, "y", 3, 0)], "k long, __part string, __at long, __start long")
    assert [tuple(r) for r in align.with_ordinal(df, "k").orderBy("row_idx").collect()] == [(1, "y", 3, 0, 0), (2, "x", 1, 0, 1)]


class Fake:
    """Stands for the model libraries and records what is asked of them."""

    float16, bfloat16 = "half", "brain"

    def __init__(self):
        self.seen = {}
        self.AutoModelForCausalLM = self.AutoTokenizer = self

    def from_pretrained(self, name, **options):
        self.seen.setdefault(name, []).append(options)
        return name

    def BitsAndBytesConfig(self, **options):  # noqa: N802
        return options

    def pipeline(self, task, model, tokenizer):
        assert (task, model) == ("text-generation", tokenizer)
        return lambda texts, **how: [[{"generated_text": f"{t}|{how['max_new_tokens']}|{how['batch_size']}"}] for t in texts]


def test_model_settings():
    for four_bit in (False, True):
        fake = Fake()
        run = generate.text_model(generate.Model("m", "bfloat16", "cpu", "/cache", four_bit), lambda _: fake)()
        assert run(["a", "b"], generate.BATCH) == ["a|128|8", "b|128|8"] and run(["a"], generate.ROW) == ["a|256|1"]
        weights, words = fake.seen["m"]
        assert words == {"cache_dir": "/cache"} and weights["torch_dtype"] == "brain" and weights["device_map"] == "cpu"
        assert weights.get("quantization_config") == ({"load_in_4bit": True, "bnb_4bit_compute_dtype": "brain"} if four_bit else None)


def test_load_errors_fail_the_task(spark):
    def broken():
        raise OSError("no such model")

    df = spark.createDataFrame([("a",)], "p string")
    with pytest.raises(Exception, match="no such model"):
        df.select(generate.generator(broken)(F.col("p"))).collect()


def test_remove_keeps_other_files(spark, tmp_path):
    path = tmp_path / "tessel" / "mine"
    spark.range(3).write.parquet(str(path))
    shared.remove(spark.read.parquet(str(path)))
    assert path.exists()
    own = shared.materialize(spark.range(3), "own")
    (folder,) = {f.rsplit("/", 1)[0] for f in own.inputFiles()}
    shared.remove(own)
    assert not os.path.exists(folder.removeprefix("file:").replace("///", "/"))


def test_generator_runs_once(spark):
    model = generate.generator(generate.load_stub)
    df = spark.createDataFrame([("ab",), ("abc",)], "p string").withColumn("g", model(F.col("p"))).where(F.length("g") > 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.g for r in df.collect()) == ["ab 정답은 2번", "abc 정답은 3번"]
