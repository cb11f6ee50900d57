"""Named queries over the test tables with the SQL that DuckDB runs beside them.

No test text holds option lines, so most queries derive a question: for keys
divisible by three the text itself, else the text and four more lines, three of
which are options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessel.functions import textops as X
from tessel.operators import align, answers, generate, parse, prompts
from tessel.plans import answering
from tessel.sources import shared, tables
from tessel.streaming import answering as streaming

EXTRA = "\n1 alpha\n 2 beta\n3\tgamma\n4. delta"
ESCAPED = prompts.Template(escaped=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def asked(df: DataFrame, key: str) -> DataFrame:
    """(key, q): the derived question."""
    return df.select(key, F.when(F.col(key) % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(EXTRA))).alias("q"))


def stub(key: str) -> Column:
    """A generation that covers the numbers 0 to 12."""
    return F.concat(F.col("p"), F.lit(" 정답은 "), (F.col(key) % 13).cast("string"), F.lit("번"))


def option_count(spark, d):
    q = F.col("q")
    return asked(read(spark, d, "documents"), "doc_id").select(
        "doc_id", parse.option_count(q).cast("long").alias("n_options"), parse.is_multiple_choice(q).alias("is_mc")
    )


def option_count_conversations(spark, d):
    t = F.col("text")
    return read(spark, d, "conversations").select(
        "conv_id", "turn", parse.option_count(t).cast("long").alias("n_options"), parse.is_multiple_choice(t).alias("is_mc")
    )


def option_lines_exploded(spark, d):
    lines = parse.option_lines(asked(read(spark, d, "documents"), "doc_id"), "doc_id", "q")
    return lines.groupBy("doc_id").agg(
        F.count_if("is_option").alias("n_options"), F.count_if(~F.col("is_option")).alias("n_stem_lines")
    )


def _parts() -> prompts.Parsed:
    """The columns of `parse.with_question`."""
    return prompts.Parsed(F.col("is_mc"), F.col("question"), F.col("options"))


def _split(table: str, key: str):
    def query(spark, d):
        return parse.with_question(asked(read(spark, d, table), key), "q").select(key, "question", F.array_join("options", "|").alias("options"))

    return query


def _prompt(strategy: str, template: prompts.Template):
    def query(spark, d):
        df = parse.with_question(asked(read(spark, d, "benchmark"), "item_id"), "q")
        return df.select("item_id", prompts.prompt(F.col("q"), strategy, template, _parts()).alias("prompt"))

    return query


def prompt_preview(spark, d):
    df = parse.with_question(asked(read(spark, d, "documents"), "doc_id"), "q")
    return df.select("doc_id", prompts.preview(F.col("q"), parsed=_parts()).alias("preview"))


def question_projection(spark, d):
    return read(spark, d, "benchmark").select(F.col("text").alias("question"))


def row_ordinal(spark, d):
    df = align.with_ordinal(read(spark, d, "benchmark").select("item_id"), "item_id")
    return df.select("item_id", (F.col("row_idx") + 1).alias("row_no"))


def batch_assignment(spark, d):
    df = align.with_ordinal(read(spark, d, "benchmark").select("item_id"), "item_id")
    return df.select("item_id", align.batch_id(F.col("row_idx")).alias("batch_id"))


def _generated(spark, d):
    df = parse.with_question(asked(read(spark, d, "documents"), "doc_id"), "q").withColumn("p", prompts.prompt(F.col("q"), parsed=_parts()))
    return df.withColumn("g", stub("doc_id"))


def extract_v2(spark, d):
    return answers.with_answer(_generated(spark, d), "g", "is_mc", "p").select("doc_id", "answer")


def extract_v1(spark, d):
    return _generated(spark, d).select("doc_id", answers.extract_keeping_prompt(F.col("g"), F.col("is_mc")).alias("answer"))


def extract_first_option(spark, d):
    return _generated(spark, d).select(
        "doc_id", answers.extract_or_first_option(F.concat("p", F.lit(" 모름")), F.col("is_mc"), F.col("options")).alias("answer")
    )


def extract_conversations(spark, d):
    df = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("앞 답변: "), "text").alias("g"))
    return df.select("conv_id", "turn", answers.extract(F.col("g"), F.lit(False), F.lit("")).alias("answer"))


def first_generation(spark, d):
    df = asked(read(spark, d, "documents"), "doc_id").withColumn("p", F.col("q"))
    listed = df.withColumn("out", F.array(F.struct(stub("doc_id").alias("generated_text"))))
    return listed.select("doc_id", answers.first_generation(F.col("out")).alias("generated"))


def positional_submission(spark, d):
    items = align.with_ordinal(asked(read(spark, d, "benchmark"), "item_id"), "item_id")
    template = items.select("row_idx", F.concat(F.lit("TEST_"), F.lpad(F.col("row_idx").cast("string"), 6, "0")).alias("ID"))
    answered = answering.answer(items, "q", lambda p: F.concat(p, F.lit(" 정답은 "), (F.col("item_id") % 13).cast("string"), F.lit("번")))
    return answering.submission(template, answered).select("ID", "Answer")


def input_count(spark, d):
    return read(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))


def answer_count(spark, d):
    return extract_v2(spark, d).agg(F.count("answer").alias("n"))


def _generate(strategy: str, decoding: generate.Decoding):
    def query(spark, d):
        model = generate.generator(generate.load_stub, decoding)
        df = parse.with_question(asked(read(spark, d, "benchmark"), "item_id"), "q")
        return df.select("item_id", model(prompts.prompt(F.col("q"), strategy, parsed=_parts())).alias("generated"))

    return query


def observed_counts(spark, d):
    """Questions and answers, counted by the job that writes the answers."""
    seen = Observation("counts")
    df = asked(read(spark, d, "documents"), "doc_id")
    out = answering.answer(df, "q", lambda p: F.concat(p, F.lit(" 정답은 "), (F.col("doc_id") % 13).cast("string"), F.lit("번")), observation=seen)
    out.select("doc_id", "answer").write.parquet(shared.new_path(spark, "answers"))
    return spark.createDataFrame([(seen.get["n_questions"], seen.get["n_answers"])], "n_questions long, n_answers long")


def questions_scan(spark, d):
    """Two question files with cells of several lines, read as one table of positions."""
    path = shared.new_path(spark, "questions")
    df = asked(read(spark, d, "benchmark"), "item_id")
    for name, half in (("a", F.col("item_id") % 2 == 0), ("b", F.col("item_id") % 2 == 1)):
        tables.write_questions(df.where(half).withColumnRenamed("q", "Question"), f"{path}/{name}", "item_id")
    return tables.read_questions(spark, [f"{path}/a", f"{path}/b"])


def answer_pipeline(spark, d):
    df = asked(read(spark, d, "documents"), "doc_id")
    out = answering.answer(df, "q", lambda p: F.concat(p, F.lit(" 정답은 "), (F.col("doc_id") % 13).cast("string"), F.lit("번")))
    return out.select("doc_id", "n_options", F.array_join("options", "|").alias("options"), "question", "answer")


def csv_round_trip(spark, d):
    path = shared.new_path(spark, "submission")
    df = read(spark, d, "benchmark").select("item_id", F.concat(F.lit(' "'), "text", F.lit('", \n ')).alias("Answer"))
    tables.write_submission(df.select("item_id", F.col("item_id").cast("string").alias("ID"), "Answer"), path, "item_id")
    return tables.read_csv(spark, path, tables.SUBMISSION)


def answer_stream(spark, d):
    path = shared.new_path(spark, "stream")
    source = read(spark, d, "benchmark")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/benchmark*.parquet")
    out = streaming.answer_stream(asked(stream, "item_id"), "q", lambda p: F.concat(p, F.lit(" 정답은 7번")))
    return streaming.run_available(spark, out.select("item_id", "answer"), f"{path}/out", f"{path}/state")


QUERIES = {
    "answer_pipeline": answer_pipeline,
    "option_count": option_count,
    "option_count_conversations": option_count_conversations,
    "option_lines_exploded": option_lines_exploded,
    "question_projection": question_projection,
    "question_and_options": _split("documents", "doc_id"),
    "question_and_options_benchmark": _split("benchmark", "item_id"),
    "prompt_zero_shot": _prompt("zero_shot", prompts.Template()),
    "prompt_few_shot": _prompt("few_shot", prompts.Template()),
    "prompt_few_shot_escaped": _prompt("few_shot", ESCAPED),
    "prompt_zero_shot_legacy": _prompt("zero_shot_legacy", prompts.Template()),
    "prompt_zero_shot_legacy_escaped": _prompt("zero_shot_legacy", ESCAPED),
    "prompt_preview": prompt_preview,
    "row_ordinal": row_ordinal,
    "batch_assignment": batch_assignment,
    "extract_v2": extract_v2,
    "extract_v1": extract_v1,
    "extract_first_option": extract_first_option,
    "extract_conversations": extract_conversations,
    "first_generation": first_generation,
    "positional_submission": positional_submission,
    "input_count": input_count,
    "answer_count": answer_count,
    "generate_batched": _generate("few_shot", generate.BATCH),
    "generate_rows": _generate("few_shot", generate.ROW),
    "generate_zero_shot": _generate("zero_shot_legacy", generate.BATCH),
    "observed_counts": observed_counts,
    "questions_scan": questions_scan,
    "csv_round_trip": csv_round_trip,
    "answer_stream": answer_stream,
}

# ---- the same in SQL -------------------------------------------------------

# The Unicode white space characters.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_IS = f"regexp_matches(x, '^{WS}*[1-9][0-9]?{WS}')"


def _q(table: str, key: str, more: str = "") -> str:
    """CTE p: key, q, opts (list), mc, stem."""
    return (
        f"WITH a AS (SELECT {key}, {more}CASE WHEN {key} % 3 = 0 THEN text ELSE text || chr(10) || '1 alpha' || chr(10) || ' 2 beta' || chr(10) || '3' || chr(9) || 'gamma' || chr(10) || '4. delta' END AS q FROM {table}), "
        f"b AS (SELECT *, string_split({_strip('q')}, chr(10)) AS ls FROM a), "
        f"p AS (SELECT *, list_transform(list_filter(ls, lambda x: {_IS}), lambda x: {_strip('x')}) AS opts, "
        f"array_to_string(list_transform(list_filter(ls, lambda x: NOT {_IS}), lambda x: {_strip('x')}), ' ') AS stem FROM b) "
    )


def _prompt_sql(strategy: str, t: prompts.Template) -> str:
    n = "\n"
    opts = "array_to_string(opts, chr(10))"
    if strategy == "few_shot":
        m = t.newline
        head, free_head = f"{t.role}{m}{t.choose}{m}{m}{t.examples}{m}{m}질문: ", f"{t.role}{m}{t.step_by_step}{m}{m}질문: "
        mid, end, free_end = f"{m}선택지:{m}", f"{m}{m}답변:", f"{m}{m}생각 과정:"
    else:
        between = t.newline if strategy == "zero_shot_legacy" else f"{n}{n}지시: "
        head, free_head = f"{t.role}{between}{t.choose}{n}{n}질문: ", f"{t.role}{between}{t.explain}{n}{n}질문: "
        mid, end = f"{n}선택지:{n}", f"{n}{n}답변:"
        free_end = end
    return f"CASE WHEN len(opts) >= 2 THEN {_lit(head)} || stem || {_lit(mid)} || {opts} || {_lit(end)} ELSE {_lit(free_head)} || q || {_lit(free_end)} END"


def _final_sql(text: str, fallback: str = "'0'") -> str:
    body = _strip(f"string_split({text}, '답변:')[-1]")
    number = f"regexp_extract({body}, '^[^\\p{{Nd}}]*([1-9][0-9]?)', 1)"
    return f"CASE WHEN {body} = '' THEN '미응답' WHEN len(opts) >= 2 THEN CASE WHEN {number} = '' THEN {fallback} ELSE {number} END ELSE {body} END"


_FEW = _prompt_sql("few_shot", prompts.Template())
_DOC_Q, _ITEM_Q = _q("documents", "doc_id"), _q("benchmark", "item_id")
_DOC_P = f"{_DOC_Q}, g AS (SELECT *, {_FEW} AS pr FROM p) "
_NO_PREFIX = _strip("' 정답은 ' || (doc_id % 13)::VARCHAR || '번'")
_EXTRACT = f"SELECT doc_id, {_final_sql(_NO_PREFIX)} AS answer FROM g"

ORACLE_SQL = {
    "option_count": f"{_DOC_Q} SELECT doc_id, len(opts)::BIGINT AS n_options, len(opts) >= 2 AS is_mc FROM p",
    "option_count_conversations": f"WITH b AS (SELECT conv_id, turn, list_filter(string_split({_strip('text')}, chr(10)), lambda x: {_IS}) AS o FROM conversations) SELECT conv_id, turn, len(o)::BIGINT AS n_options, len(o) >= 2 AS is_mc FROM b",
    "option_lines_exploded": f"{_DOC_Q}, l AS (SELECT doc_id, unnest(ls) AS x FROM p) SELECT doc_id, count(*) FILTER ({_IS}) AS n_options, count(*) FILTER (NOT {_IS}) AS n_stem_lines FROM l GROUP BY doc_id",
    "question_projection": "SELECT text AS question FROM benchmark",
    "question_and_options": f"{_DOC_Q} SELECT doc_id, stem AS question, array_to_string(opts, '|') AS options FROM p",
    "question_and_options_benchmark": f"{_ITEM_Q} SELECT item_id, stem AS question, array_to_string(opts, '|') AS options FROM p",
    "prompt_zero_shot": f"{_ITEM_Q} SELECT item_id, {_prompt_sql('zero_shot', prompts.Template())} AS prompt FROM p",
    "prompt_few_shot": f"{_ITEM_Q} SELECT item_id, {_FEW} AS prompt FROM p",
    "prompt_few_shot_escaped": f"{_ITEM_Q} SELECT item_id, {_prompt_sql('few_shot', ESCAPED)} AS prompt FROM p",
    "prompt_zero_shot_legacy": f"{_ITEM_Q} SELECT item_id, {_prompt_sql('zero_shot_legacy', prompts.Template())} AS prompt FROM p",
    "prompt_zero_shot_legacy_escaped": f"{_ITEM_Q} SELECT item_id, {_prompt_sql('zero_shot_legacy', ESCAPED)} AS prompt FROM p",
    "prompt_preview": f"{_DOC_P} SELECT doc_id, pr[1:100] AS preview FROM g",
    "row_ordinal": "SELECT item_id, row_number() OVER (ORDER BY item_id) AS row_no FROM benchmark",
    "batch_assignment": "SELECT item_id, ((row_number() OVER (ORDER BY item_id) - 1) // 8)::BIGINT AS batch_id FROM benchmark",
    "extract_v2": f"{_DOC_P} {_EXTRACT}",
    "extract_v1": f"{_DOC_P}, h AS (SELECT *, {_strip("pr || ' 정답은 ' || (doc_id % 13)::VARCHAR || '번'")} AS t FROM g) SELECT doc_id, {_final_sql('t')} AS answer FROM h",
    "extract_first_option": f"{_DOC_P}, h AS (SELECT *, {_strip("pr || ' 모름'")} AS t FROM g) SELECT doc_id, {_final_sql('t', 'opts[1]')} AS answer FROM h",
    "extract_conversations": f"WITH b AS (SELECT conv_id, turn, {_strip("string_split('앞 답변: ' || text, '답변:')[-1]")} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' THEN '미응답' ELSE t END AS answer FROM b",
    "first_generation": f"{_DOC_Q} SELECT doc_id, q || ' 정답은 ' || (doc_id % 13)::VARCHAR || '번' AS generated FROM p",
    "positional_submission": f"{_q('benchmark', 'item_id')} SELECT 'TEST_' || lpad((row_number() OVER (ORDER BY item_id) - 1)::VARCHAR, 6, '0') AS ID, {_final_sql("' 정답은 ' || (item_id % 13)::VARCHAR || '번'")} AS Answer FROM p",
    "input_count": "SELECT count(*) AS n FROM documents",
    "answer_count": f"{_DOC_P}, e AS ({_EXTRACT}) SELECT count(answer) AS n FROM e",
    "generate_batched": f"{_ITEM_Q}, g AS (SELECT item_id, {_FEW} AS pr FROM p) SELECT item_id, pr || ' 정답은 ' || (length(pr) % 13)::VARCHAR || '번' AS generated FROM g",
    "generate_rows": f"{_ITEM_Q}, g AS (SELECT item_id, {_FEW} AS pr FROM p) SELECT item_id, pr || ' 정답은 ' || (length(pr) % 13)::VARCHAR || '번' AS generated FROM g",
    "generate_zero_shot": f"{_ITEM_Q}, g AS (SELECT item_id, {_prompt_sql('zero_shot_legacy', prompts.Template())} AS pr FROM p) SELECT item_id, pr || ' 정답은 ' || (length(pr) % 13)::VARCHAR || '번' AS generated FROM g",
    "observed_counts": "SELECT count(*) AS n_questions, count(*) AS n_answers FROM documents",
    "questions_scan": f"{_ITEM_Q} SELECT row_number() OVER (ORDER BY item_id % 2, item_id) - 1 AS row_idx, q AS Question FROM p",
    "answer_pipeline": f"{_DOC_P} SELECT doc_id, len(opts)::BIGINT AS n_options, array_to_string(opts, '|') AS options, stem AS question, {_final_sql(_NO_PREFIX)} AS answer FROM g",
    "csv_round_trip": "SELECT item_id::VARCHAR AS ID, ' \"' || text || '\", ' || chr(10) || ' ' AS Answer FROM benchmark",
    "answer_stream": f"{_ITEM_Q} SELECT item_id, {_final_sql("' 정답은 7번'")} AS answer FROM p",
}
