"""The whole flow: questions, prompts, generations, answers, submission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessel.operators import align, answers, parse, prompts


def answer(
    questions: DataFrame,
    text: str,
    generate: Callable[[Column], Column],
    strategy: str = prompts.DEFAULT_STRATEGY,
    template: prompts.Template = prompts.Template(),
    strict: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Adds n_options, is_mc, question, options, prompt, generated and answer.

    Rows keep their identity, so each answer is read with its own question. With strict=False a
    null question has a null prompt, generation and answer. `observation` counts questions and
    answers (n_questions, n_answers) while whatever job reads the result.
    """
    parts = prompts.Parsed(F.col("is_mc"), F.col("question"), F.col("options"))
    parsed = parse.with_question(questions, text, strict)
    prompted = parsed.withColumn("prompt", prompts.prompt(F.col(text), strategy, template, parts))
    out = answers.with_answer(prompted.withColumn("generated", generate(F.col("prompt"))), "generated", "is_mc", "prompt")
    if observation:
        out = out.observe(observation, F.count(F.lit(1)).alias("n_questions"), F.count("answer").alias("n_answers"))
    return out


def submission(template: DataFrame, answered: DataFrame, idx: str = "row_idx") -> DataFrame:
    """The template (idx, ID, Answer) with its answers replaced by those of the same position."""
    return align.positional_join(template.select(idx, "ID"), answered.select(idx, F.col("answer").alias("Answer")), idx)
