"""Take the final answer out of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import textops as X
from tessel.functions.columns import let, unused
from tessel.operators import prompts

# Fixed values.
NO_ANSWER = "미응답"
NO_NUMBER = "0"


def _body(text: Column) -> Column:
    return X.strip(X.after_last(text, prompts.ANSWER))


def _choice(body: Column, multiple_choice: Column, fallback: Column) -> Column:
    number = F.regexp_extract(body, X.LEADING_NUMBER, 1)
    chosen = F.when(multiple_choice, F.coalesce(F.nullif(number, F.lit("")), fallback)).otherwise(body)
    return F.when(body == "", F.lit(NO_ANSWER)).when(body.isNotNull(), chosen)


def extract(generated: Column, multiple_choice: Column, prompt: Column) -> Column:
    """Drop an echoed prompt, keep what follows the last answer marker, then the
    first number (multiple choice; `0` without one) or the text itself. Null gives null."""
    return let(_body(X.strip(X.without_prefix(generated, prompt))), lambda b: _choice(b, multiple_choice, F.lit(NO_NUMBER)))


def extract_keeping_prompt(generated: Column, multiple_choice: Column) -> Column:
    """Older mode: an echoed prompt without an answer marker stays in the answer."""
    return let(_body(generated), lambda b: _choice(b, multiple_choice, F.lit(NO_NUMBER)))


def extract_or_first_option(generated: Column, multiple_choice: Column, options: Column) -> Column:
    """Oldest mode: without a number the first option's text is the answer."""
    first = F.coalesce(F.get(options, F.lit(0)), F.lit(NO_ANSWER))
    return let(_body(generated), lambda b: _choice(b, multiple_choice, first))


def with_answer(df: DataFrame, generated: str, multiple_choice: str, prompt: str, name: str = "answer") -> DataFrame:
    """`df` with the answer in column `name`, as `extract` gives it; the text is cut once, in generated code."""
    body = unused(df.columns, "__body")
    cut = df.withColumn(body, _body(X.strip(X.without_prefix(F.col(generated), F.col(prompt)))))
    return cut.withColumn(name, _choice(F.col(body), F.col(multiple_choice), F.lit(NO_NUMBER))).drop(body)


def first_generation(generations: Column) -> Column:
    """`generated_text` of the first element of a list of generations."""
    return F.element_at(generations, 1)["generated_text"]
