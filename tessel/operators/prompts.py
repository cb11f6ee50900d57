"""Prompt templates as Column builders.

The wording is configuration and may be replaced; the four markers are not,
because answer extraction looks for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import textops as X
from tessel.operators import parse

# The markers.
QUESTION = "질문:"
CHOICES = "선택지:"
ANSWER = "답변:"
REASONING = "생각 과정:"


@dataclass(frozen=True)
class Template:
    """Texts around a question. `escaped` writes separators as backslash and n; `order` stands before a zero-shot instruction."""

    role: str = "다음은 시험 문제입니다. 한국어로 답하십시오."
    choose: str = "정답인 보기의 번호 하나만 쓰십시오."
    explain: str = "핵심을 짧고 정확하게 설명하십시오."
    step_by_step: str = "먼저 차례대로 생각한 다음 결론을 쓰십시오."
    examples: str = "\n질문: 다음 가운데 소수는?\n선택지:\n1 4\n2 7\n3 9\n답변: 2\n\n질문: 암호화란 무엇인가?\n답변: 열쇠 없이는 읽지 못하게 글을 바꾸는 일이다.\n"
    order: str = "지시: "
    escaped: bool = False

    @property
    def newline(self) -> str:
        return "\\n" if self.escaped else "\n"


@dataclass(frozen=True)
class Parsed:
    """A question's parts, so that a plan that has them as columns computes them once."""

    is_mc: Column
    stem: Column
    options: Column

    @classmethod
    def of(cls, text: Column) -> Parsed:
        return cls(parse.is_multiple_choice(text), parse.stem(text), parse.options(text))


#: A prompt as the parts that follow one another, texts or Columns: (multiple choice, open).
Parts = tuple[list[str | Column], list[str | Column]]


def zero_shot(text: Column, t: Template, q: Parsed) -> Parts:
    """Role, instruction, question; options one on each line."""
    head = lambda what: f"{t.role}\n\n{t.order}{what}\n\n{QUESTION} "
    return (
        [head(t.choose), q.stem, f"\n{CHOICES}\n", F.array_join(q.options, "\n"), f"\n\n{ANSWER}"],
        [head(t.explain), text, f"\n\n{ANSWER}"],
    )


def few_shot(text: Column, t: Template, q: Parsed) -> Parts:
    """Examples before a multiple-choice question; an open one is to be reasoned about."""
    n = t.newline
    return (
        [f"{t.role}{n}{t.choose}{n}{n}{t.examples}{n}{n}{QUESTION} ", q.stem, f"{n}{CHOICES}{n}", F.array_join(q.options, "\n"), f"{n}{n}{ANSWER}"],
        [f"{t.role}{n}{t.step_by_step}{n}{n}{QUESTION} ", text, f"{n}{n}{REASONING}"],
    )


def zero_shot_legacy(text: Column, t: Template, q: Parsed) -> Parts:
    """The older layout: the instruction stands in the line after the role, and only the separator between them may be escaped."""
    head = lambda what: f"{t.role}{t.newline}{what}\n\n{QUESTION} "
    mc, free = zero_shot(text, t, q)
    return [head(t.choose), *mc[1:]], [head(t.explain), *free[1:]]


STRATEGIES: dict[str, Callable[[Column, Template, Parsed], Parts]] = {
    "few_shot": few_shot,
    "zero_shot": zero_shot,
    "zero_shot_legacy": zero_shot_legacy,
}
DEFAULT_STRATEGY = "few_shot"


def _first(parts: list[str | Column], n: int) -> list[str | Column]:
    """Parts that give the first `n` characters and hardly more: what stands behind them is not computed."""
    out, left = [], n
    for p in parts:
        if left <= 0:
            break
        out.append(p[:left] if isinstance(p, str) else F.substring(p, 1, left))
        left -= len(p) if isinstance(p, str) else 0
    return out


def prompt(text: Column, strategy: str = DEFAULT_STRATEGY, template: Template = Template(), parsed: Parsed | None = None) -> Column:
    q = parsed or Parsed.of(text)
    mc, free = ([F.lit(p) if isinstance(p, str) else p for p in parts] for parts in STRATEGIES[strategy](text, template, q))
    return F.when(q.is_mc, F.concat(*mc)).otherwise(F.concat(*free))


def preview(text: Column, n: int = 100, strategy: str = DEFAULT_STRATEGY, template: Template = Template(), parsed: Parsed | None = None) -> Column:
    """The first `n` characters of the prompt."""
    q = parsed or Parsed.of(text)
    mc, free = (F.concat(*(F.lit(p) if isinstance(p, str) else p for p in _first(parts, n))) for parts in STRATEGIES[strategy](text, template, q))
    return X.preview(F.when(q.is_mc, mc).otherwise(free), n)
