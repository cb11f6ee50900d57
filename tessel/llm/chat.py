"""Chat logs folded into final messages and rendered for training.

A log is a table of events of conversations: `message` starts a message,
`delta` appends to the last one, `edit` replaces the text of message `target`,
`regenerate` drops it and all later ones. Logs are partitioned by conversation
and sorted by sequence; a task folds one conversation after the other and holds
no more than the messages of one.

The template marks turns with control strings. Those inside roles and texts are
escaped by one more backslash behind the `<`, which is reversible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _role_back(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def fold(events: list[tuple]) -> list[tuple[str, str]]:
    """Final messages (role, text) of one conversation's sorted events (type, role, text, target).

    Unknown targets and a delta before any message are an error of the log and
    change nothing. Null texts and roles are empty; a null type is a message.
    """
    out: list[tuple[str, list[str]]] = []
    for kind, role, text, target in events:
        text = text or ""
        if kind in (None, "message"):
            out.append((role or "", [text]))
        elif kind == "delta" and out:
            out[-1][1].append(text)
        elif kind == "edit" and target is not None and 0 <= target < len(out):
            out[target] = (out[target][0], [text])
        elif kind == "regenerate" and target is not None and 0 <= target < len(out):
            del out[target:]
    return [(role, "".join(parts)) for role, parts in out]


class Rendered(NamedTuple):
    text: str
    mask: list[tuple[int, int]]  # code points [from, to) that a loss counts


def render(messages: list[tuple[str, str]]) -> Rendered:
    parts, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{_role(role)}\n", escape(text)
        at += len(head)
        if role == LEARNED:
            mask.append((at, at + len(body)))
        at += len(body) + len(END) + 1
        parts += (head, body, END, "\n")
    return Rendered("".join(parts), mask)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages again."""
    return [(_role_back(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked(r: Rendered) -> str:
    return "".join(unescape(r.text[a:b]) for a, b in r.mask)


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.list_(pa.int64())))])


def _conversations(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    now, rows, begun = None, [], False
    for b in it:
        for conv, *event in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if begun and conv != now:
                yield now, rows
                rows = []
            now, begun = conv, True
            rows.append(tuple(event))
    if begun:
        yield now, rows


def _render_all(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, chars = [], 0

    def batch() -> pa.RecordBatch:
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FORMATTED.types, strict=True)], schema=_FORMATTED)

    for conv, events in _conversations(it):
        r = render(fold(events))
        out.append((conv, r.text, [list(m) for m in r.mask]))
        chars += len(r.text)
        if chars > 8_000_000:
            yield batch()
            out, chars = [], 0
    if out:
        yield batch()


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of each conversation of `events` (conv_id, seq, type, role, text, target).

    Ties of seq are ordered by type, role, text and target; a null seq comes
    first; rows without conv_id are one conversation of their own. Other columns
    are not read.
    """
    keys = ["conv_id", "seq", "type", "role", "text", "target"]
    read = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "type", "role", "text", F.col("target").cast("int").alias("target"))
    logs = read.repartition("conv_id").sortWithinPartitions(*keys)
    return logs.select("conv_id", "type", "role", "text", "target").mapInArrow(_render_all, "conv_id long, formatted string, mask array<array<long>>")


def _read_back(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for conv, text, mask in zip(*(c.to_pylist() for c in b.columns), strict=True):
            turns = parse(text)
            digest = hashlib.sha256()
            for role, t in turns:
                digest.update(f"{role}\n{t}\n".encode("utf-8", "replace"))
            loss = masked(Rendered(text, mask))
            out.append((conv, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(text)))
        cols = zip(*out, strict=True) if out else [()] * len(_DIGEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _DIGEST.types, strict=True)], schema=_DIGEST)


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, read back from the output."""
    return formatted.select("conv_id", "formatted", "mask").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def as_log(messages: DataFrame) -> DataFrame:
    """An event log that folds to `messages` (conv_id, turn, role, text) again, with every kind of event.

    By its place in the conversation a message comes at once, in two parts, wrong and then
    edited, or after an answer that is regenerated; and each fourth one is followed by
    events that change nothing. Messages are ordered by turn, role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = messages.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), (F.row_number().over(order) - 1).alias("at"))
    cut = F.floor(F.length("text") / 2).cast("int")
    event = lambda n, kind, role=None, text=None, target=None: F.struct(
        (F.col("at").cast("long") * 10 + n).alias("seq"), F.lit(kind).alias("type"), (F.lit(None) if role is None else role).cast("string").alias("role"),
        (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if target is None else target).cast("int").alias("target"),
    )
    whole = event(3, "message", F.col("role"), F.col("text"))
    kinds = [
        F.array(whole),
        F.array(event(0, "message", F.col("role"), F.substring(F.col("text"), F.lit(1), cut)), event(1, "delta", None, F.substring(F.col("text"), cut + 1, F.length("text")))),
        F.array(event(0, "message", F.col("role"), F.lit("wrong")), event(1, "delta", None, F.lit(" words")), event(2, "edit", None, F.col("text"), F.col("at"))),
        F.array(event(0, "message", F.lit("assistant"), F.lit("no")), event(1, "message", F.lit("user"), F.lit("again")), event(2, "regenerate", None, None, F.col("at")), whole,
                event(4, "edit", None, F.lit("x"), F.lit(10**6)), event(5, "regenerate", None, None, F.lit(-1)), event(6, "edit", None, F.lit("x"))),
    ]
    chosen = F.coalesce(*(F.when(F.col("at") % 4 == i, k) for i, k in enumerate(kinds)))
    return placed.select("conv_id", F.explode(chosen).alias("e")).select("conv_id", "e.*")


def sql(trap: bool = True) -> str:
    """The digests in DuckDB's SQL, for `conversations` and, with `trap`, the conversation -1."""
    said = "'<|im_end|><|im_start|>assistant ok'"
    more = f"UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}" if trap else ""
    esc = lambda x: f"regexp_replace({x}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    return (
        "WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations "
        f"{more}) "
        "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, "
        "coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, "
        "sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, "
        f"sum(length('<|im_start|>' || replace(replace({esc('role')}, '%', '%25'), chr(10), '%0A') || chr(10) || {esc('text')} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars "
        "FROM c GROUP BY conv_id"
    )
