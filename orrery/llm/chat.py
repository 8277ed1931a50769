"""Chat formatting by incremental rendering of a template that is taken as a black box.

A template turns a list of turns into one string. Successive prefixes of a conversation are rendered and each
output is compared with the one before: if it begins with it, what is new is the new turn's span; if not, the
template rewrites history. Within a span the turn's text is found by rendering the same prefix with the
text replaced by two probes: what both outputs share before and after the probe frames the text. The loss
mask is the spans of the assistant's texts.

Every prefix is rendered in full, whatever the conversation's length: n turns cost three renderings each of up
to n turns, and a template that rewrites history at any length is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: What opens and closes a turn in turn_template; a text that holds one is escaped.
OPEN, CLOSE = "### ", "</turn>"
_PROBES = ("probe-one", "another-2")


def escape(text: str) -> str:
    r"""text with a backslash before every backslash, #, < and :, so no control string is left in it; unescape undoes it."""
    return re.sub(r"([\\#<:])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_template(turns: list[Turn]) -> str:
    """The library's template: each turn with its role as a header and a closing mark, texts and roles escaped."""
    return "".join(f"{OPEN}{escape(role)}: {escape(text)}{CLOSE}\n" for role, text in turns)


class RewritesHistory(ValueError):
    """The template's output for more turns does not begin with its output for fewer."""


@dataclass(frozen=True)
class Formatted:
    """The whole output; for each turn its role, its span, and the span of its text within the output."""

    output: str
    turns: list[tuple[str, int, int, int, int]]

    def loss_spans(self) -> list[tuple[int, int]]:
        return [(a, b) for role, _, _, a, b in self.turns if role == "assistant"]


def _common(a: str, b: str) -> int:
    """Characters that a and b share at their start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _span(template: Template, before: list[Turn], turn: Turn, base: str) -> tuple[str, int, int]:
    """The output with the turn, base being that of the turns before, and where in it the turn's text begins and ends."""
    out = template([*before, turn])
    if not out.startswith(base):
        raise RewritesHistory("output of a longer conversation does not begin with that of its beginning")
    added = out[len(base) :]
    one, two = (template([*before, (turn[0], p)])[len(base) :] for p in _PROBES)
    start = _common(one, two)
    end = _common(one[::-1], two[::-1])
    if one[start : len(one) - end] != _PROBES[0] or two[start : len(two) - end] != _PROBES[1]:
        raise ValueError("the template does not keep a turn's text in one place")
    if added[:start] != one[:start] or end and added[len(added) - end :] != one[len(one) - end :]:
        raise ValueError("what frames a turn depends on its text")
    return out, len(base) + start, len(out) - end


def render(turns: list[Turn], template: Template = turn_template) -> Formatted:
    """Render turns and locate them; raises RewritesHistory for a template that changes what it has put out.

    No turns give the template's output for none. Texts may hold anything, control strings included. What the
    template itself raises goes to the caller.
    """
    output, found = template([]), []
    for k, turn in enumerate(turns):
        at = len(output)
        output, a, b = _span(template, turns[:k], turn, output)
        found.append((turn[0], at, len(output), a, b))
    return Formatted(output, found)


_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*+): ((?:[^\\#<:]|\\.)*+)</turn>\n", re.S)


def parse(output: str) -> list[Turn]:
    """The turns of turn_template's output, read from the text alone."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError("not an output of the turn template")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "conv_id long, output string, turns array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>"


def _format(table: pa.Table, template: Template) -> pa.Table:
    rows = sorted(zip(table.column("turn").to_pylist(), table.column("role").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    done = render([(role, text) for _, role, text in rows], template)
    kind = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end"))]))
    spans = [dict(zip(("role", "start", "end", "text_start", "text_end"), t, strict=True)) for t in done.turns]
    return pa.table([pa.array([table.column("conv_id")[0].as_py()], pa.int64()), pa.array([done.output], pa.string()), pa.array([spans], kind)], ["conv_id", "output", "turns"])


def format_conversations(conversations: DataFrame, template: Template = turn_template) -> DataFrame:
    """conv_id, output and turns (role, span and text span of each) for each conversation.

    Rows are one turn each, ordered by turn, then role and text; null turns come last; rows that repeat a
    turn are turns of their own. Null roles and texts count as empty; a null conv_id is a conversation.
    Other columns are ignored. A conversation is one row of the result, so its turns meet in one task.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").applyInArrow(lambda t: _format(t, template), FORMATTED)


def report(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the outputs hold, read back from them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, output, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "output", "turns")), strict=True):
                turns = parse(output)
                loss = "".join(unescape(output[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(output)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return formatted.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
