"""Chat formatting with loss masks found by rendering.

A template is a black box from messages to text.  It is rendered for successive turn prefixes, each whole; where each output
begins with the one before it, the new part is the turn's span.  Where it does not, the template rewrites history, and that is
reported rather than masked wrongly.  Within a turn's span the message's text and role are found by rendering the turn with
others: what stays the same on both sides belongs to the template.

The template used here marks turns by control strings and escapes those inside texts, reversibly; how to read its texts back is
a part of it, ``unescape``, and a template without that is taken to put texts as they are.  It is declared local: a turn is
rendered alike whatever stands before it.  For such templates, once the output is longer than ``WHOLE`` characters, the last turn
alone goes before each one; whenever the number of turns has doubled, and at the end, the whole conversation is rendered once and
held against a digest of the spans so far.  Where they differ the declaration is false, and the conversation is read anew from
whole prefixes.  So the outcome is that of whole prefixes at every length, and the cost linear for a template that is local.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

OPEN, CLOSE, END = "<|turn|>", "<|text|>", "<|end|>"
#: One sign of each control string gives way to its code; the per cent sign goes first, and is read back last.
ESCAPE = (("%", "%25"), ("<|", "<%7C"), ("</s>", "<%2Fs>"), ("[INST]", "[%49NST]"), ("[/INST]", "[%2FINST]"))


def escape(text: str) -> str:
    for plain, safe in ESCAPE:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    for plain, safe in reversed(ESCAPE):
        text = text.replace(safe, plain)
    return text


def template(messages: list[Message]) -> str:
    return "".join(f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}\n" for role, text in messages)


template.local = True
template.unescape = unescape
#: Characters of output up to which prefixes of a local template are rendered whole too.
WHOLE = 100_000


@dataclass(frozen=True)
class Span:
    """Where a turn and, within it, its text and role stand in the output of its prefix; ``rewritten`` if it changed what came
    before it.  A role that the template does not show in just one place, or whose others it does not take, has no place."""

    start: int
    end: int
    text_start: int
    text_end: int
    role_start: int | None
    role_end: int | None
    rewritten: bool


def shared_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _between(one: str, two: str, shortest: int) -> tuple[int, int]:
    """How many characters two renderings share at their starts and at their ends; ``shortest`` is the size of the part that
    differs in the first."""
    head = shared_start(one, two)
    return head, min(shared_start(one[::-1], two[::-1]), max(0, len(one) - shortest - head))


def before_all(render: Template) -> str:
    """The output without turns; nothing for a template that demands one."""
    try:
        return render([])
    except Exception:  # noqa: BLE001
        return ""


def turn_span(render: Template, before: list[Message], role: str, text: str, old: str) -> tuple[str, Span]:
    """The output with one turn more after ``before``, whose output is ``old``, and that turn's span."""
    new = render([*before, (role, text)])
    start = len(old) if new.startswith(old) else shared_start(old, new)
    probes = [render([*before, (role, probe)])[start:] for probe in ("q", "zz")]
    head, tail = _between(*probes, 1)
    role_start = role_end = None
    try:
        probes = [render([*before, (probe, text)])[start:] for probe in ("q", "zz")]
        if len(probes[1]) - len(probes[0]) == 1:  # shown in one place
            first, last = _between(*probes, 1)
            role_start, role_end = start + first, len(new) - last
    except Exception:  # noqa: BLE001 - a template may refuse roles that it does not know
        pass
    return new, Span(start, len(new), start + head, max(start + head, len(new) - tail), role_start, role_end, not new.startswith(old))


def turn_spans(render: Template, messages: list[Message]) -> tuple[str, list[Span]]:
    """The output, and each turn's span, from the outputs of successive whole prefixes."""
    output, spans = before_all(render), []
    for k, (role, text) in enumerate(messages):
        output, span = turn_span(render, messages[:k], role, text, output)
        spans.append(span)
    return output, spans


class Reader:
    """Reads turns of one conversation as they come."""

    def __init__(self, render: Template, local: bool | None = None):
        self.render, self.unescape = render, getattr(render, "unescape", str)
        self.local = getattr(render, "local", False) if local is None else local
        self.messages: list[Message] = []
        self.output, self.size = before_all(render), 0
        self.seen, self.check_at = None, 0  # a digest of the output, once the last turn alone goes before each one
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.rewrites = 0

    def add(self, role: str, text: str) -> None:
        if self.local and self.seen is None and self.messages and len(self.output) > WHOLE:
            self.seen, self.size, self.check_at = hashlib.sha256(self.output.encode()), len(self.output), 2 * len(self.messages)
            self.output = self.render(self.messages[-1:])
        before = self.messages[:] if self.seen is None else self.messages[-1:]
        new, span = turn_span(self.render, before, role, text, self.output)
        self.messages.append((role, text))
        if self.seen is None:
            self.output, self.formatted_chars = new, len(new)
        elif span.rewritten:
            return self.read_anew()
        else:
            self.seen.update(new[span.start :].encode())
            self.size += len(new) - span.start
            self.output, self.formatted_chars = self.render(self.messages[-1:]), self.size
        self.take(role, new, span)
        if self.seen and len(self.messages) >= self.check_at:
            self.check_at *= 2
            self.check()

    def take(self, role: str, new: str, span: Span) -> None:
        said = self.unescape(new[span.text_start : span.text_end])
        name = role if span.role_start is None else self.unescape(new[span.role_start : span.role_end])
        self.turns.update(f"{name}\n{said}\n".encode())
        self.n_turns += 1
        self.rewrites += span.rewritten
        if name == "assistant":  # the loss mask: this turn's text and nothing around it
            self.loss.update(said.encode())
            self.loss_chars += len(said)

    def check(self) -> None:
        if self.seen and hashlib.sha256(self.render(self.messages).encode()).digest() != self.seen.digest():
            self.read_anew()

    def read_anew(self) -> None:
        """From whole prefixes, as the template is not local."""
        messages = self.messages
        self.__init__(self.render, False)
        for role, text in messages:
            self.add(role, text)

    def row(self) -> tuple:
        self.check()
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.rewrites


def format_conversations(turns: DataFrame, render: Template = template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites`` of every conversation.

    Rows go in the order of ``turn`` (null first), then role and text.  A null text or role counts as empty.  Rows with a
    null conversation make one conversation.  Repeated rows are turns of their own.  Conversations are spread by a shuffle
    on their id and read turn after turn in a sorted stream; a conversation is held whole, very long texts too.
    Other columns are not read; an empty table gives no rows.
    """
    bound_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    arrow_kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, done, id_type = None, None, [], None

        def out() -> pa.RecordBatch:
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(next(columns), id_type), *(pa.array(c, t) for c, t in zip(columns, arrow_kinds))], names=names)

        for batch in batches:
            id_type = batch.schema.types[0]
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if reader is None or conv != current:
                    if reader:
                        done.append((current, *reader.row()))
                    current, reader = conv, Reader(render)
                reader.add(role, text)
            if len(done) >= 1000:
                yield out()
                done.clear()
        if reader:
            done.append((current, *reader.row()))
        if done:
            yield out()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + length('<|text|>') + length('<|end|>') + 1
           + length(replace(replace(replace(replace(replace(text, '%', '%25'), '<|', '<%7C'), '</s>', '<%2Fs>'), '[INST]', '[%49NST]'), '[/INST]', '[%2FINST]')))::BIGINT AS formatted_chars,
       0::BIGINT AS rewrites
FROM c GROUP BY conv_id
"""
