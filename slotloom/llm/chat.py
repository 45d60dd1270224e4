"""Chat formatting by incremental black-box rendering.

A renderer is any function from a list of (role, text) to a string. A conversation's turns are rendered as successive
prefixes; when output k starts with output k - 1, the rest is turn k's span, else the template rewrites history and the
turn is marked so. A conversation is held and rendered whole, at a cost that grows with the square of its turns. Only
for a template declared ``turn_local`` (its output is that of its turns one by one, as the default template's) turns are
streamed in order and rendered in chunks of at most ``chunk`` turns, whose outputs follow each other; such a conversation
is never held whole, its cost grows with its length, and a template that is not turn-local at a seam raises an error.

The default template marks turns by ``### Role: `` and `` </turn>`` and escapes both strings, and its escape sign, in
texts with a backslash, reversibly. The loss mask holds the spans of assistant texts.

Rows without conversation id form one conversation; null turns come first; ties go by role, then text; null roles and
texts are empty strings. Repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPED = re.compile(r"\\|###|</turn>")
_UNESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ROLE = re.compile(r"\\|###|</turn>|: |:\Z")
_ROLE_BACK = re.compile(r"\\(\\|###|</turn>|: |:)")
_CONTROL = re.compile(r"\\(?:\\|###|</turn>|: |:)|(### )|( </turn>\n)")
Turn = tuple[str, str]


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def render(turns: list[Turn]) -> str:
    """The default template."""
    return "".join(f"{OPEN}{_ROLE.sub(lambda m: chr(92) + m[0], role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


render.turn_local = True


def locate(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> tuple[str, list[tuple[int, int, bool]]]:
    """(whole output, span of each turn in it and whether the template kept what came before)."""
    last, spans = "", []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        kept = now.startswith(last)
        if kept:
            spans.append((len(last), len(now), True))
        else:
            same = next((i for i, (a, b) in enumerate(zip(last, now)) if a != b), min(len(last), len(now)))
            spans = [(a, b, ok and b <= same) for a, b, ok in spans]
            spans.append((same, len(now), False))
        last = now
    return last, spans


def text_span(turn: str, role: str, text: str) -> tuple[int, int]:
    """Where the escaped text stands in its rendered turn; empty at the end if it is not found."""
    own = escape(text)
    at = turn.rfind(own + CLOSE) if own + CLOSE in turn else turn.rfind(own)
    return (at, at + len(own)) if at >= 0 else (len(turn), len(turn))


def text_spans(turns: list[Turn], whole: str, template: Callable[[list[Turn]], str]) -> list[tuple[int, int] | None]:
    """Where each text stands in the whole output of any template: what differs when a sign found nowhere else takes the
    text's place. None if the template leaves the text out, repeats it, or changes other parts with it."""
    sign = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in whole and not any(c in r or c in t for r, t in turns))
    out: list[tuple[int, int] | None] = []
    for k, (role, _) in enumerate(turns):
        parts = template([*turns[:k], (role, sign), *turns[k + 1 :]]).split(sign)
        fits = len(parts) == 2 and len(whole) >= len(parts[0]) + len(parts[1]) and whole.startswith(parts[0]) and whole.endswith(parts[1])
        out.append((len(parts[0]), len(whole) - len(parts[1])) if fits else None)
    return out


def format_chats(turns: DataFrame, template: Callable[[list[Turn]], str] = render, chunk: int = CHUNK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, chunk, formatted, spans(start, end, role, text_start, text_end, loss, kept): outputs of a conversation's
    chunks, to be read one after the other (one chunk a conversation, unless the template is turn-local)."""
    local = getattr(template, "turn_local", False)
    kind = turns.schema[conv_col].dataType.simpleString()
    one = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = one.repartition(F.col("conv")).sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv", "role", "text")
    schema = f"conv {kind}, chunk int, formatted string, spans array<struct<start:int,end:int,role:string,text_start:int,text_end:int,loss:boolean,kept:boolean>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("role", pa.string()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_()), ("kept", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, held, began = None, 0, [], False
        out: list[tuple] = []

        def close() -> None:
            text, spans = locate(held, template)
            rows = []
            if template is render:
                at = [tuple([a + x for x in text_span(text[a:b], role, own)]) for (role, own), (a, b, _) in zip(held, spans)]
            else:
                at = text_spans(held, text, template)
            for (role, _), (a, b, kept), found in zip(held, spans, at):
                lo, hi = found or (min(b, len(text)),) * 2
                rows.append({"start": a, "end": b, "role": role, "text_start": lo, "text_end": hi, "loss": role == "assistant", "kept": kept})
            out.append((conv, number, text, rows))

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            convs, numbers, texts, spans = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, span_type)], ["conv", "chunk", "formatted", "spans"])

        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if began and (c != conv or local and len(held) == chunk):
                    if c == conv and template([held[-1], (role, text)]) != template(held[-1:]) + template([(role, text)]):
                        raise ValueError("the template is declared turn-local but is not")
                    close()
                    number = number + 1 if c == conv else 0
                    held = []
                conv, began = c, True
                held.append((role, text))
            if len(out) >= 1000:
                yield batch_of(id_kind)
        if began:
            close()
        if out:
            yield batch_of(id_kind)

    return dealt.mapInArrow(run, schema)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of the default template."""
    turns, start = [], None
    for m in _CONTROL.finditer(formatted):
        if m[1] and start is None:
            start = m.end()
        elif m[2] and start is not None:
            own = formatted[start : m.start()]
            cut_ = next(x.start() for x in re.finditer(r"\\(?:\\|###|</turn>|: |:)|(: )", own) if x[1])
            turns.append((_ROLE_BACK.sub(r"\1", own[:cut_]), unescape(own[cut_ + len(MIDDLE) :])))
            start = None
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation from the outputs alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv"].dataType.simpleString()
    dealt = formatted.select("conv", "chunk", "formatted", F.transform("spans", lambda s: F.struct(s["text_start"].alias("a"), s["text_end"].alias("b"), s["loss"].alias("loss"))).alias("spans"))
    dealt = dealt.repartition(F.col("conv")).sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def row() -> tuple:
            c, n, digest, chars, loss, size = state
            return c, n, digest.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            for c, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if state is None or state[0] != c:
                    if state is not None:
                        out.append(row())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["loss"]:
                        own = unescape(text[s["a"] : s["b"]])
                        state[3] += len(own)
                        state[4].update(own.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(out) >= 1000:
                yield batch_of(id_kind)
        if state is not None:
            out.append(row())
        if out:
            yield batch_of(id_kind)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
