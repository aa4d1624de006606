"""Chat formatting with typed content parts.

A turn's content is text or a list of typed parts. A visitor walks the parts in order and flattens them:
text stays (escaped), and each image, audio or document part becomes one placeholder, an attachment reference
and the number of tokens that it expands to. Turns are framed as

    <|im_start|>role NEWLINE content <|im_end|> NEWLINE

Escaping is reversible: inside texts and roles `%` becomes `%25` and the `<|` that opens a control string
becomes `%3C|`, so a text can neither end its turn nor begin another.

Rows are formatted one by one in parallel. A conversation's turns then meet in one task, in order, as a stream:
digests are carried from row to row, so memory does not grow with the length of a conversation.

Defined results: a null text is empty and a null role is an empty role; turns are ordered by (turn, role, text)
with nulls first, and repeated rows are formatted as often as they occur; rows with a null conversation id form
one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import values

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_CONTROL = re.compile(r"<\|(?:im_start|im_end|image|audio|document)\|>")
_TURN = re.compile(re.escape(START) + r"(?P<role>[^\n]*)\n(?P<content>.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str | None) -> str:
    return (text or "").replace("%", "%25").replace("<|", "%3C|")


def unescape(text: str) -> str:
    return text.replace("%3C|", "<|").replace("%25", "%")


def escape_role(role: str | None) -> str:
    return escape(role).replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n"))


@dataclass
class Costs:
    """Tokens that an attachment expands to."""

    image_patch: int = 28
    image_max: int = 1280
    audio_per_second: float = 12.5
    document_per_page: int = 560

    def image(self, part: dict[str, Any]) -> int:
        across, down = (-(-int(part.get(k) or self.image_patch) // self.image_patch) for k in ("width", "height"))
        return max(1, min(across * down, self.image_max))

    def audio(self, part: dict[str, Any]) -> int:
        return max(1, round(float(part.get("seconds") or 0) * self.audio_per_second))

    def document(self, part: dict[str, Any]) -> int:
        return max(1, int(part.get("pages") or 1)) * self.document_per_page


@dataclass
class Flattened:
    text: str = ""
    attachments: list[dict[str, Any]] = field(default_factory=list)
    expanded_tokens: int = 0


class PartVisitor:
    """Flattens typed parts in order. An unknown type is an error; a null part list is empty."""

    def __init__(self, costs: Costs | None = None) -> None:
        self.costs = costs or Costs()

    def visit(self, parts: str | list[dict[str, Any]] | None) -> Flattened:
        out, written = Flattened(), []
        for part in [{"type": "text", "text": parts}] if isinstance(parts, str) else parts or []:
            method = getattr(self, f"visit_{part.get('type')}", None)
            if method is None:
                raise ValueError(f"unknown content part: {part.get('type')!r}")
            written.append(method(part, out))
        out.text = "".join(written)
        return out

    def visit_text(self, part: dict[str, Any], out: Flattened) -> str:
        return escape(part.get("text"))

    def visit_image(self, part: dict[str, Any], out: Flattened) -> str:
        return self._attach("image", part, self.costs.image(part), out)

    def visit_audio(self, part: dict[str, Any], out: Flattened) -> str:
        return self._attach("audio", part, self.costs.audio(part), out)

    def visit_document(self, part: dict[str, Any], out: Flattened) -> str:
        return self._attach("document", part, self.costs.document(part), out)

    def _attach(self, kind: str, part: dict[str, Any], tokens: int, out: Flattened) -> str:
        out.attachments.append({"index": len(out.attachments), "type": kind, "ref": part.get("ref"), "tokens": tokens})
        out.expanded_tokens += tokens
        return PLACEHOLDER[kind]


def format_turn(role: str | None, content: str | list[dict[str, Any]] | None, visitor: PartVisitor | None = None) -> tuple[str, Flattened]:
    flat = (visitor or PartVisitor()).visit(content)
    return f"{START}{escape_role(role)}\n{flat.text}{END}\n", flat


def parse(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """role, content (still escaped) and the span of the content, of each turn; an error if anything is left over."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape_role(m["role"]), m["content"], m.span("content")
        at = m.end()


_PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_ATTACHMENT = pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (null for typed parts), formatted, attachments, expanded_tokens: a row per turn.

    content_col: strings, or arrays of typed parts (fields type, text, ref, width, height, seconds, pages).
    """
    typed = dict(turns.dtypes)[content_col] != "string"
    source = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = PartVisitor()
        for batch in batches:
            done = [format_turn(r, c, visitor) for r, c in zip(values(batch.column(2)), values(batch.column(3)))]
            text = pa.nulls(batch.num_rows, pa.string()) if typed else batch.column(3)
            cells = [
                pa.array([x for x, _ in done], pa.string()),
                pa.array([y.attachments for _, y in done], _ATTACHMENT),
                pa.array([y.expanded_tokens for _, y in done], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], text, *cells], ["conv_id", "turn", "role", "text", "formatted", "attachments", "expanded_tokens"])

    schema = "conv_id long, turn long, role string, text string, formatted string, attachments array<struct<index:int,type:string,ref:string,tokens:long>>, expanded_tokens long"
    return source.mapInArrow(run, schema)


def render(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id, part_no, turn_no, chunk: the formatted conversations as ordered chunks, one per turn."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return format_turns(turns, **columns).select("conv_id", F.row_number().over(order).alias("turn_no"), F.col("formatted").alias("chunk"), "attachments", "expanded_tokens")


class _Digest:
    """What is read back from one conversation's output, turn by turn."""

    def __init__(self, trained_role: str) -> None:
        self.trained_role, self.turns, self.loss = trained_role, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str) -> None:
        for role, content, _ in parse(formatted):
            text = unescape(content)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == self.trained_role:
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.chars += len(formatted)


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Parse formatted turns (of format_turns) and digest them per conversation.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The loss mask covers the
    content of each turn of trained_role.
    """
    dealt = formatted.select("conv_id", "turn", "role", "text", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def close() -> None:
            if state is not None:
                done.append((now, state.n, state.turns.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars))

        for batch in batches:
            for conv, text in zip(values(batch.column(0)), values(batch.column(4))):
                if state is None or conv != now:
                    close()
                    now, state = conv, _Digest(trained_role)
                state.add(text)
            if len(done) >= 4096:
                yield flush()
        close()
        if done:
            yield flush()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
