"""Chat formatting of typed content parts, with a loss mask and reading back.

A visitor flattens a turn's text, image, audio and document parts, in order, into text with placeholders
and records for each attachment its reference, place and expanded token count. Turns are marked by the
template below; control strings inside texts are escaped, so that reading back restores every text. Text parts that
follow one another are one text: they are joined before they are escaped, as a control string may be split over them.

Rows of a conversation are formatted one after another by turn, then role and text; a conversation is never
held as a whole. The output has one row (a fragment) for each turn, with its place in the conversation's formatted
text, the loss mask, which covers each assistant text and nothing else, and its attachments.

Defined results: null text is empty, null role is the role of empty name; equal turns are kept, each for itself;
an unknown part type is an error; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import slices

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<ordinal:int,kind:string,ref:string,at:long,tokens:long>>"
FRAGMENTS = f"conv_id long, seq long, role string, fragment string, start long, masks array<struct<s:long,e:long>>, attachments {ATTACHMENTS}"
BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

#: Patch edge and merge factor of images, tokens a second of sound, tokens a page.
PATCH, MERGE, PER_SECOND, PER_PAGE = 14, 4, 25, 256

_CONTROL = re.compile(r"\\|<(?=/?s>|\|)|\[(?=/?INST\])|\|(?=>)")
_ESCAPED = re.compile(r"\\([\\lbp])")
_TO, _FROM = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}, {"\\": "\\", "l": "<", "b": "[", "p": "|"}
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|<\|turn:(?P<role>.*?)\|>(?P<other>.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    """text without control strings: their first letter, and every backslash, become an escape."""
    return _CONTROL.sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[1]], text)


class Flatten:
    """Visits the parts of a turn; after close(), `out` is the flattened text, `found` its attachments (place within out)."""

    def __init__(self, ordinal: int = 0):
        self.out, self.length, self.ordinal, self.found, self.texts = [], 0, ordinal, [], []

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type')}", None)
        if method is None:
            raise ValueError(f"no content part of type {part.get('type')!r}")
        method(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def close(self) -> str:
        """Puts the texts since the last attachment, escaped as one; the flattened text so far."""
        if self.texts:
            self._put(escape("".join(self.texts)))
            self.texts = []
        return "".join(self.out)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close()
        self.found.append({"ordinal": self.ordinal, "kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._put(f"<|{kind}:{self.ordinal}|>")
        self.ordinal += 1

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        rows, cols = (math.ceil(max(1, part.get(x) or 1) / PATCH) for x in ("height", "width"))
        self._attach("image", part, math.ceil(rows * cols / MERGE))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * PER_PAGE)


def render(role: str, body: str) -> tuple[str, int]:
    """A turn's fragment, and where its body begins in it."""
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 10
    if role == "assistant":
        return f" {body}</s>", 1
    head = f"<|turn:{escape(role)}|>"
    return f"{head}{body}<|end|>", len(head)


def parse(fragment: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, where its body begins) of each turn in a formatted text; an error if it is anything else."""
    at = 0
    while at < len(fragment):
        m = _TURN.match(fragment, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = "user" if m["user"] is not None else "assistant" if m["assistant"] is not None else "other"
        yield unescape(m["role"]) if kind == "other" else kind, unescape(m[kind]), m.start(kind)
        at = m.end()


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, seq, at, ordinal = object(), 0, 0, 0
    for batch in slices(batches):
        rows = []
        for conv, role, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if conv != now:
                now, seq, at, ordinal = conv, 0, 0, 0
            visitor = Flatten(ordinal)
            for part in parts if parts is not None else [{"type": "text", "text": text}]:
                visitor.visit(part)
            fragment, body = render(role or "", visitor.close())
            ordinal = visitor.ordinal
            masks = [{"s": at + body, "e": at + body + visitor.length}] if role == "assistant" else []
            found = [x | {"at": at + body + x["at"]} for x in visitor.found]
            rows.append((conv, seq, role or "", fragment, at, masks, found))
            seq, at = seq + 1, at + len(fragment)
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "seq", "role", "fragment", "start", "masks", "attachments"])


def format_chats(turns: DataFrame) -> DataFrame:
    """FRAGMENTS of turns (conv_id, turn, role, text and, where parts are typed, parts as PARTS), ordered by conversation and seq."""
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", parts.alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "parts").mapInArrow(_format, FRAGMENTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    state: dict = {}

    def close() -> None:
        if state:
            rows.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["at"]))

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        rows.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in slices(batches):
        for conv, fragment, start, masks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not state or state["conv"] != conv:
                close()
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "at": 0}
            for role, text, _ in parse(fragment):
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["n"] += 1
            for mask in masks:
                said = unescape(fragment[mask["s"] - start : mask["e"] - start])
                state["chars"] += len(said)
                state["loss"].update(said.encode("utf-8", "surrogatepass"))
            state["at"] += len(fragment)
        yield out()
    close()
    yield out()


def read_back(fragments: DataFrame, ordered: bool = False) -> DataFrame:
    """BACK for each conversation, from its fragments alone; ordered: as format_chats returns them."""
    if not ordered:
        fragments = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return fragments.select("conv_id", "fragment", "start", "masks").mapInArrow(_read, BACK)
