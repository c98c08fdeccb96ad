"""Chat formatting with typed content parts (operator 7).

A visitor walks the parts of a message in order: text is written out, escaped as a whole where text parts follow one
another, so that no control string arises where two of them meet; an image, an audio clip or a document becomes one placeholder, and
what it stands for is recorded as an attachment with its reference and the number of tokens that it expands to. Formatting works row by row. Reading back parses the formatted turns, takes off the escapes
and digests each conversation turn by turn in order, so a conversation of any length needs only the digests' memory.

Template: `<|im_start|>ROLE\\nCONTENT<|im_end|>\\n`. Escapes: a backslash before `\\` and before the `|` of `<|`, so no
control string can stand in content; in a role a newline is written `\\n` too.

Defined results: null roles and texts count as empty; rows of one conversation and turn that repeat are all kept, in
the order of role, then text; null turns come first; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import SLICE_CHARS, arrow_schema, released

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part expands to where it doesn't say so itself: for each image tile, second of audio, page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 224, 64, 25, 512

_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,tokens:int>"
ATTACHMENT = "ordinal int, kind string, ref string, tokens int"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


class PartVisitor:
    """Flattens a message: content() is its formatted content, .attachments what the placeholders stand for."""

    def __init__(self):
        self.out: list[str] = []
        self.run: list[str] = []  # text parts that follow one another
        self.attachments: list[dict] = []

    def content(self) -> str:
        self._close_run()
        return "".join(self.out)

    def _close_run(self) -> None:
        # a run's last "<" stands before a placeholder's "<|" or the end's, and makes no control string with it
        self.out.append(escape("".join(self.run)))
        self.run.clear()

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        tiles = -(-(part.get("width") or TILE) // TILE) * -(-(part.get("height") or TILE) // TILE)
        self._attach("image", part, tiles * TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0) * SECOND_TOKENS)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"no such content part: {part.get('type')}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._close_run()
        self.out.append(f"<|{kind}|>")
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": part.get("tokens") or tokens})


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, where its content starts and ends in it, and its attachments."""
    v = PartVisitor()
    for p in parts:
        v.visit(p)
    head = f"{START}{escape_role(role)}\n"
    body = v.content()
    return f"{head}{body}{END}\n", len(head), len(head) + len(body), v.attachments


def _spans(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of at most `rows` rows and about SLICE_CHARS bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo >= rows or held + size > SLICE_CHARS):
            yield lo, i - lo
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes) - lo


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (equal where a turn isn't the assistant's), attachments, attached_tokens.

    parts_col: a column of array<PART>; without it, or where it is null, the text is the only part.
    """
    schema = T.StructType.fromDDL("conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")
    full = T.StructType([*schema, T.StructField("attachments", T.ArrayType(T.StructType.fromDDL(ATTACHMENT))), T.StructField("attached_tokens", T.LongType())])
    out = pa.schema([*arrow_schema(schema), ("attachments", pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))), ("attached_tokens", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in _spans(batch):
                rows = []
                for r in batch.slice(lo, n).to_pylist():
                    role, parts = r["role"] or "", r["parts"]
                    if parts is None:
                        parts = [{"type": "text", "text": r["text"]}]
                    text, start, end, attached = format_turn(role, parts)
                    if role != "assistant":
                        start = end
                    rows.append((r["conv_id"], r["turn"], role, text, start, end, attached, sum(a["tokens"] for a in attached)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    parts = F.col(f"`{parts_col}`").cast(f"array<{PART}>") if parts_col else F.lit(None).cast(f"array<{PART}>")
    cols = F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"), parts.alias("parts")
    return df.select(*cols).mapInArrow(run, full)


class _Reader:
    """Digests of one conversation, fed with its formatted turns in order."""

    def __init__(self):
        self.turns = self.loss = self.formatted = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, start: int, end: int) -> None:
        for m in _turn.finditer(formatted):
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        if end > start:
            text = unescape(formatted[start:end])
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))
        self.formatted += len(formatted)

    def row(self, conv_id: int) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.formatted


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation of format_turns()."""
    schema = T.StructType.fromDDL("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    out = arrow_schema(schema)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, rows = None, None, []
        for batch in batches:
            for conv_id, text, start, end in zip(*(batch.column(i) for i in range(4)), strict=True):
                conv_id = conv_id.as_py()
                if reader is None or conv_id != now:
                    if reader is not None:
                        rows.append(reader.row(now))
                    now, reader = conv_id, _Reader()
                reader.feed(text.as_py(), start.as_py(), end.as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
                rows = []
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(reader.row(now), out.types, strict=True)], schema=out)

    # ties go by the text as it was, which stands after the role's line without its escapes
    text = F.regexp_replace(F.expr(f"substr(formatted, instr(formatted, '\n') + 1, length(formatted) - instr(formatted, '\n') - {len(END) + 1})"), r"(?s)\\(.)", "$1")
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text).select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)
