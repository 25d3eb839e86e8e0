r"""Format conversations of typed content parts as marked text with a loss mask.

A turn's content is a text, or a list of parts: text, images, audio and documents.  A
visitor takes the parts in order.  Text is escaped; every other part becomes an
unnumbered placeholder, and its reference, its place in the formatted turn and the number
of tokens that a model puts in its stead are recorded beside it.  Placeholders and
attachments meet by their order.

A turn is formatted as ``### role:\n`` body ``</turn>\n``, and a conversation is its turns
one after the other.  Inside texts a backslash is doubled, and one more is put between two
``#``, into ``</turn>`` and into ``<|``, so that neither marks nor placeholders occur in an
escaped text; a role's colons are escaped as well.  Any backslash followed by a character
stands for that character, which undoes all of it.  Texts that stand next to each other are
escaped as one.

The loss mask has the text of turns of the trained role as spans of the formatted turn;
marks and placeholders are outside.

Turns are formatted row by row.  Reading back deals conversations to tasks, sorts their
turns and parses the formatted text alone; digests run along, so of a conversation no more
than a turn is held, however long it is.  A conversation's digest goes through its turns one after the
other, so its turns are read by one task.

Defined cases: a null text is empty, a null role is ''; a null list of parts is empty; a
part without a kind is text; a part of another kind is a placeholder of no tokens; missing
sizes count one tile, second or page; rows of the same conversation and turn go by their
formatted text, so repeated rows repeat; a null turn comes first; null conversations are one
conversation; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

TRAINED = "assistant"
#: Pixels of a tile's side, audio frames of a second, tokens of a page.
TILE, FRAMES, PAGE = 28, 25, 256
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
SPANS = "array<struct<start:int,length:int>>"
ATTACHED = "array<struct<kind:string,uri:string,start:int,tokens:long>>"

OPEN, HEAD, CLOSE = "### ", ":\n", "</turn>\n"
_UNSAFE = re.compile(r"\\|#(?=#)|<(?=/turn>)|<(?=\|)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*?)</turn>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|([a-z]+)\|>")


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda found: found[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Flattens the parts of one turn; ``visit_<kind>`` takes a part of that kind."""

    def __init__(self, role: str | None):
        self.out = [OPEN, escape(role or "").replace(":", "\\:"), HEAD]
        self.length = sum(map(len, self.out))
        self.pending: list[str] = []
        self.texts: list[dict] = []
        self.attached: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(side) or 1) / TILE) for side in ("width", "height"))
        self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 1) * FRAMES))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 1) * PAGE)

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close_text()
        self.attached.append({"kind": part.get("kind"), "uri": part.get("uri"), "start": self.length, "tokens": tokens})
        self.add(f"<|{kind}|>")

    def close_text(self) -> None:
        text = escape("".join(self.pending))
        if text:
            self.texts.append({"start": self.length, "length": len(text)})
            self.add(text)
        self.pending.clear()

    def add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def formatted(self) -> str:
        self.close_text()
        self.add(CLOSE)
        return "".join(self.out)


def format_turns(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", trained: str = TRAINED
) -> DataFrame:
    """``conversation, turn, formatted, loss, attachments, expanded_tokens`` of each turn, row by row.

    ``content`` is a string or an array of parts (fields of PARTS; those that are missing are null).
    """
    listed = isinstance(turns.schema[content].dataType, ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, what in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                visitor = Visitor(who)
                for part in (what or []) if listed else [{"text": what}]:
                    visitor.visit(part or {})
                text = visitor.formatted()
                rows.append((text, visitor.texts if who == trained else [], visitor.attached, sum(a["tokens"] for a in visitor.attached)))
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["conversation", "turn", *names])

    names = ("formatted", "loss", "attachments", "expanded_tokens")
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    part = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("start", pa.int32()), ("tokens", pa.int64())]))
    kinds = (pa.string(), span, part, pa.int64())
    types = [turns.schema[c].dataType.simpleString() for c in (conversation, turn)]
    shape = f"conversation {types[0]}, turn {types[1]}, formatted string, loss {SPANS}, attachments {ATTACHED}, expanded_tokens long"
    return turns.select(*[F.col(c) for c in (conversation, turn, role, content)]).mapInArrow(run, shape)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and body (still escaped, with placeholders) of the turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        out.append((unescape(found[1]), found[2]))
        at = found.end()
    return out


def body_parts(body: str) -> list[tuple[str, str]]:
    """(kind, text) of a body's parts in order; a placeholder has no text."""
    pieces = _PLACEHOLDER.split(body)
    parts = [("text", unescape(piece)) if i % 2 == 0 else (piece, "") for i, piece in enumerate(pieces)]
    return [p for p in parts if p != ("text", "")]


class Reader:
    """What was read back of one conversation so far."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, body in parse(formatted):
            text = "".join(text for _, text in body_parts(body))
            self.digest.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """``conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, done, kind = None, None, [], None

        def out() -> pa.RecordBatch:
            names, rows = zip(*done)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([pa.array(list(names), kind), *columns], names=columns_)

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if reader is None or name != key:
                    if reader is not None:
                        done.append((key, reader.row()))
                    key, reader = name, Reader()
                reader.add(text, loss)
            if len(done) > 10_000:
                yield out()
                done.clear()
        if reader is not None:
            done.append((key, reader.row()))
            yield out()

    columns_ = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    ordered = formatted.select("conversation", "turn", "formatted", "loss").repartition("conversation").sortWithinPartitions("conversation", "turn", "formatted")
    name = formatted.schema["conversation"].dataType.simpleString()
    shape = f"conversation {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conversation", "formatted", "loss").mapInArrow(run, shape)
