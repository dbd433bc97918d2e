"""Chat formatting: typed content parts, a turn template, and a loss mask.

A conversation is formatted turn by turn, as a stream of segments in order; their
concatenation is the formatted conversation. A visitor flattens the parts of a turn: texts are
escaped, attachments become ordered placeholders with a reference and an expanded token count.
Rows are shuffled once by conversation and sorted; a task holds one turn at a time, so a
conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import named, smaller_batches

#: Type of a column of typed parts. Text parts use ``text``; the others ``ref`` and their own measure.
PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+:\d+\|>")
WORD = re.compile(r"\w+|[^\w\s]")

SEGMENTS_TYPE = (
    "conv_id long, turn_index long, segment string, segment_start long, loss_start long, loss_end long, "
    "n_tokens long, attachments array<struct<position:long,kind:string,ref:string,tokens:long>>"
)
READ_TYPE = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long, n_tokens long"
)


def escape(text: str) -> str:
    """No ``<|`` is left: each ``<``, backslashes, ``|`` gets one backslash more. Reversible for all texts."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens the parts of one conversation; attachments are numbered through all its turns."""

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 600):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.seen = 0

    def visit(self, part: dict, found: list[dict]) -> tuple[str, int]:
        """The flattened text and its token count; a part of an unknown or null kind counts as text."""
        return getattr(self, f"visit_{part.get('kind')}", self.visit_text)(part, found)

    def visit_text(self, part: dict, found: list[dict]) -> tuple[str, int]:
        text = part.get("text") or ""
        return escape(text), len(WORD.findall(text))

    def visit_image(self, part: dict, found: list[dict]) -> tuple[str, int]:
        tiles = [math.ceil(max(part.get(side) or 0, 1) / self.patch) for side in ("width", "height")]
        return self.attach("image", part, tiles[0] * tiles[1], found)

    def visit_audio(self, part: dict, found: list[dict]) -> tuple[str, int]:
        return self.attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)), found)

    def visit_document(self, part: dict, found: list[dict]) -> tuple[str, int]:
        return self.attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens, found)

    def attach(self, kind: str, part: dict, tokens: int, found: list[dict]) -> tuple[str, int]:
        found.append({"position": self.seen, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        mark = f"<|{kind}:{self.seen}:{tokens}|>"
        self.seen += 1
        return mark, tokens


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("turn_index", pa.int64()), ("segment", pa.string()), ("segment_start", pa.int64()),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_tokens", pa.int64()),
    ("attachments", pa.list_(pa.struct([
        ("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
])
READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()),
    ("n_tokens", pa.int64()),
])


def format_conversations(rows: DataFrame, parts: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per turn, in order within its conversation: the formatted segment, its start in the
    conversation, the masked range (null for other roles), token count and attachments.

    ``rows`` has conv_id, turn, role, text; with ``parts``, a column of ``PARTS_TYPE`` replaces text.
    Null role, text or parts are empty. A null conv_id is a conversation of its own; null turns come
    first; rows with equal turns stay in the order of role, then text. Repeated rows are turns of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    smaller_batches(rows.sparkSession)
    content = named(parts).cast(PARTS_TYPE) if parts else F.array(
        F.struct(F.lit("text").alias("kind"), named("text").alias("text")))
    turns = rows.select(
        named("conv_id").cast("long").alias("conv_id"),
        named("turn").cast("long").alias("turn"),
        F.coalesce(named("role"), F.lit("")).alias("role"),
        F.to_json(content).alias("tie") if parts else F.coalesce(named("text"), F.lit("")).alias("tie"),
        content.alias("parts"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").drop("tie")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            conv, visitor, index, at = object(), PartVisitor(), 0, 0
            for row in _rows(batches):
                if row["conv_id"] != conv:
                    conv, visitor, index, at = row["conv_id"], PartVisitor(), 0, 0
                found: list[dict] = []
                flat = [visitor.visit(part or {}, found) for part in row["parts"] or []]
                head, body = f"{START}{escape_role(row['role'])}\n", "".join(x for x, _ in flat)
                segment = f"{head}{body}{END}\n"
                masked = row["role"] == loss_role
                yield {
                    "conv_id": conv, "turn_index": index, "segment": segment, "segment_start": at,
                    "loss_start": at + len(head) if masked else None,
                    "loss_end": at + len(head) + len(body) if masked else None,
                    "n_tokens": sum(n for _, n in flat), "attachments": found,
                }
                index, at = index + 1, at + len(segment)

        return _batches(made(), SEGMENTS)

    return ordered.mapInArrow(segments, SEGMENTS_TYPE)


def joined(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one string, where a conversation fits in a row."""
    pieces = F.sort_array(F.collect_list(F.struct("turn_index", "segment")))
    return segments.groupBy("conv_id").agg(
        F.array_join(F.transform(pieces, lambda x: x["segment"]), "").alias("formatted"))


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted output alone: turns, masked text, lengths.

    Expects what ``format_conversations`` returns, in its order (no shuffle is added). Placeholders
    stay in a turn's text as they are written.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(conv, state) -> dict:
            return {"conv_id": conv, "n_turns": state["turns"], "turns_sha256": state["all"].hexdigest(),
                    "loss_chars": state["loss_chars"], "loss_sha256": state["loss"].hexdigest(),
                    "formatted_chars": state["chars"], "n_attachments": state["attachments"],
                    "n_tokens": state["tokens"]}

        def made() -> Iterator[dict]:
            conv, state = None, None
            for row in _rows(batches):
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        yield closed(conv, state)
                    conv = row["conv_id"]
                    state = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0,
                             "chars": 0, "attachments": 0, "tokens": 0}
                segment = row["segment"]
                for role, body in TURN.findall(segment):
                    state["turns"] += 1
                    state["all"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                    state["attachments"] += len(PLACEHOLDER.findall(body))
                if row["loss_start"] is not None:
                    at = row["segment_start"]
                    masked = unescape(segment[row["loss_start"] - at:row["loss_end"] - at])
                    state["loss"].update(masked.encode())
                    state["loss_chars"] += len(masked)
                state["chars"] += len(segment)
                state["tokens"] += row["n_tokens"]
            if state is not None:
                yield closed(conv, state)

        return _batches(made(), READ)

    return segments.mapInArrow(digests, READ_TYPE)
