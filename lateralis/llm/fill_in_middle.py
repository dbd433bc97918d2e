"""Fill-in-the-middle: prefix, middle and suffix rearranged by a secondary sort of pieces.

Each text is cut into units (code points) and emitted as pieces of at most ``PIECE`` units, keyed by its row and
the place of the piece in the output. The pieces are repartitioned by row and sorted within partitions by
(row, output place), so that a task streams them straight into a digest of the output and holds one piece
at a time, however long the text. The same stream is read as output: what it says between its marks tells
prefix, middle and suffix apart, and a second sort within the same partitions, without another shuffle, brings them
back into the order of the text for the digest of the restoration.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import named, smaller_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile("<[PSM]>")
#: Place of each part in the text and its mark; and the order of the parts in each form.
PARTS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
FORMS = {"plain": [], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}
#: Units in a piece.
PIECE = 1 << 14

PIECES_TYPE = "row long, doc_id long, form string, n long, prefix_chars long, middle_chars long, place long, piece string, output_sha256 string"
PIECES = pa.schema([
    *[(c, pa.int64()) for c in ("row", "doc_id")], ("form", pa.string()), *[(c, pa.int64()) for c in ("n", "prefix_chars", "middle_chars", "place")],
    ("piece", pa.string()), ("output_sha256", pa.string())])
DONE_TYPE = (
    "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, restored_chars long")
DONE = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("restored_chars", pa.int64())])
#: Units of pieces, and rows, that are sent on together.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 512


def choices(key: int | None, seed: int = 1) -> list[int]:
    """The four numbers that a document's key draws; a null key counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def cuts(key: int | None, text: str, plain_share: int = 10, spm_share: int = 20) -> tuple[str, int, int]:
    """(form, first cut, second cut) of a text."""
    h = choices(key)
    low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or MARK.search(text) or h[2] % 100 >= 100 - plain_share:
        return "plain", low, high
    return ("spm" if h[3] % 100 < spm_share else "psm"), low, high


def pieces_of(text: str, form: str, low: int, high: int, size: int) -> Iterator[str]:
    """The output's pieces in order; a mark begins a piece."""
    spans = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(text))}
    for mark, (a, b) in [("", (0, len(text)))] if form == "plain" else [(m, spans[m]) for m in FORMS[form]]:
        yield mark + text[a:min(b, a + size)]
        for at in range(a + size, b, size):
            yield text[at:min(b, at + size)]


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("piece") or "")
        if len(held) == BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def pieces(docs: DataFrame, key: str, text: str, size: int, plain_share: int, spm_share: int) -> DataFrame:
    """The pieces of every output in the order of (row, place), all of a row in one partition."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), named(key).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for row in _rows(batches):
                whole = row["text"]
                form, low, high = cuts(row["doc_id"], whole, plain_share, spm_share)
                head = {"row": row["row"], "doc_id": row["doc_id"], "form": form, "n": len(whole)}
                if form != "plain":
                    head |= {"prefix_chars": low, "middle_chars": high - low}
                for place, piece in enumerate(pieces_of(whole, form, low, high, size)):
                    yield head | {"place": place, "piece": piece}

        return _batches(made(), PIECES)

    return rows.mapInArrow(emit, PIECES_TYPE).repartition("row").sortWithinPartitions("row", "place")


def outputs(ordered: DataFrame) -> DataFrame:
    """Digests the outputs of sorted ``pieces`` and passes on what they say: each piece without its mark, at the place
    that it has in the text by the mark last read; the last one carries the digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            held, sha, part = None, None, 0
            for row in _rows(batches):
                if held and held["row"] != row["row"]:
                    yield held | {"output_sha256": sha.hexdigest()}
                    held = None
                if held is None:
                    sha, part = hashlib.sha256(), 0
                else:
                    yield held
                sha.update(row["piece"].encode())
                if row["form"] != "plain" and (mark := MARK.match(row["piece"])):
                    part = PARTS[mark[0]]
                    row["piece"] = row["piece"][mark.end():]
                held = row | {"place": (part << 48) + row["place"]}
            if held:
                yield held | {"output_sha256": sha.hexdigest()}

        return _batches(made(), PIECES)

    return ordered.mapInArrow(read, PIECES_TYPE)


def restored(read: DataFrame) -> DataFrame:
    """One row per document: ``outputs`` sorted again in the same partitions, in the order of the text, and digested."""
    ordered = read.sortWithinPartitions("row", "place")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            out, sha = None, None
            for row in _rows(batches):
                if out and out["row"] != row["row"]:
                    yield out | {"restored_sha256": sha.hexdigest()}
                    out = None
                if out is None:
                    sha = hashlib.sha256()
                    out = {c: row[c] for c in ("row", "doc_id", "n", "form", "prefix_chars", "middle_chars")} | {"restored_chars": 0}
                sha.update(row["piece"].encode())
                out["restored_chars"] += len(row["piece"])
                out["output_sha256"] = row["output_sha256"] or out.get("output_sha256")
            if out:
                yield out | {"restored_sha256": sha.hexdigest()}

        return _batches(made(), DONE)

    return ordered.mapInArrow(fold, DONE_TYPE)


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = PIECE, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """(row, doc_id, form, ..., place, piece): the outputs themselves, in pieces sorted by (row, place).

    The pieces of a row, one after the other, are its output. A null text is empty and plain; a null key draws like an
    empty text; repeated rows are outputs of their own; other columns are ignored; an empty table gives no rows.
    ``plain_share`` and ``spm_share`` are percentages: of documents left plain, and of the others that are spm.
    """
    smaller_batches(docs.sparkSession, 250)
    return pieces(docs, key, text, size, plain_share, spm_share).drop("output_sha256")


def round_trips(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = PIECE, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """One row per document: its form and cuts, the digest of its output, and that of the text restored from output and form alone.

    Odd inputs as in ``transformed``.
    """
    smaller_batches(docs.sparkSession, 250)
    return restored(outputs(pieces(docs, key, text, size, plain_share, spm_share))).drop("row")
