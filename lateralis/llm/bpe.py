"""Byte-level BPE by tree concatenation, exact against encoding each text whole.

A text of at most ``leaf_chars`` code points is one leaf. A longer one is halved and halved again
into leaves, which are shuffled apart and encoded in parallel; the leaves of a text then meet
again and neighbours are joined pairwise, level by level. At each join a window of the last and
first few tokens is encoded anew and grows until it agrees with both sides.

Why agreement is enough: a token sequence is the BPE encoding of a run of text when each adjacent
pair is, and the kept edge tokens stood next to their neighbours in an encoding before. Pieces of
text that a space separates from what precedes it are encoded independently.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import documents_of, smaller_batches

#: Fixed values of the public vocabulary: its one special token, and the pattern that splits text.
SPECIAL = {"<|endoftext|>": 50256}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BEFORE_SPACE = re.compile(r"\S(?=[ \n])")
INSIDE_WORD = re.compile(r"\S(?=\S)")
RESULT_TYPE = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST_TYPE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_leaves int, widened int"
LEAF_TYPE = "rid long, doc_id long, leaf int, text string"
CODE_TYPE = "rid long, doc_id long, leaf int, ids binary"


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encodes and decodes one piece of text; ids are arrays of uint32."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        size = max(*ranks.values(), *SPECIAL.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in SPECIAL.items())]:
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(size)]

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode(text, allowed_special="all"), dtype=np.uint32)

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def join(self, left: np.ndarray, right: np.ndarray, start: int = 4) -> tuple[np.ndarray, int]:
        """The encoding of both texts together, and how often the window had to grow."""
        if not len(left) or not len(right):
            return np.concatenate([left, right]), 0
        k, grown = start, 0
        while True:
            a, b = self.edge(left, k, False), self.edge(right, k, True)
            whole_left, whole_right = a == len(left), b == len(right)
            window = self.raw(left[len(left) - a:]) + self.raw(right[:b])
            ids = self.encode(window.decode("utf-8"))
            if (whole_left or self.agree(ids, left[len(left) - a:])) and (
                whole_right or self.agree(ids[::-1], right[:b][::-1])
            ):
                return np.concatenate([left[:len(left) - a], ids, right[b:]]), grown
            k, grown = 2 * k, grown + 1

    def edge(self, ids: np.ndarray, k: int, after: bool) -> int:
        """At least k tokens from the join, before it or ``after`` it, out to where a character begins."""
        k = min(k, len(ids))
        while k < len(ids):
            first = self.bytes_of[int(ids[k] if after else ids[len(ids) - k])][0]
            if first & 0xC0 != 0x80:
                return k
            k += 1
        return k

    def agree(self, ids: np.ndarray, side: np.ndarray) -> bool:
        """The window keeps the outer half of the side's tokens; in that half white space must not be all."""
        n = max(2, len(side) // 2)
        outer = side[:n]
        return len(ids) > n and np.array_equal(ids[:n], outer) and any(
            self.bytes_of[int(i)].strip() for i in outer)


@lru_cache(maxsize=2)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


def cut(text: str, low: int, high: int) -> int | None:
    """A place near the middle of text[low:high]: before a space if one is near, else inside a word.

    Never inside a special token's string nor within white space; None if there is no such place.
    """
    middle = (low + high) // 2
    for pattern, start, end in (
        (BEFORE_SPACE, middle, middle + (high - low) // 8), (INSIDE_WORD, middle, high), (BEFORE_SPACE, middle, high),
        (BEFORE_SPACE, low, middle), (INSIDE_WORD, low, middle),
    ):
        for found in pattern.finditer(text, start, end):
            at = found.end()
            if low < at < high and not any(
                s in text[max(0, at - len(s) + 1):at + len(s) - 1] for s in SPECIAL
            ):
                return at
    return None


def halves(text: str, leaf_chars: int) -> list[str]:
    """The leaves of a text, in order."""
    out, todo = [], [(0, len(text))]
    while todo:
        low, high = todo.pop()
        at = cut(text, low, high) if high - low > leaf_chars else None
        if at is None:
            out.append(text[low:high])
        else:
            todo += [(at, high), (low, at)]
    return out


def concatenate(c: Codec, leaves: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Joins neighbours pairwise until one sequence is left."""
    widened = 0
    while len(leaves) > 1:
        made = []
        for i in range(0, len(leaves) - 1, 2):
            ids, grown = c.join(leaves[i], leaves[i + 1])
            made.append(ids)
            widened += grown
        leaves = made + leaves[len(leaves) // 2 * 2:]
    return leaves[0], widened


def digest(c: Codec, doc_id, ids: np.ndarray, n_leaves: int, widened: int) -> dict:
    return {
        "doc_id": doc_id, "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(",".join(map(c.decimal.__getitem__, ids.tolist())).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(c.decode(ids).encode()).hexdigest(),
        "n_leaves": n_leaves, "widened": widened,
    }


def full(c: Codec, doc_id, ids: np.ndarray, n_leaves: int, widened: int) -> dict:
    return {"doc_id": doc_id, "n_tokens": len(ids), "ids": ids.tobytes(), "decoded": c.decode(ids)}


def _schema(kind: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in kind.split(", "))])


def encode_decode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ranks_path: str | None = None,
    leaf_chars: int = 16384,
    digests: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (uint32, little endian), decoded; or digests of both.

    Null texts are empty and have no tokens; repeated documents each get their row; the string of a
    special token is that token, as the tokenizers library has it by default. Other columns are
    ignored; an empty table gives no rows.
    """
    path = ranks_path or default_ranks_path()
    smaller_batches(docs.sparkSession, 500)
    kind, made = (DIGEST_TYPE, digest) if digests else (RESULT_TYPE, full)
    texts = documents_of(docs, key, text)
    long = F.length("text") > leaf_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = codec(path), _schema(kind)
        for batch in batches:
            rows = [made(c, d, c.encode(t), 1, 0) for d, t in zip(*batch.to_pydict().values(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(LEAF_TYPE)
        for batch in batches:
            for rid, d, t in zip(*batch.to_pydict().values(), strict=True):
                yield pa.RecordBatch.from_pylist(
                    [{"rid": rid, "doc_id": d, "leaf": i, "text": x} for i, x in enumerate(halves(t, leaf_chars))], schema)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = codec(path), _schema(CODE_TYPE)
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([r | {"ids": c.encode(r.pop("text")).tobytes()} for r in rows], schema)

    def tree(group: pa.Table) -> pa.Table:
        c = codec(path)
        rows = group.sort_by("leaf").to_pydict()
        ids, widened = concatenate(c, [np.frombuffer(x, np.uint32) for x in rows["ids"]])
        return pa.Table.from_pylist([made(c, rows["doc_id"][0], ids, len(rows["leaf"]), widened)], _schema(kind))

    whole = texts.filter(~long).mapInArrow(short, kind)
    pieces = texts.filter(long).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    pieces = pieces.mapInArrow(leaves, LEAF_TYPE).repartition(F.col("rid"), F.col("leaf")).mapInArrow(encoded, CODE_TYPE)
    return whole.unionByName(pieces.groupBy("rid").applyInArrow(tree, kind))
