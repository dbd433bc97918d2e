"""Words of a block of texts as 64-bit hashes, in numpy over Arrow's own buffers.

A word is a run of ASCII digits, ASCII letters (A-Z lower-cased) and all code points from U+0080
on; in UTF-8 that is a run of bytes, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the arrays below take some 40 bytes for each. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[9:14] = IS_SPACE[32] = True

_random = np.random.default_rng(7)
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
BASE = 6364136223846793005
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


@dataclass
class Words:
    """``starts`` and ``ends`` are byte positions in the block; the words of text i are ptr[i]:ptr[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text starts, from 0."""
    texts = texts.cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total, first = 0, 0
        for i, n in enumerate(np.asarray(lengths, dtype=np.int64)):
            if i > first and total + n > size:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        yield batch.slice(first)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text pointers of the runs of True, none across two texts."""
    full = offsets[1:] > offsets[:-1]
    before, after = np.zeros(len(inside), dtype=bool), np.zeros(len(inside), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(texts: pa.Array, member: np.ndarray = IS_WORD) -> Words:
    """The words of each text; ``member`` says which (lower-cased) bytes belong to words."""
    data, offsets = buffers(texts)
    low = LOWER[data]
    starts, ends, ptr = runs(member[low], offsets)
    up, down = powers(len(low))
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[low] * up[:len(low)], out=total[1:])
    return Words(starts, ends, ptr, mix((total[ends] - total[starts]) * down[starts]))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ptr) of each text's runs of ``size`` words; a shorter text that has words is one run."""
    n = np.diff(words.ptr)
    h = words.hashes
    acc = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        acc += h[j:len(h) - size + 1 + j] * PLACE[j] if len(acc) else acc
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    ptr = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ptr[-1], dtype=np.uint64)
    text = np.repeat(np.arange(len(n)), counts)
    at = words.ptr[:-1][text] + (np.arange(len(out)) - ptr[:-1][text])
    long = n[text] >= size
    out[long] = acc[at[long]]
    for i in np.flatnonzero((n > 0) & (n < size)):
        own = h[words.ptr[i]:words.ptr[i + 1]]
        out[ptr[i]] = np.sum(own * PLACE[size:size + len(own)], dtype=np.uint64)
    return mix(out), ptr
