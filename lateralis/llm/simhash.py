"""SimHash near-dedup with an inverted index of byte positions and count filtering.

The fingerprint of a text has a bit where more than half of its three-word shingles' hashes have one.
Fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at least
six positional bytes. The index posts each distinct fingerprint under its positional bytes, several positions to a
term, as the list of a single one would hold every 256th text of a corpus: six terms of four positions each, such that
whichever two bytes differ, some term has neither. Two postings of a term are a candidate pair; their shared
positional bytes are tallied, pairs below the guaranteed six go, the others are verified bit by bit.

A list that is longer than ``LIST`` is posted again under terms of six positions, which every pair has that passes the
count filter. What is still longer holds fingerprints equal but for two bytes, 65,536 at most; there each looks up
the values at one or two bits from its own. So no list of any length is paired with itself, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateralis.llm.near_dedup import components
from lateralis.llm.shared import documents_of, scratch, smaller_batches, stage
from lateralis.llm.wordhash import IS_SPACE, LOWER, blocks, buffers, runs

SEED, WORDS = 42, 3
#: Bits that linked fingerprints differ in at most, and the positional bytes that such a pair shares at least.
BITS, LEAST = 2, 6
#: Longest list whose postings are paired.
LIST = 64
#: Fixed values of XXH64: its five primes.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Shingles whose bits are counted at once, 64 bytes each.
AT_ONCE = 1 << 16


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of the byte ranges of ``data``, those under 32 bytes all at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    out = np.zeros(len(start), dtype=np.uint64)
    long = np.flatnonzero(length >= 32)
    if len(long):
        whole = data.tobytes()
        out[long] = [xxhash.xxh64_intdigest(whole[a:a + n], SEED) for a, n in zip(start[long].tolist(), length[long].tolist(), strict=True)]
    short = np.flatnonzero(length < 32)
    p, n = start[short], length[short]
    h = n.astype(np.uint64) + np.uint64(SEED) + P5
    for lane in range(3):
        at = np.flatnonzero(n >= 8 * lane + 8)
        h[at] = _rotated(h[at] ^ (_rotated(eight[p[at] + 8 * lane] * P2, 31) * P1), 27) * P1 + P4
    at = np.flatnonzero(n & 4)
    h[at] = _rotated(h[at] ^ (four[p[at] + (n[at] & ~7)].astype(np.uint64) * P1), 23) * P2 + P3
    for last in range(3):
        at = np.flatnonzero((n & 3) > last)
        h[at] = _rotated(h[at] ^ (padded[p[at] + (n[at] & ~3) + last].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    out[short] = h ^ (h >> np.uint64(32))
    return out


def shingle_ranges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, length, ptr): lower-cased words one space apart, and each text's shingles in them."""
    raw, offsets = buffers(texts)
    low = LOWER[raw]
    inside = ~IS_SPACE[low]
    starts, ends, ptr = runs(inside, offsets)
    sizes = ends - starts
    data = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)
    data[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = low[inside]
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    n = np.diff(ptr)
    counts = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    own = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(n)), counts)
    word = ptr[:-1][text] + (np.arange(own[-1]) - own[:-1][text])
    last = np.minimum(word + WORDS, ptr[1:][text]) - 1
    return data, first[word], first[last] + sizes[last] - first[word], own


def fingerprints_of(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Per text the bits that more than half of its hashes have; zero without hashes."""
    n = np.diff(ptr)
    set_bits = np.zeros((len(n), 64), dtype=np.int64)
    text = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[at:at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = text[at:at + AT_ONCE]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        set_bits[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    over = (2 * set_bits > n[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; a null text, and one without words, has zero."""
    smaller_batches(docs.sparkSession, 250)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, start, length, ptr = shingle_ranges(batch.column(1))
            fp = fingerprints_of(xxh64(data, start, length), ptr)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents_of(docs, key, text).mapInArrow(made, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    """The bytes at these positions, as a signed number."""
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


#: Any two positions lie in two of four neighbouring pairs, so one term of two other pairs has neither.
FOURS = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]
SIXES = list(combinations(range(8), LEAST))


def postings(nodes: DataFrame, terms: list[tuple[int, ...]]) -> DataFrame:
    """(term, bytes, fp): every fingerprint under the bytes at each term's positions."""
    each = F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes")) for t, p in enumerate(terms)]))
    return nodes.select(each.alias("x"), "fp").select("x.term", "x.bytes", "fp")


def shared_bytes(differing: Column) -> Column:
    """How many of the eight bytes of ``a ^ b`` are equal in both."""
    same = [(F.shiftright(differing, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8)]
    return sum(same[1:], same[0])


def listed(posted: DataFrame, label: str) -> DataFrame:
    """``posted`` with the length ``n`` of its list; lists of one go. Staged."""
    lengths = posted.groupBy("term", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stage(posted.join(lengths, ["term", "bytes"]), label)


def verified(lists: DataFrame) -> DataFrame:
    """(a, b): the pairs in lists of at most ``LIST`` that share enough positional bytes and differ in few enough bits."""
    short = lists.filter(F.col("n") <= LIST)
    pairs = short.select("term", "bytes", F.col("fp").alias("a")).join(short.select("term", "bytes", F.col("fp").alias("b")), ["term", "bytes"])
    differing = F.col("a").bitwiseXOR(F.col("b"))
    kept = pairs.filter("a < b").filter(shared_bytes(differing) >= LEAST)  # the count filter
    return kept.filter(F.bit_count(differing) <= BITS).select("a", "b")


def looked_up(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): for fingerprints in lists longer than ``LIST`` of terms of six, those at one or two bits within the two other bytes."""
    flips = []
    for positions in SIXES:
        free = [8 * p + bit for p in range(8) if p not in positions for bit in range(8)]
        values = [1 << i for i in free] + [(1 << i) | (1 << j) for i, j in combinations(free, 2)]
        flips.append(F.array(*[F.lit(v - (1 << 64) if v >> 63 else v) for v in values]))
    long = lists.filter(F.col("n") > LIST)
    by_term = F.create_map(*[x for t, values in enumerate(flips) for x in (F.lit(t), values)])
    probes = long.select("fp", F.explode(F.element_at(by_term, F.col("term"))).alias("flip"))
    probes = probes.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("other")).filter("other < fp")
    return probes.join(nodes.select(F.col("fp").alias("other")), "other").select(F.col("other").alias("a"), F.col("fp").alias("b"))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints (``fp``) that are at most two bits apart. Staged."""
    first = listed(postings(nodes, FOURS), "postings")
    long = first.filter(F.col("n") > LIST).select("fp").distinct()
    second = listed(postings(long, SIXES), "long-postings")
    found = verified(first).unionByName(verified(second)).unionByName(looked_up(second, nodes))
    return stage(found.distinct(), "simhash-links")


def simhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row, staged.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of one or two words is one shingle; texts without words, null
    ones too, have fingerprint zero and are linked like others. ``component_id`` is the smallest key that is reachable over
    fingerprints at most two bits apart; null keys are never the smallest, and a component of null keys has a null one.
    Repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        found = stage(fingerprints(docs, key, text), "fingerprints")
        nodes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
        comps = components(links(nodes.select("fp")))
        named_nodes = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        named_nodes = stage(named_nodes, "component-nodes")
        least = named_nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
        classes = stage(named_nodes.select("fp", "comp").join(least, "comp").select("fp", "component_id"), "fingerprint-classes")
        out = found.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
        return stage(out, "simhash-classes", keep=True)
