"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets, for every row's content hash, k cells of a bit filter that remembers only
cells met at least twice. Pass two tests each row: a row with some cell met once is alone
with its text and goes straight through; only the others ("possibly repeated") shuffle, as
32-byte hashes without their texts. A false positive costs a shuffled row, never a wrong
result, so the filter may have a fixed maximum size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import documents_of, stage

#: The filter is broadcast: 2**26 bits are at most 2**20 words of 64 bits (16 MB of keys and words).
MAX_FILTER_BITS = 1 << 26


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def content_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, sha, n): one row per document; ``rid`` tells repeated rows apart."""
    return documents_of(docs, key, text).select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"),
        F.length("text").cast("long").alias("n"),
    )


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    bits = 1 << 12
    while bits < min(rows * bits_per_row, max_bits):
        bits *= 2
    return min(bits, max_bits)


def repeated_cells(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the filter's 64-bit words that have a cell set at least twice; at most bits / 64 rows."""
    cells = keys.select(F.explode(F.array(*[cell(F.col("sha"), i, bits) for i in range(hashes)])).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    return twice.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("mask")
    )


def cell(sha: Column, i: int, bits: int) -> Column:
    return F.xxhash64(sha, F.lit(i)).bitwiseAND(F.lit(bits - 1))


def with_possibly_repeated(keys: DataFrame, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Adds ``maybe``: all of the row's cells were met at least twice."""
    out, tests = keys, []
    for i in range(hashes):
        at = cell(F.col("sha"), i, bits)
        out = out.withColumns({f"word{i}": F.shiftright(at, 6), f"bit{i}": at.bitwiseAND(F.lit(63)).cast("int")})
    for i in range(hashes):
        side = words.select(F.col("word").alias(f"word{i}"), F.col("mask").alias(f"mask{i}"))
        out = out.join(F.broadcast(side), f"word{i}", "left")
        tests.append(f"coalesce(getbit(mask{i}, bit{i}), 0) = 1")
    return out.select("rid", "doc_id", "sha", "n", F.expr(" AND ".join(tests)).alias("maybe"))


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bits_per_row: int = 16,
    hashes: int = 2,
    max_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, possibly_repeated.

    Texts are equal when they are equal without ``[\\x20\\x09-\\x0D]``; a null text is empty, and
    all texts of white space only are one group. Of a group, the row with the most code points in
    the original text stays, then the smallest ``key`` (a null key comes last); of rows that repeat
    with the same key and length exactly one stays. An empty table gives an empty result; other
    columns are ignored.

    A group of any size is one row after the partial aggregation, and the join that brings it
    back to its members has a plain shuffle on both sides, which adaptive execution can split.
    """
    keys = stage(content_keys(docs, key, text), "content-keys")
    bits = filter_bits(keys.count(), bits_per_row, max_bits)
    words = stage(repeated_cells(keys, bits, hashes), "bloom-words")
    tested = with_possibly_repeated(keys, words, bits, hashes)
    alone = tested.filter("NOT maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "sha",
        "maybe",
    )
    # ~x orders like -x and cannot overflow; a null key gives a null, the smallest value, and so loses
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("k"), F.bitwise_not("rid").alias("r")))
    groups = stage(
        tested.filter("maybe").groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")),
        "repeated-groups",
    )
    suspects = tested.filter("maybe").join(groups, "sha").select(
        "doc_id",
        F.bitwise_not("best.k").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.bitwise_not("best.r")).alias("kept"),
        "sha",
        "maybe",
    )
    return alone.unionByName(suspects).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("maybe").alias("possibly_repeated"),
    )
