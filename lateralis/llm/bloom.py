"""A Bloom filter of 64-bit words as a small table, built and tested with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateralis.llm.shared import named, stage

#: 2**26 bits are at most 2**20 words (16 MB with their keys): the bound of every broadcast here.
MAX_BITS = 1 << 26


def bits_for(rows: int, per_row: int = 16, most: int = MAX_BITS) -> int:
    bits = 1 << 12
    while bits < min(rows * per_row, most):
        bits *= 2
    return min(bits, most)


def _cell(key: Column, i: int, bits: int) -> Column:
    return F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1))


def build(keys: DataFrame, column: str, bits: int, hashes: int = 2) -> DataFrame:
    """(word, mask) of the non-empty words; at most bits / 64 rows."""
    cells = keys.select(F.explode(F.array(*[_cell(F.col(column), i, bits) for i in range(hashes)])).alias("cell"))
    return cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("mask"))


def tested(rows: DataFrame, column: Column, words: DataFrame, bits: int, into: str, hashes: int = 2) -> DataFrame:
    """Adds ``into``: whether the key may be in the filter. False is certain."""
    out, hits = rows, F.lit(True)
    for i in range(hashes):
        word, mask = f"__word{i}__", f"__mask{i}__"
        out = out.withColumn(word, F.shiftright(_cell(column, i, bits), 6))
        out = out.join(F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask))), word, "left")
        bit = F.call_function("getbit", F.col(mask), _cell(column, i, bits).bitwiseAND(F.lit(63)).cast("int"))
        hits = hits & (F.coalesce(bit, F.lit(0)) == 1)
    return out.withColumn(into, hits).drop(*[f"__{x}{i}__" for i in range(hashes) for x in ("word", "mask")])


def without(rows: DataFrame, key: Column, gone: DataFrame, column: str) -> DataFrame:
    """``rows`` whose key is not in ``gone``; only rows that the filter cannot clear are shuffled.

    ``gone`` is a staged table; rows with a null key stay.
    """
    bits = bits_for(gone.count())
    words = stage(build(gone, column, bits), "gone-filter")
    into, own = "__maybe__", "__key__"
    split = tested(rows.withColumn(own, key), F.col(own), words, bits, into)
    side = gone.select(F.col(column).alias(own)).distinct()
    met = split.filter(into).join(side, own, "left_anti")
    columns = [named(c) for c in rows.columns]
    return split.filter(~F.col(into)).select(*columns).unionByName(met.select(*columns))
