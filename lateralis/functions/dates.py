"""Dates as nullable parts, buckets and axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(text: Column) -> Column:
    """struct(year, month, day) of ``Y-M-D``, ``M/D/Y`` or ``Y``; nulls where unknown or not a date text."""
    def piece(sep: str, i: int) -> Column:
        return F.get(F.split(text, sep), F.lit(i)).try_cast("int")

    dashed, slashed = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    bare = text.rlike(r"^\d{4}$")
    return F.struct(
        F.when(dashed | bare, piece("-", 0)).when(slashed, piece("/", 2)).alias("year"),
        F.when(dashed, piece("-", 1)).when(slashed, piece("/", 0)).alias("month"),
        F.when(dashed, piece("-", 2)).when(slashed, piece("/", 1)).alias("day"))


def floor_bucket(value: Column, width: int, least: int = 1) -> Column:
    """The start of the bucket of ``width`` values, counted from ``least``."""
    return (least + F.floor((value - least) / width) * width).cast("int")


def label(year: Column, month: Column) -> Column:
    """``Y/M``, null if a part is."""
    return F.concat(year.cast("string"), F.lit("/"), month.cast("string"))
