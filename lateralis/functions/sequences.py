"""Sequence expressions: reverse complement, cleaning, masking, cutting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Reversed and complemented; anything but capital ACGT becomes N."""
    swapped = F.translate(F.reverse(seq), "ACGT", "TGCA")
    return F.regexp_replace(swapped, "[^ACGT]", "N")


def cased_reverse_complement(seq: Column) -> Column:
    """As above in the case of the first character after reversal: other-case letters become N or n."""
    turned = F.reverse(seq)
    small = F.substring(turned, 1, 1).rlike("^[a-z]")
    low = F.regexp_replace(F.translate(turned, "acgt", "tgca"), "[^acgt]", "n")
    return F.when(small, low).otherwise(F.regexp_replace(F.translate(turned, "ACGT", "TGCA"), "[^ACGT]", "N"))


def clean(seq: Column) -> Column:
    """Anything but ACGTN and gaps becomes N."""
    return F.regexp_replace(seq, "[^ACGTN-]", "N")


def gaps(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit("-"), F.lit("")))).cast("long")


def mask(seq: Column, start: Column, end: Column, inclusive_end: bool = False) -> Column:
    """Gaps from start (from 1) up to end, the last position left as it is unless ``inclusive_end``."""
    n = F.greatest(F.least(end, F.length(seq)) - start + (1 if inclusive_end else 0), F.lit(0))
    return F.when(n > 0, F.overlay(seq, F.repeat(F.lit("-"), n), start, n)).otherwise(seq)


def gene(contig: Column, start: Column, end: Column, strand: Column) -> Column:
    """The bases from start to end, counted from 0 and both included; reverse complement on "-"."""
    part = F.substring(contig, start + 1, end - start + 1)
    return F.when(strand == "-", reverse_complement(part)).otherwise(part)
