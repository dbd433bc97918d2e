"""Gene tables, clusters of genes and alignments.

``genes``: genome, contig, gene_id; ``members``: cluster, gene_id; ``alignment``: algn, seq_id, seq.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lateralis.functions import sequences
from lateralis.session import dealt


def assign_clusters(genes: DataFrame, members: DataFrame) -> DataFrame:
    """``genes`` with their cluster: the last where a gene is in several, 0 where it is in none."""
    last = members.groupBy("gene_id").agg(F.max("cluster").alias("cluster"))
    return genes.join(last, "gene_id", "left").fillna(0, ["cluster"])


def cluster_sequences(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """(cluster, gene_id, seq): the sequences of each cluster, null where a gene has none."""
    n = members.count()
    rows = dealt(members.select("cluster", "gene_id"), n, "gene_id").distinct()
    return rows.join(dealt(seqs.select("gene_id", "seq"), n, "gene_id"), "gene_id", "left").select("cluster", "gene_id", "seq")


def incomplete_clusters(rows: DataFrame) -> DataFrame:
    """(cluster, n_ids, n_seqs) of clusters whose ids and sequences differ in number."""
    each = rows.groupBy("cluster", "gene_id").agg(F.count("seq").alias("n"))
    n = each.groupBy("cluster").agg(F.count("gene_id").alias("n_ids"), F.sum("n").alias("n_seqs"))
    return n.filter("n_ids <> n_seqs")


def cut_genes(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """``genes`` (genome, contig, start, end, strand) with ``seq`` cut from ``contigs`` (genome, contig, seq)."""
    rows = genes.join(contigs.withColumnRenamed("seq", "__contig__"), ["genome", "contig"])
    return rows.withColumn("seq", sequences.gene(F.col("__contig__"), F.col("start"), F.col("end"), F.col("strand"))).drop("__contig__")


def first_annotation(genes: DataFrame, *order: str) -> DataFrame:
    """(cluster, annotation): of the first gene of each cluster by ``order``."""
    return genes.groupBy("cluster").agg(F.min_by("annotation", F.struct(*order)).alias("annotation"))


def contig_kinds(genes: DataFrame, carries: Column, marker: Column, plasmid: Column) -> DataFrame:
    """(genome, n_contigs, n_marker, n_plasmid, n_chromosome): distinct contigs that carry a gene, by kind.

    ``marker`` and ``plasmid`` hold of a contig when any of its genes says so; a marker's contig is counted as such first.
    """
    c = genes.groupBy("genome", "contig").agg(F.max(carries).alias("c"), F.max(marker).alias("m"), F.max(plasmid).alias("p")).filter("c")
    return c.groupBy("genome").agg(
        F.count(F.lit(1)).alias("n_contigs"), F.count_if("m").alias("n_marker"), F.count_if(F.expr("NOT m AND p")).alias("n_plasmid"),
        F.count_if(F.expr("NOT m AND NOT p")).alias("n_chromosome"))


def pooled_precision(stats: DataFrame, key: str) -> DataFrame:
    """(key, ppv): true positives over all positives, summed over genomes; null without positives."""
    s = stats.groupBy(key).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return s.select(key, F.try_divide("tp", F.col("tp") + F.col("fp")).alias("ppv"))


def clusters_on_contigs(genes: DataFrame, members: DataFrame, share: float = 0.51) -> DataFrame:
    """(genome, contig, cluster, n): clusters with at least ceil(share x members) of their features on the contig.

    ``genes``: genome, contig, feature; ``members``: cluster, feature.
    """
    least = members.groupBy("cluster").agg(F.ceil(F.countDistinct("feature") * F.lit(share)).alias("least"))
    rows = genes.select("genome", "contig", "feature").distinct().join(members.select("cluster", "feature").distinct(), "feature")
    n = rows.groupBy("genome", "contig", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.join(least, "cluster").filter("n >= least").select("genome", "contig", "cluster", "n")


def unique_sequences(alignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(algn, seq_id, seq) with one row per text, under its smallest id; and (algn, seq_id, kept_id) to expand it again."""
    kept = alignment.groupBy("algn", "seq").agg(F.min("seq_id").alias("kept_id"))
    names = alignment.join(kept, ["algn", "seq"]).select("algn", "seq_id", "kept_id")
    return kept.select("algn", F.col("kept_id").alias("seq_id"), "seq"), names


def expand(unique: DataFrame, names: DataFrame) -> DataFrame:
    """(algn, seq_id, seq): every id of ``names`` with the (aligned) text of the one kept for it."""
    return names.join(unique.select("algn", F.col("seq_id").alias("kept_id"), "seq"), ["algn", "kept_id"]).select("algn", "seq_id", "seq")


def aligned_distance(a: Column, b: Column) -> tuple[Column, Column]:
    """(raw, shared): mismatches of two aligned texts, and their share of the places without a gap in either.

    The shorter text is taken as ending in gaps; ``shared`` is null without a place to compare.
    """
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        out, gap = [], ord("-")
        for s, t in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if s is None or t is None:
                out.append(None)
                continue
            n = max(len(s), len(t))
            x, y = (np.frombuffer(v.ljust(n, "-").encode("utf-32-le"), np.uint32) for v in (s, t))
            differ, seen = x != y, (x != gap) & (y != gap)
            places = int(seen.sum())
            out.append((int(differ.sum()), int((differ & seen).sum()) / places if places else None))
        return pa.array([None if v is None else {"raw": v[0], "shared": v[1]} for v in out], pa.struct([("raw", pa.int64()), ("shared", pa.float64())]))

    found = arrow_udf(compare, "struct<raw:long,shared:double>")(a, b)
    return found["raw"], found["shared"]


def one_copy(alignment: DataFrame) -> DataFrame:
    """(algn, genome, seq): one copy per genome, the one with the smallest id. ``alignment``: algn, genome, seq_id, seq."""
    return alignment.groupBy("algn", "genome").agg(F.min_by("seq", "seq_id").alias("seq"))


def concatenate(copies: DataFrame) -> DataFrame:
    """(genome, seq): the alignments of each genome one after the other; gaps as wide as the alignment where it has none."""
    width = copies.groupBy("algn").agg(F.max(F.length("seq")).alias("width"))
    cells = copies.select("genome").distinct().crossJoin(width)  # one row per cell of the result
    rows = cells.join(copies, ["algn", "genome"], "left").select("genome", "algn", F.rpad(F.coalesce("seq", F.lit("")), F.col("width"), "-").alias("seq"))
    whole = rows.groupBy("genome").agg(F.array_sort(F.collect_list(F.struct("algn", "seq"))).alias("parts"))
    return whole.select("genome", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"))


def columns_kept(alignment: DataFrame, most_gaps: float = 0.1, least_kinds: int = 2) -> DataFrame:
    """(algn, position): places, from 0, with at most that share of gaps and at least that many different bases."""
    cells = alignment.select("algn", F.posexplode(F.split("seq", "")).alias("position", "base"))
    n = cells.groupBy("algn", "position", "base").agg(F.count(F.lit(1)).alias("n"))
    at = n.groupBy("algn", "position").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("base") == "-", F.col("n")).otherwise(0)).alias("gaps"), F.count_if(F.col("base") != "-").alias("kinds"))
    return at.filter((F.col("gaps") <= most_gaps * F.col("n")) & (F.col("kinds") >= least_kinds)).select("algn", "position")


def keep_columns(alignment: DataFrame, kept: DataFrame) -> DataFrame:
    """(algn, seq_id, seq) of these places only; a sequence is put together from one row per alignment."""
    places = kept.groupBy("algn").agg(F.array_sort(F.collect_list("position")).alias("places"))
    chars = F.split("seq", "")
    seq = F.array_join(F.transform("places", lambda p: F.get(chars, p)), "")
    return alignment.join(places, "algn").select("algn", "seq_id", seq.alias("seq"))
