"""Gene tables from annotation files and contigs, one file or folder of files at a time, read by Spark's own readers.

Any store that Spark reads will do; the genome of a row is the name of its file without the extension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("contig", "source", "kind", "first", "last", "score", "strand", "phase", "attributes")


def genome_of(path: Column) -> Column:
    """The file's name without folders and extensions of annotation, sequence and compression."""
    name = F.regexp_extract(F.url_decode(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?i)\.(gff3?|gbff|fasta|fna|fa)(\.gz)?$", "")


def attribute(name: str) -> Column:
    """A value of the ninth column, decoded; null where it is missing."""
    value = F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.when(value != "", F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))


def read_annotation(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("CDS",)) -> DataFrame:
    """(genome, contig, gene_id, annotation, start, end, strand) of annotation files.

    Comments, directives and the sequences that may follow ``##FASTA`` are left out, and rows of other ``kinds`` or with a
    number of columns other than nine. ``start`` and ``end`` count from 0, both included, as ``operators.genes.cut_genes`` takes
    them; a gene without an id is named by its place, one without a product has a null annotation.
    """
    lines = spark.read.text(path).select(genome_of(F.col("_metadata.file_path")).alias("genome"), F.split("value", "\t").alias("x"))
    rows = lines.filter((F.size("x") == 9) & ~F.get("x", F.lit(0)).startswith("#")).select(
        "genome", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)])
    rows = rows.filter(F.col("kind").isin(*kinds)).withColumns({"start": F.col("first").try_cast("int") - 1, "end": F.col("last").try_cast("int") - 1})
    place = F.concat_ws(":", "genome", "contig", "first", "last")
    return rows.filter("start >= 0 AND end >= start").select(
        "genome", "contig", F.coalesce(attribute("ID"), attribute("locus_tag"), place).alias("gene_id"),
        F.coalesce(attribute("product"), attribute("Name")).alias("annotation"), "start", "end", "strand")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(genome, contig, seq) of sequence files; a contig is named up to the first white space, its lines are joined."""
    records = spark.read.option("lineSep", ">").text(path).select(genome_of(F.col("_metadata.file_path")).alias("genome"), "value")
    lines = F.split("value", "\r?\n", 2)
    return records.filter(F.length(F.trim("value")) > 0).select(
        "genome", F.split(F.get(lines, F.lit(0)), r"\s")[0].alias("contig"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def gene_environment(spark: SparkSession, annotation: str, contigs: str) -> tuple[DataFrame, DataFrame]:
    """(genes, contigs) of folders of annotation and of sequence files; genes of contigs without a sequence are left out."""
    seqs = read_contigs(spark, contigs)
    genes = read_annotation(spark, annotation)
    return genes.join(seqs.select("genome", "contig").distinct(), ["genome", "contig"], "left_semi"), seqs
