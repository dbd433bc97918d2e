"""Readers and writers of the file formats of the field, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, row_names: str | None = None) -> DataFrame:
    """Texts as in ``schema``. With ``row_names`` the rows have a name before the first column, which the header lacks."""
    if row_names is not None:
        rest = spark.createDataFrame([], schema).schema
        schema = StructType([StructField(row_names, StringType()), *rest.fields])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): the header up to the first white space, and the lines joined."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n", 2)
    return records.select(
        F.split(F.get(lines, F.lit(0)), r"\s")[0].alias("seq_id"),
        F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq", by: list[str] = ()) -> None:
    lines = df.select(*by, F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), F.col(seq)).alias("value"))
    (lines.write.partitionBy(*by) if by else lines.write).text(path)


def read_cluster_file(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(cluster_id, position, gene_id, genome_id, identity) of a ``.clstr`` file; clusters under ``least`` members go."""
    records = spark.read.option("lineSep", ">Cluster").text(path).filter(F.length(F.trim("value")) > 0)
    lines = records.select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("cluster_id"), F.split("value", "\n").alias("lines"))
    rows = lines.select("cluster_id", F.posexplode("lines").alias("position", "line")).filter(F.col("line").contains("..."))
    gene = F.regexp_extract("line", r">?(fig\|.*?)\.\.\.", 1)
    identity = F.when(F.col("line").rlike(r"\.\.\. \*"), 100.0).otherwise(
        F.regexp_extract("line", r"at (?:[+-]/)?([0-9.]+)%", 1).try_cast("double"))
    rows = rows.select(
        "cluster_id", "position", gene.alias("gene_id"), F.regexp_extract(gene, r"fig\|(.*?)\.peg", 1).alias("genome_id"),
        identity.alias("identity"))
    kept = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("cluster_id")
    return rows.join(kept, "cluster_id", "left_semi")


def identity_cells(members: DataFrame) -> DataFrame:
    """(genome_id, cluster_id, identity): the first identity per cell."""
    return members.groupBy("genome_id", "cluster_id").agg(F.min_by("identity", "position").alias("identity"))


def read_recombination(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, taxa) of a recombination GFF."""
    names = [f"c{i}" for i in range(1, 10)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", "\t").option("comment", "#").csv(path)
    taxa = F.split(F.trim(F.regexp_extract("c9", r'taxa="?([^";]*)', 1)), r"\s+")
    return rows.select(F.col("c4").cast("int").alias("start"), F.col("c5").cast("int").alias("end"), taxa.alias("taxa"))


def partitions_of(df: DataFrame, column: str) -> DataFrame:
    """(gene, start, end) from "start-end" texts with a gene column."""
    ends = F.split(column, "-")
    return df.select("gene", ends[0].cast("int").alias("start"), ends[1].cast("int").alias("end"))


def parse_newick(text: str) -> list[tuple[int, int | None, int, float | None, str | None]]:
    """(edge, parent_edge, n_children, length, label) of a Newick tree, edges numbered in reading order from 1."""
    rows: list[list] = [[0, None, None, None]]  # id, parent, length, label; 0 is the root, which has no edge
    stack: list[int] = []  # open nodes
    last: int | None = None  # the node that a label or length belongs to

    def new() -> int:
        rows.append([len(rows), stack[-1] if stack else 0, None, None])
        return len(rows) - 1

    for token in re.findall(r"'(?:[^']|'')*'|[(),;]|[^(),;]+", text.strip()):
        if token == "(":
            stack.append(new() if stack else 0)
            last = None
        elif token == ")":
            last = stack.pop()
        elif token in ",;":
            last = None
        elif token.strip():
            last = new() if last is None else last
            label, colon, length = token.strip().partition(":") if token[0] != "'" else (token, "", "")
            rows[last][3] = label.strip().strip("'") or rows[last][3]
            rows[last][2] = float(length) if colon else rows[last][2]
    children = [0] * len(rows)
    for r in rows[1:]:
        children[r[1]] += 1
    return [(i, p or None, children[i], length, label) for i, p, length, label in rows[1:]]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, edge, parent_edge, is_tip, length, label) of files with one Newick tree each."""
    texts = spark.read.text(path, wholetext=True).select("_metadata.file_name", "value")
    schema = "tree_id string, edge int, parent_edge int, is_tip boolean, length double, label string"

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            out = [(name, e, p, not n, length, label) for name, text in zip(pdf["file_name"], pdf["value"], strict=True) for e, p, n, length, label in parse_newick(text)]
            yield pd.DataFrame(out, columns=["tree_id", "edge", "parent_edge", "is_tip", "length", "label"]).astype({"parent_edge": "Int32"})

    return texts.mapInPandas(parse, schema)


def write_newick(edges: list[tuple[int, int | None, float | None, str | None]]) -> str:
    """Newick text of one tree's (edge, parent_edge, length, label) rows; children in the order of edges."""
    below: dict[int | None, list] = {}
    for row in sorted(edges, key=lambda r: r[0]):
        below.setdefault(row[1], []).append(row)

    def text(parent: int | None) -> str:
        return "(" + ",".join(
            (text(e) if e in below else "") + (label or "") + ("" if length is None else f":{length:g}")
            for e, _, length, label in below[parent]) + ")"

    return text(None) + ";" if below else ";"


def newick_text(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(newick): one row, the tree of ``edges`` (edge, parent_edge, length, label) as text, children in the order of edges.

    Each node gives the texts where it opens and closes, placed by its way from the root; only the last step, the text of
    the whole tree, is put together in one task. Edges are above 0; a missing label or length is left out; no edges, no row.
    """
    way = closure.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("x"), "anc"))).alias("way"))
    way = way.select("edge", F.transform("way", lambda s: s["anc"].cast("long")).alias("way"))
    children = edges.filter("parent_edge IS NOT NULL").groupBy(F.col("parent_edge").alias("edge")).agg(F.lit(True).alias("inner"))
    firsts = edges.groupBy("parent_edge").agg(F.min("edge").alias("first"))
    first = edges.join(firsts, edges["parent_edge"].eqNullSafe(firsts["parent_edge"])).select(
        "edge", "length", "label", F.when(F.col("edge") == F.col("first"), "").otherwise(",").alias("comma"))
    nodes = first.join(way, "edge").join(children, "edge", "left")
    name = F.concat(F.coalesce("label", F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("length").cast("string")), F.lit("")))
    opened = F.struct(F.col("way").alias("place"), F.concat("comma", F.when(F.col("inner"), "(").otherwise(name)).alias("text"))
    closed = F.struct(F.concat("way", F.array(F.lit(2**63 - 1))).alias("place"), F.concat(F.lit(")"), name).alias("text"))
    tokens = nodes.select(F.explode(F.when(F.col("inner"), F.array(opened, closed)).otherwise(F.array(opened))).alias("t"))
    whole = tokens.agg(F.array_sort(F.collect_list("t")).alias("all")).filter(F.size("all") > 0)
    return whole.select(F.concat(F.lit("("), F.array_join(F.transform("all", lambda t: t["text"]), ""), F.lit(");")).alias("newick"))
