"""From raw documents to token ids: quality, line dedup, near dedup, decontamination, BPE.

Each stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateralis.llm.bpe import encode_decode
from lateralis.llm.decontaminate import remove_contaminated
from lateralis.llm.line_dedup import line_dedup
from lateralis.llm.near_dedup import near_dedup
from lateralis.llm.quality import classify, train
from lateralis.llm.shared import named, stage

#: Words from which lines are near, and words for each edit more than one that they may differ by.
NEAR_WORDS, PER_EDIT = 5, 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with all their columns.

    Null and empty texts are scored like others, repeated rows alike; without labels of both kinds all
    have one score; an empty table stays empty.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = ("__score__", "__predicted__")
    return classify(docs, model, into=into).filter("__predicted__ = 1").select(*[named(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and near lines; one that loses lines and has no word left goes.

    Null texts, and texts without words, are left as they are. Of rows that repeat with key and text
    one stays. ``n_chars`` follows the text.
    """
    out = line_dedup(docs, min_words=1, near_words=NEAR_WORDS, per_edit=PER_EDIT)
    changed = F.col("deduped.n_dropped") > 0
    kept = out.filter(~changed | F.col("deduped.text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    new = {"text": F.col("deduped.text"), "n_chars": F.length("deduped.text").cast("long")}
    return kept.select(*[F.when(changed, new[c]).otherwise(named(c)).alias(c) if c in new else named(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest key; null keys come last.

    Texts without words, null ones too, are in no class and stay.
    """
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Null texts have no words and stay; so do all if the benchmark is empty."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (uint32, little endian) of each whole document, and the text they decode to; null texts are empty."""
    return encode_decode(docs)


STAGES = [
    ("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("bpe", tokens),
]

#: A fitted ensemble and a randomised signature have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
