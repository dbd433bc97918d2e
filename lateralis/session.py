"""Session helpers shared by operators that work in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder of our own only where it is empty on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lateralis-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and its lineage cut, by a reliable checkpoint in ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder_of(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and its lineage cut, as a Parquet table in ``spark.checkpoint.dir`` that is read back.

    For many rounds of joins and relabellings: what they make known about their columns does not pile up in the plan, as it does
    behind a checkpoint. Tables stay until the folder's owner clears it, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{folder_of(spark)}/lateralis-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that one task sorts or groups.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns``, into so many partitions that of ``rows`` rows in all each task has some ``TASK_ROWS``.

    Tables dealt alike meet and are grouped without another shuffle, and a task's memory does not grow with the input.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *columns)
