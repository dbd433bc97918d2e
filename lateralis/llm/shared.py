"""Tables staged between jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set (one machine, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lateralis-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Scratches(threading.local):
    """Paths staged by each open ``scratch`` of this thread, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_own = _Scratches()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what is staged inside, but for tables staged with ``keep``; those belong to the one outside."""
    own: list[str] = []
    _own.open.append(own)
    try:
        yield
    finally:
        _own.open.pop()
        for path in own:
            _delete(spark, path)


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The copy cuts the lineage, is computed once however often it is read, keeps column
    pruning, and outlives any executor. An open ``scratch`` removes it; else the folder's owner, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lateralis-{label}-{uuid.uuid4().hex}"
    if len(_own.open) > keep:
        _own.open[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Removes a staged table before its ``scratch`` ends, once nothing will read it again."""
    files = staged.inputFiles()
    if files:
        _delete(staged.sparkSession, files[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are staged: it does when the driver collects what nothing refers to."""
    spark._jvm.System.gc()


def named(column: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def documents_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty; other columns cannot clash with ours."""
    return docs.select(named(key).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))


def smaller_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: at most ``rows`` rows per Arrow batch, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
