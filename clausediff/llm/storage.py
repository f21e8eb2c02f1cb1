"""Shared working folder of a job: every table that cuts a lineage goes there.

The cluster names the folder in ``spark.checkpoint.dir``; only where that is
unset and the session is local (tests) a folder of this machine is made and
set. Tables are deleted by whoever wrote them, once their last reader is done;
``clear`` deletes what an application has left, its results too.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as a Hadoop path without a trailing slash."""
    global _local_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="clausediff-")
            spark.sparkContext.setCheckpointDir(_local_folder)
        root = f"file://{_local_folder}"
    return root.rstrip("/")


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/clausediff-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows come to Python in batches of so many bytes, for a batch of long texts stands in the memory of the JVM and of Python
#: several times over.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: While a table is written: Spark deletes the plan's shuffle files as soon as it has run, and not when the driver's JVM
#: next collects garbage; and batches are small.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | SMALL_BATCHES


@contextlib.contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """For as long as it stands the session has ``settings``."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the shuffle files that this took are deleted, so that a job's steps don't add up on the disks.

    A task that is tried again, or lost with its executor, replaces its own
    files only: the commit protocol of Spark's file writer sees to that.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with configured(spark, _WHILE_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` returned, whose readers must be done."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; what its queries returned can't be read any more."""
    _delete(spark, _own_root(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(spark: SparkSession, df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check that stands before a broadcast."""
    return df.limit(rows + 1).count() <= rows
