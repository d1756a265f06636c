"""Intermediate tables in the folder all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``.  The setting
is read from the session; only a local session that lacks it gets a temporary
folder, because there the driver and the executors are one process.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="tessel-"))
        base = f"file://{_local[0].name}"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders for ``by``, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    if _scopes:
        _scopes[-1].append(back)
    return back


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that were staged inside it and are still in the list it gives."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        drop(*made)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of finished jobs.

    Their files go when the driver's heap is collected, which a driver with
    little to do may put off until the disks are full.
    """
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
