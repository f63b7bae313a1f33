"""Tables of a data folder, and values that travel to the executors."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a value of bounded size; the result gives it back inside a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def value_of() -> Any:
        return cloudpickle.loads(sent.value)

    return value_of


def give_back() -> None:
    """Returns freed memory to the system: after a fit the driver would hold on to most of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names, which all executors share.

    Where it is unset, as in tests, a subfolder of the session's warehouse is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return folder.rstrip("/")


# What this process has settled and not yet cleared.
_written: list[str] = []


def settled(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Writes a table into the shared folder and reads it back, so that no lineage is behind it.

    `clear_settled` deletes it, unless it is to be kept.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_settled(spark: SparkSession) -> None:
    """Deletes what was settled so far: for when all results made from it have been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _written:
        path = hadoop(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As `settled`, in buckets of one key: what meets these rows by the key leaves them in place."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{table}"
    _written.append(path)
    writer = df.write.format("parquet").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
