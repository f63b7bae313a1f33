"""Publishing: monthly partitions, report tables, shared views."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shuffled bytes of arrivals that one task sorts and writes, about.
PART_BYTES = "16m"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where that is unset, as in tests, it is a subfolder of the session's warehouse.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and go on from the files, with no lineage behind.

    Lost executors then cost a re-read, never a recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def month_of_latest(df: DataFrame, column: str = "nav_date") -> Column:
    """``yyyyMM`` of the latest date as a scalar subquery: no collect, no join."""
    return df.agg(F.date_format(F.max(column), "yyyyMM").alias("yyyymm")).scalar()


def with_month(df: DataFrame, dated: DataFrame, column: str = "nav_date") -> DataFrame:
    """Adds the partition column ``yyyymm`` from the latest date in ``dated``."""
    return df.withColumn("yyyymm", month_of_latest(dated, column))


def overwrite_months(df: DataFrame, path: str, column: str = "yyyymm") -> None:
    """Replace the monthly partitions found in ``df``; all others stay as they are.

    A month that ``df`` lacks is not emptied; ``overwrite_month`` does that.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def overwrite_month(
    df: DataFrame, path: str, month: str, column: str = "yyyymm", parts: Sequence[str] = ()
) -> str:
    """Replace one month by ``df``, also when ``df`` is empty; the folder written.

    ``parts`` are further partition columns within the month.
    """
    folder = f"{path}/{column}={month}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*parts) if parts else writer).parquet(folder)
    return folder


def publish_keyed(df: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write in buckets of one key and return the table that knows of them.

    Rows are shuffled once, by the key. What then groups by the key, alone or with others, or
    joins two such tables on it, needs no further shuffle. The files can be read by their path
    as well; the name in the catalog, made from the path, only carries the layout.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"duskline_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (
        df.repartition(count, key)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(count, key)
        .sortBy(key)
        .saveAsTable(name)
    )
    return spark.table(name)


def overwrite_table_months(df: DataFrame, table: str, column: str = "yyyymm") -> None:
    """As ``overwrite_months`` for a catalog table; it is created when missing."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.partitionBy(column).format("parquet").saveAsTable(table)
        return
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def publish_arrivals(df: DataFrame, path: str, *, by_day: bool = False) -> None:
    """Write arrivals by month of their date, or by month and day; months found are replaced.

    Rows are brought together by date, by quarters of a month unless by day, in parts of like
    size, large ones in several; a task sorts about ``PART_BYTES`` of them, however many there are.
    """
    parts = ["yyyymm", "nav_date"] if by_day else ["yyyymm"]
    quarter = F.floor((F.dayofmonth("nav_date") - 1) / 8)
    dated = df.withColumns({"yyyymm": F.date_format("nav_date", "yyyyMM"), "_quarter": quarter})
    size, conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes", df.sparkSession.conf
    before = conf.get(size, None)
    conf.set(size, PART_BYTES)
    try:
        (
            dated.hint("rebalance", *(parts if by_day else [*parts, "_quarter"]))
            .drop("_quarter")
            .sortWithinPartitions(*parts, "nav_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(path)
        )
    finally:
        conf.unset(size) if before is None else conf.set(size, before)


def publish_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a report as parquet, or as CSV with a header for people."""
    options = {"header": True} if fmt == "csv" else {}
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def share_view(df: DataFrame, name: str) -> DataFrame:
    """Name the result for SQL and return what the name stands for."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
