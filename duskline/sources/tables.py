"""Readers. Filters and column lists are given declaratively so that they reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duskline import constants as c
from duskline.functions.clock import bin_label, clock_text
from duskline.sources.schemas import TIME_BINS


def read_table(
    spark: SparkSession, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    table = spark.table(name)
    return table.select(*columns) if columns else table


def read_files(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    files = spark.read.format(fmt).load(path)
    return files.select(*columns) if columns else files


def read_partition(df: DataFrame, value: Column | str, column: str = "yyyymm") -> DataFrame:
    """One monthly partition; the files of the others are not read."""
    return df.where(F.col(column) == value)


def read_arrivals(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
) -> DataFrame:
    """Arrivals stored by month, between two dates; files of other months are not read.

    ``schema`` is that of the arrivals; the month is a column ``yyyymm`` besides.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [f for f in kind.fields if f.name != "yyyymm"]
    rows = spark.read.schema(StructType([*fields, StructField("yyyymm", StringType())])).parquet(path)
    for bound, low in ((first, True), (last, False)):
        if bound is not None:
            day = dt.date.fromisoformat(str(bound))
            month = F.lit(day.strftime("%Y%m"))
            rows = rows.where(F.col("yyyymm") >= month if low else F.col("yyyymm") <= month)
            rows = rows.where(F.col("nav_date") >= F.lit(day) if low else F.col("nav_date") <= F.lit(day))
    return rows


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def read_time_bins(spark: SparkSession, path: str) -> DataFrame:
    """The bin dimension: bin label and the text shown for it."""
    bins = read_csv(spark, path, TIME_BINS)
    return bins.select(F.col("Bin").alias("bin_label"), F.col("Time_Bin").alias("time_bin"))


def number_series(spark: SparkSession, first: int, last: int, name: str) -> DataFrame:
    """Whole numbers from first to last, both included."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def bin_axis(spark: SparkSession) -> DataFrame:
    """The 37 five-minute bins with their label and starting time."""
    bins = number_series(spark, 1, c.BIN_COUNT, "bin")
    start = (F.col("bin") - 1) * c.BIN_SECONDS + c.WINDOW_OPEN
    return bins.select(
        "bin", bin_label("bin").alias("bin_label"), clock_text(start).alias("time_bin")
    )
