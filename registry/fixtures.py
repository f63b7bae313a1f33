"""Arrival tables derived from the given tables. Every row of them is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.functions.clock import arrival_timestamp, seconds_of_day
from duskline.sources.tables import read_files


def _events(spark: SparkSession, sf_dir: str, sec: Column) -> DataFrame:
    events = read_files(spark, f"{sf_dir}/events.parquet", ["ts", "user_id", "value"])
    fund = F.floor(F.col("user_id") / 10)
    return events.select(
        F.concat(F.lit("C"), fund % 5).alias("client_name"),
        fund.cast("string").alias("fund_id"),
        F.col("user_id").cast("string").alias("ticker"),
        F.to_date("ts").alias("nav_date"),
        sec.cast("int").alias("sec"),
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many arrivals per ticker, spread evenly over the window."""
    return _events(spark, sf_dir, F.floor(seconds_of_day("ts") / 8) + 57600)


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense, with times that have outliers."""
    return _events(spark, sf_dir, F.least(F.floor(F.col("value") * 20) + 57600, F.lit(68399)))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few arrivals per fund, on both sides of the history split."""
    orders = read_files(
        spark,
        f"{sf_dir}/orders.parquet",
        ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"],
    )
    customers = read_files(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_nationkey"])
    nations = read_files(spark, f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name"])
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("client_name"),
            F.col("o_custkey").cast("string").alias("fund_id"),
            F.col("o_orderpriority").alias("ticker"),
            F.to_date("o_orderdate").alias("nav_date"),
            (F.col("o_orderkey") * 7919 % 10800 + 57600).cast("int").alias("sec"),
        )
    )


def as_text(arrivals: DataFrame) -> DataFrame:
    """The dense table as the feeds deliver it: text only, with some rows damaged."""
    sec = F.col("sec")
    ts = arrival_timestamp("nav_date", "sec")
    date = F.date_format("nav_date", "M/d/yyyy")
    return arrivals.select(
        F.when(sec % 83 != 0, F.col("client_name")).alias("client_name"),
        F.concat(F.lit(" "), "fund_id", F.lit(" ")).alias("fund_id"),
        F.when(sec % 89 == 0, "2/30/2024").otherwise(date).alias("nav_date"),
        F.when(sec % 97 == 0, "late").otherwise(F.date_format(ts, "M/d/yy HH:mm")).alias(
            "datetime"
        ),
        F.date_format("nav_date", "yyyyMMdd").alias("date_identifier"),
    )


def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As sparse, with funds that no profile can hold.

    Some always come at one second, some are also delivered by a client who comes later in the
    alphabet, and some have no client.
    """
    fund = F.col("fund_id").cast("int")
    rows = sparse(spark, sf_dir).withColumns(
        {
            "sec": F.when(fund % 7 == 0, 60000).otherwise(F.col("sec")),
            "client_name": F.when(fund % 13 != 0, F.col("client_name")),
        }
    )
    again = rows.where(fund % 11 == 0).withColumn("client_name", F.lit("ZZ"))
    return rows.unionByName(again)


def two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense and the skewed table as two feeds that share their funds."""
    return (
        dense(spark, sf_dir)
        .withColumn("feed", F.lit("even"))
        .unionByName(skewed(spark, sf_dir).withColumn("feed", F.lit("skewed")))
    )
