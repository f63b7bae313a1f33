"""Explicit schemas of the tables and files the jobs read."""

from pyspark.sql.types import (
    DateType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Deliveries as they are received: every column is text.
RAW_ARRIVALS = StructType(
    [
        StructField("nav_date", StringType()),
        StructField("fund_id", StringType()),
        StructField("client_name", StringType()),
        StructField("datetime", StringType()),
        StructField("date_identifier", StringType()),
    ]
)

# Deliveries after normalising; ``ticker`` is present for the ticker feed only.
ARRIVALS = StructType(
    [
        StructField("client_name", StringType()),
        StructField("fund_id", StringType()),
        StructField("ticker", StringType()),
        StructField("nav_date", DateType()),
        StructField("arrival_ts", TimestampNTZType()),
        StructField("sec", IntegerType()),
    ]
)

CLIENTS = StructType(
    [
        StructField("client_identifier", IntegerType()),
        StructField("client_name", StringType()),
        StructField("yyyymm", StringType()),
    ]
)

TIME_BINS = StructType(
    [StructField("Bin", IntegerType()), StructField("Time_Bin", StringType())]
)
