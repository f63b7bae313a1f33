"""Making keys with very many rows small before one task takes them whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight_of(df: DataFrame) -> Column:
    """How many arrivals a row stands for: its ``n``, or one where the table has no such column."""
    return F.col("n") if "n" in df.columns else F.lit(1).cast("long")


def weighted_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("sec",)) -> DataFrame:
    """Keys, values and a weight ``n``; summing the weights counts the rows.

    Rows are counted per key and value on the map side, which splits a hot key over many tasks:
    seconds of the day have at most 86,400 values, so what follows sees no more rows than that
    per key, however many there were. Rows with a null key or value are left out.
    """
    columns = [*keys, *values]
    rows = df.select(*columns, weight_of(df).alias("n")).na.drop("any", subset=columns)
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"))


def row_salt(df: DataFrame, keys: Sequence[str], salts: int) -> Column:
    """A salt from 0 to ``salts - 1`` by the row's content, the same when a task is repeated.

    Rows with a null key match nothing; they get negative salts of a wide range instead, so
    that a shuffle by keys and salt spreads them.
    """
    content = F.xxhash64(*df.columns)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    wide = (-1 - F.pmod(content, F.lit(1 << 20))).cast("int")
    return F.when(no_key, wide).otherwise(F.pmod(content, F.lit(salts)).cast("int"))
