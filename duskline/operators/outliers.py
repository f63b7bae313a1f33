"""Interquartile fences."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.percentiles import fence_columns, linear
from duskline.operators.joins import lookup_join
from duskline.operators.skew import weight_of, weighted_rows


class Split(NamedTuple):
    inliers: DataFrame
    outliers: DataFrame
    on_fence: DataFrame


def fences(
    df: DataFrame, keys: Sequence[str], value: str = "sec", k: float = c.OUTLIER_FENCE
) -> DataFrame:
    """Lower and upper fence per key, from the exact 25% and 75% points."""
    points = df.groupBy(*keys).agg(linear(value, [25, 75]).alias("_points"))
    low, high = fence_columns(F.col("_points"), k)
    return points.select(*keys, low.alias("fence_low"), high.alias("fence_high"))


def zone(value: str) -> Column:
    """Strict on both sides: a value on a fence is neither inlier nor outlier."""
    at, low, high = F.col(value), F.col("fence_low"), F.col("fence_high")
    return (
        F.when((at > low) & (at < high), "inlier")
        .when((at < low) | (at > high), "outlier")
        .when(at.isNotNull(), "on_fence")
    )


def label_outliers(
    df: DataFrame, keys: Sequence[str], value: str = "sec", k: float = c.OUTLIER_FENCE
) -> DataFrame:
    """Every row with its fences and its ``zone``: inlier, outlier or on_fence."""
    limits = fences(df, keys, value, k)
    return lookup_join(df, limits, keys, "left").withColumn("zone", zone(value))


def iqr_split(
    df: DataFrame, keys: Sequence[str], value: str = "sec", k: float = c.OUTLIER_FENCE
) -> Split:
    """The three parts of the rows; together they are the input."""
    labelled = label_outliers(df, keys, value, k)

    def part(name: str) -> DataFrame:
        return labelled.where(F.col("zone") == name).select(*df.columns)

    return Split(part("inlier"), part("outlier"), part("on_fence"))


def zone_counts(
    df: DataFrame, keys: Sequence[str], value: str = "sec", k: float = c.OUTLIER_FENCE
) -> DataFrame:
    """Rows per key in each zone; fences and counts come from one shuffle, without a join."""
    points = linear(value, [25, 75], F.col("n")).over(Window.partitionBy(*keys))
    low, high = fence_columns(F.col("_points"), k)
    labelled = (
        weighted_rows(df, keys, [value])
        .withColumn("_points", points)
        .withColumns({"fence_low": low, "fence_high": high})
        .withColumn("zone", zone(value))
    )
    return labelled.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("zone") == name, F.col("n")).otherwise(0)).alias(f"n_{name}")
            for name in ("inlier", "outlier", "on_fence")
        ]
    )


def outlier_counts(
    df: DataFrame, entity: str = "ticker", value: str = "sec", k: float = c.OUTLIER_FENCE
) -> DataFrame:
    """Outliers per entity, for entities that have any."""
    return (
        zone_counts(df, [entity], value, k)
        .where(F.col("n_outlier") > 0)
        .select(entity, F.col("n_outlier").alias("outlier_count"))
    )


def outlier_times(outliers: DataFrame, value: str = "sec") -> DataFrame:
    """Outliers per arrival time."""
    return outliers.groupBy("nav_date", value).agg(
        F.sum(weight_of(outliers)).alias("outlier_count")
    )


def history_outliers(
    history: DataFrame, keys: Sequence[str], value: str = "sec", k: float = c.OUTLIER_FENCE
) -> DataFrame:
    """The outliers of a counted history, with their numbers.

    Fences come from a window over the keys, with each row weighing as many arrivals as it
    stands for; where the history is laid out by the keys, nothing is shuffled or joined.
    """
    points = linear(value, [25, 75], weight_of(history)).over(Window.partitionBy(*keys))
    low, high = fence_columns(F.col("_points"), k)
    return (
        history.withColumn("_points", points)
        .where((F.col(value) < low) | (F.col(value) > high))
        .drop("_points")
    )
