"""Cumulative volume curves over the delivery window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.clock import bin_index, bucket_floor, clock_text, in_window, minute_slot
from duskline.operators.dense import dense_counts, dense_measures
from duskline.sources.sinks import settle


def volume_curve_5min(
    profile: DataFrame,
    time_columns: Sequence[str],
    *,
    edge: str = "keep",
    by: Sequence[str] = (),
) -> DataFrame:
    """For each time column the cumulative number of entities per five-minute bin.

    37 rows, 16:00:00 to 19:00:00, for each value of ``by``. ``edge="zero"`` empties the first
    and the last bin first.
    """
    if edge not in ("keep", "zero"):
        raise ValueError(f"edge is 'keep' or 'zero', not {edge!r}")
    long = profile.select(*by, *time_columns).unpivot(
        list(by), list(time_columns), "metric", "sec"
    )
    slots = long.select(*by, "metric", F.when(in_window("sec"), bin_index("sec")).alias("bin"))
    counts = dense_counts(slots, [*by, "metric"], "bin", c.BIN_COUNT)
    if edge == "zero":
        inner = F.col("bin").between(2, c.BIN_COUNT - 1)
        counts = counts.withColumn("n", F.when(inner, F.col("n")).otherwise(0))
    running = Window.partitionBy(*by, "metric").orderBy("bin")
    curve = counts.withColumn(
        "volume",
        F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    wide = curve.groupBy(*by, "bin").pivot("metric", list(time_columns)).agg(F.max("volume"))
    start = (F.col("bin") - 1) * c.BIN_SECONDS + c.WINDOW_OPEN
    return wide.select(
        *by,
        clock_text(start).alias("time"),
        *[F.coalesce(F.col(name), F.lit(0)).alias(f"volume_{name}") for name in time_columns],
    )


def volume_curve_1min(
    profile: DataFrame, late_column: str, *, by: Sequence[str] = ()
) -> DataFrame:
    """Per client and minute the cumulative number of funds by predicted and by late time.

    Times are rounded up to the minute; those off the axis are not counted.
    """
    measures, client = ["predicted_time", late_column], [*by, "client_name"]
    long = profile.select(*client, *measures).unpivot(client, measures, "metric", "sec")
    counts = (
        long.select(*client, "metric", minute_slot("sec").alias("slot"))
        .groupBy(*client, "slot")
        .agg(*[F.count_if(F.col("metric") == name).alias(name) for name in measures])
    )
    dense = dense_measures(counts, client, "slot", c.MINUTE_COUNT, measures)
    running = (
        Window.partitionBy(*client)
        .orderBy("slot")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return dense.select(
        *client,
        clock_text(F.col("slot") * 60 + c.WINDOW_OPEN).alias("time"),
        *[F.sum(name).over(running).alias(f"volume_{name}") for name in measures],
    )


def volume_totals(curve: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The client curves added up per time, in time order."""
    volumes = [name for name in curve.columns if name.startswith("volume_")]
    totals = curve.groupBy(*by, "time").agg(*[F.sum(name).alias(name) for name in volumes])
    return totals.orderBy(*by, "time")


def curve_ends(curve: DataFrame, rows: int = 10) -> DataFrame:
    """The first and the last rows of a curve, in time order; the curve is made once."""
    curve = settle(curve)
    head = curve.orderBy("time").limit(rows)
    tail = curve.orderBy(F.col("time").desc()).limit(rows)
    return head.unionByName(tail).distinct().orderBy("time")


def bucket_counts(
    arrivals: DataFrame, keys: Sequence[str], *, ts: str = "arrival_ts", width: str = "5 minutes"
) -> DataFrame:
    """Rows per key and tumbling time bucket."""
    return (
        arrivals.groupBy(*keys, F.window(ts, width).alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("_bucket.start").alias("bucket_start"), "n")
    )


def second_buckets(
    profile: DataFrame, time: str = "predicted_time", width: int = c.BIN_SECONDS
) -> DataFrame:
    """Rows per time of day and the bucket that time falls in, by modulo."""
    return (
        profile.withColumn("bucket", bucket_floor(time, width))
        .groupBy("bucket", time)
        .agg(F.count(F.lit(1)).alias("n"))
    )
