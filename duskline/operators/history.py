"""Daily volume per five-minute bin: the base of the forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.clock import (
    bin_index,
    bin_label,
    in_window,
    is_business_day,
    weekday_index,
)
from duskline.operators.dense import dense_counts


def bin_history(
    arrivals: DataFrame, *, entity: str = "client_name", fold_out_of_range: bool = False
) -> DataFrame:
    """Entity × date × 37 bins: count, running total and its share of the day.

    Monday to Friday only. The dates are those the entity has; empty bins count 0. Times off
    the window are left out, or with ``fold_out_of_range`` counted in the hour of 18:00. The
    whole chain needs one shuffle, on entity and date.
    """
    kept = arrivals.where(is_business_day("nav_date"))
    if not fold_out_of_range:
        kept = kept.where(in_window("sec"))
    binned = kept.select(
        entity, "nav_date", bin_index("sec", fold_out_of_range=fold_out_of_range).alias("bin")
    )
    counts = dense_counts(binned, [entity, "nav_date"], "bin", c.BIN_COUNT)
    return running_history(counts, entity=entity)


def running_history(counts: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """Dense counts per entity, date and bin with their running total and its share of the day."""
    day = Window.partitionBy(entity, "nav_date")
    running = day.orderBy("bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.try_divide(F.col("cumsum"), F.max("cumsum").over(day))
    return (
        counts.withColumn("cumsum", F.sum("n").over(running))
        .withColumn("share", F.bround(share, 4))
        .select(
            entity,
            "nav_date",
            weekday_index("nav_date").alias("weekday"),
            "bin",
            bin_label("bin").alias("bin_label"),
            "n",
            "cumsum",
            "share",
        )
    )


def actual_totals(history: DataFrame) -> DataFrame:
    """Running totals summed over entities."""
    return history.groupBy("bin", "nav_date", "weekday").agg(F.sum("cumsum").alias("cumsum"))


def daily_volume(history: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """The final total of each entity and day."""
    return history.groupBy(entity, "weekday", "nav_date").agg(F.max("cumsum").alias("volume"))
