"""Volume forecast per entity, weekday and bin.

A group of entity and weekday holds 37 rows per date, so it grows with the calendar only,
never with the number of arrivals. That is why windows over it are safe, and they let the
forecast be made, and laid beside the history, in one pass without joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.clock import bin_label
from duskline.functions.percentiles import linear
from duskline.operators.history import daily_volume

LEVELS = list(c.FORECAST_RANKS)
RANKS = list(c.FORECAST_RANKS.values())


def end_of_day_volume(history: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """Median of the daily final totals per entity and weekday."""
    return daily_volume(history, entity=entity).groupBy(entity, "weekday").agg(
        F.median("volume").alias("day_volume")
    )


def _with_day_volume(history: DataFrame, entity: str) -> DataFrame:
    """As ``end_of_day_volume``, beside every row: the last bin holds the final total."""
    final = F.when(F.col("bin") == c.BIN_COUNT, F.col("cumsum"))
    volume = F.median(final).over(Window.partitionBy(entity, "weekday"))
    return history.withColumn("day_volume", volume)


def _volume(name: str) -> Column:
    # The inner rounding keeps products that are halves from falling either way.
    return F.round(F.round(F.col(f"{name}_pct") * F.col("day_volume"), 6), 0)


def _with_levels(rows: DataFrame, shares: str = "_shares") -> DataFrame:
    pcts = {f"{name}_pct": F.round(F.col(shares)[i], 6) for i, name in enumerate(LEVELS)}
    return (
        rows.withColumns(pcts)
        .withColumns({name: _volume(name) for name in LEVELS})
        .drop(shares)
    )


def bin_forecast(history: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """Percentiles of the share of the day times the end-of-day volume, rounded.

    One shuffle on entity and weekday serves the volume and the percentiles.
    """
    groups = _with_day_volume(history, entity).groupBy(entity, "weekday", "bin")
    return _with_levels(
        groups.agg(
            F.max("day_volume").alias("day_volume"), linear("share", RANKS).alias("_shares")
        )
    )


def with_forecast(history: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """The history with the forecast made from it beside every row; no join."""
    bins = Window.partitionBy(entity, "weekday", "bin")
    shares = linear("share", RANKS).over(bins)
    return _with_levels(_with_day_volume(history, entity).withColumn("_shares", shares))


def join_forecast(
    history: DataFrame, forecast: DataFrame, *, entity: str = "client_name"
) -> DataFrame:
    """The history with a stored forecast; rows without one stay, with nulls."""
    return history.join(forecast, [entity, "weekday", "bin"], "left")


def sum_levels(forecast: DataFrame, levels: Sequence[str]) -> DataFrame:
    return forecast.groupBy("bin", "weekday").agg(*[F.sum(name).alias(name) for name in levels])


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """The forecast summed over entities."""
    return sum_levels(forecast, [name for name in LEVELS if name != "green"])


def limit_table(forecast: DataFrame, time_bins: DataFrame) -> DataFrame:
    """Predicted volume and lower limit per weekday, with the text of each bin."""
    totals = sum_levels(forecast, ["predicted", "red_1"])
    labelled = totals.withColumn("bin_label", bin_label("bin"))
    return labelled.join(time_bins.select("bin_label", "time_bin"), "bin_label").select(
        F.col("time_bin").alias("bin"),
        "weekday",
        "predicted",
        F.col("red_1").alias("lower_limit"),
    )
