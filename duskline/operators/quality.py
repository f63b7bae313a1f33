"""Control limits, spread and training errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.percentiles import linear
from duskline.operators.forecast import with_forecast


def xmr_limits(history: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """Individuals and moving-range chart of the running totals.

    The moving range steps over all dates of an entity and bin; the medians are by weekday
    as well. Windows replace the join of limits to rows: one shuffle, on entity and bin.
    """
    series = Window.partitionBy(entity, "bin").orderBy("nav_date")
    group = Window.partitionBy(entity, "bin", "weekday")
    step = F.abs(F.col("cumsum") - F.lag("cumsum").over(series))
    reach = F.col("range_centre") * c.MOVING_RANGE_FACTOR
    within = F.col("cumsum").between(F.col("lower_limit"), F.col("upper_limit"))
    return (
        history.select(entity, "weekday", "bin", "nav_date", "cumsum")
        .withColumn("moving_range", F.coalesce(step, F.lit(0)))
        .withColumns(
            {
                "centre": F.ceil(F.median("cumsum").over(group)),
                "range_centre": F.ceil(F.median("moving_range").over(group)),
            }
        )
        .withColumns(
            {
                "upper_limit": F.round(F.col("centre") + reach, 6),
                "lower_limit": F.round(F.col("centre") - reach, 6),
            }
        )
        .withColumn("is_outlier", F.when(within, 0).otherwise(1))
    )


def spread(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample standard deviation of the running totals, three places, half to even."""
    return history.groupBy(*keys).agg(
        F.bround(F.stddev_samp("cumsum"), 3).alias("standard_deviation")
    )


def forecast_errors(rows: DataFrame) -> DataFrame:
    """Forecast against history, for rows that hold both."""
    error = F.col("error")
    kind = (
        F.when(error > 0, "Positive Error").when(error < 0, "Negative Error").otherwise("No Error")
    )
    return rows.withColumn("error", F.col("predicted") - F.col("cumsum")).withColumns(
        {
            "absolute_error": F.abs("error"),
            "error_pct": F.abs(F.col("predicted_pct") - F.col("share")) * 100,
            "error_type": kind,
        }
    )


def training_error(history: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """The history against the forecast made from it, row by row."""
    return forecast_errors(with_forecast(history, entity=entity))


def error_summary(
    errors: DataFrame, keys: Sequence[str], value: str = "absolute_error"
) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum in one aggregate."""
    stats = errors.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
        linear(value, [25, 50, 75]).alias("_points"),
        F.max(value).alias("max"),
    )
    quartiles = [
        F.col("_points")[i].alias(name) for i, name in enumerate(["quarter", "median", "threefourth"])
    ]
    return stats.select(*keys, "count", "mean", "stddev", "min", *quartiles, "max")


def moving_average(
    df: DataFrame, keys: Sequence[str], order: str, value: str, width: int
) -> DataFrame:
    """Trailing average over ``width`` rows; null until that many rows are there."""
    series = Window.partitionBy(*keys).orderBy(order)
    last = series.rowsBetween(-(width - 1), Window.currentRow)
    average = F.when(F.count(F.lit(1)).over(last) == width, F.avg(value).over(last))
    return df.withColumn("moving_average", average)
