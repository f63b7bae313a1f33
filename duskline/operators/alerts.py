"""Colour alerts from actual volume and forecast levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskline import constants as c


def alert_level() -> Column:
    """The first level that applies; after rounding the levels may touch, so order counts."""
    volume = F.col("cumsum")
    return (
        F.when(volume >= F.col("predicted"), "GREEN")
        .when(volume >= F.col("red_20"), "AMBER")
        .when(volume < F.col("red_1"), "RED_1")
        .when(volume < F.col("red_5"), "RED_5")
        .when(volume < F.col("red_10"), "RED_10")
        .when(volume < F.col("red_20"), "RED_20")
    )


def with_alerts(errors: DataFrame) -> DataFrame:
    return errors.withColumn("alert", alert_level())


def alert_summary(alerts: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """Rows per alert with nested red totals, rows seen and the red allowance.

    The labels are fixed, so one aggregate counts them; a label that is absent counts 0.
    """
    counts = alerts.groupBy(entity, "weekday").agg(
        *[
            F.count_if(F.col("alert") == label).alias(f"_{label.lower()}")
            for label in c.ALERT_LABELS
        ],
        F.count("n").alias("rows_seen"),
    )
    red_5 = F.col("_red_5") + F.col("_red_1")
    red_10 = F.col("_red_10") + red_5
    return counts.select(
        entity,
        "weekday",
        F.col("_green").alias("green"),
        F.col("_amber").alias("amber"),
        F.col("_red_1").alias("red_1"),
        red_5.alias("red_5"),
        red_10.alias("red_10"),
        (F.col("_red_20") + red_10).alias("red_20"),
        "rows_seen",
        (F.col("rows_seen") * F.lit(c.RED_ALLOWANCE)).alias("red_max_count"),
    )


def alert_pivot(alerts: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """Plain counts, one column per label."""
    return (
        alerts.groupBy(entity, "weekday")
        .pivot("alert", c.ALERT_LABELS)
        .agg(F.count(F.lit(1)))
        .na.fill(0, c.ALERT_LABELS)
        .withColumnsRenamed({label: label.lower() for label in c.ALERT_LABELS})
    )
