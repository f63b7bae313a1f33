"""Exact percentiles.

``percentile`` as an aggregate combines on the map side: a task sends at most one entry per
second of the day for an entity, so an entity with very many arrivals is no burden. Windows
have no such step. What uses them takes weighted rows, which stand for ``n`` arrivals each;
arrivals are counted per entity and second before they get here (see
``duskline.operators.skew``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.functions.clock import whole_seconds


def linear(value: Column | str, ranks: Sequence[float], weight: Column | None = None) -> Column:
    """Percentiles by linear interpolation, all ranks (percent) in one pass."""
    fractions = [rank / 100 for rank in ranks]
    return F.percentile(value, fractions, F.lit(1) if weight is None else weight)


def linear_profile(
    rows: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, float],
    value: str = "sec",
    *,
    weight: Column | None = None,
) -> DataFrame:
    """One row per key with a truncated whole-second column for each rank."""
    points = rows.groupBy(*keys).agg(linear(value, list(ranks.values()), weight).alias("_points"))
    return points.select(
        *keys,
        *[whole_seconds(F.col("_points")[i]).alias(name) for i, name in enumerate(ranks)],
    )


def nearest_profile(
    rows: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, float],
    value: str = "sec",
    *others: Column,
) -> DataFrame:
    """Nearest-rank percentiles: position ``q * (n - 1)`` rounded half to even.

    The running count tells which value holds a position; ``others`` are further aggregates
    over the same groups.
    """
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_seen", F.sum("n").over(running)).withColumn(
        "_all", F.sum("n").over(whole)
    )
    picks = [
        F.min(
            F.when(F.col("_seen") > F.rint(F.lit(rank / 100) * (F.col("_all") - 1)), F.col(value))
        ).alias(name)
        for name, rank in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(*picks, *others)


def fence_columns(points: Column, k: float) -> tuple[Column, Column]:
    """Lower and upper fence from an array holding the 25% and 75% points."""
    spread = points[1] - points[0]
    return points[0] - k * spread, points[1] + k * spread


def within_fences(
    rows: DataFrame, keys: Sequence[str], k: float, value: str = "sec"
) -> DataFrame:
    """Rows strictly inside the interquartile fences of their entity."""
    points = linear(value, [25, 75], F.col("n")).over(Window.partitionBy(*keys))
    low, high = fence_columns(F.col("_points"), k)
    return (
        rows.withColumn("_points", points)
        .where((F.col(value) > low) & (F.col(value) < high))
        .drop("_points")
    )
