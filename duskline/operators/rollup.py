"""Rolling profiles up by the latest predicted time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 64


def keep_latest(
    profile: DataFrame,
    entity: str,
    time: str = "predicted_time",
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows holding the latest time of their entity, ties kept.

    Each entity is first cut into parts by a hash of its rows, and only the rows leading
    their part go on, so an entity holding many rows is not gathered in one task.
    """
    part = F.pmod(F.xxhash64(*profile.columns), F.lit(SPREAD))
    leading = (
        profile.withColumn("_part", part)
        .withColumn("_top", F.max(time).over(Window.partitionBy(*by, entity, "_part")))
        .where(F.col(time) == F.col("_top"))
    )
    return (
        leading.withColumn("_top", F.max(time).over(Window.partitionBy(*by, entity)))
        .where(F.col(time) == F.col("_top"))
        .drop("_top", "_part")
    )


def rollup_latest(
    profile: DataFrame,
    *,
    entity: str,
    drop: Sequence[str],
    rename: Mapping[str, str] | None = None,
    distinct: bool = True,
    time: str = "predicted_time",
) -> DataFrame:
    """One level up: the rows with the latest time of each entity, without ``drop``."""
    rows = keep_latest(profile, entity, time).drop(*drop)
    rows = rows.distinct() if distinct else rows
    return rows.withColumnsRenamed(dict(rename or {}))


def tickers_to_funds(profile: DataFrame, *, latest: str = "quantile99") -> DataFrame:
    """Fund profiles from ticker profiles; ``latest`` becomes the latest time of the fund
    (``max_time`` for short histories, which have no 99% point)."""
    return rollup_latest(
        profile,
        entity="fund_id",
        drop=["ticker"],
        rename={"quantile01": "fund_min_time", latest: "fund_max_time"},
    )


def funds_to_clients(funds: DataFrame) -> DataFrame:
    """Client profiles from fund profiles; funds that tie for the latest time all stay."""
    return rollup_latest(
        funds,
        entity="client_name",
        drop=["fund_id"],
        rename={"fund_min_time": "client_min_time", "fund_max_time": "client_max_time"},
        distinct=False,
    )


def one_row_per(
    profile: DataFrame, key: str, order: str = "fund_id", *, by: Sequence[str] = ()
) -> DataFrame:
    """The row with the lowest ``order`` for each key, ties settled by the other columns.

    A minimum over whole rows, so it combines on the map side.
    """
    ranked = [order, *[name for name in profile.columns if name != order]]
    first = profile.groupBy(*by, key).agg(F.min(F.struct(*ranked)).alias("_row"))
    return first.select("_row.*").select(*profile.columns)


def fund_rollup(
    profile: DataFrame,
    *,
    dedupe: str = "time",
    drop: Sequence[str] = ("fund_id", "total_days", "miss_days"),
    rename: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """For feeds without tickers: the latest rows of each fund, reduced to one row per
    predicted time (``dedupe="time"``) or per fund (``dedupe="fund"``), without ids."""
    keys = {"time": "predicted_time", "fund": "fund_id"}
    if dedupe not in keys:
        raise ValueError(f"dedupe is 'time' or 'fund', not {dedupe!r}")
    rows = one_row_per(keep_latest(profile, "fund_id", by=by), keys[dedupe], by=by)
    return rows.drop(*drop).distinct().withColumnsRenamed(dict(rename or {}))


def combine_reports(
    first: DataFrame, second: DataFrame, third: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Stack three report sets. The third may lack some columns; rows that are incomplete
    within the columns their own set has are dropped first."""
    complete = [df.select(*columns).na.drop("any") for df in (first, second)]
    held = [name for name in columns if name in third.columns]
    last = third.select(*held).na.drop("any")
    return (
        complete[0]
        .unionByName(complete[1])
        .unionByName(last, allowMissingColumns=True)
        .select(*columns)
    )
