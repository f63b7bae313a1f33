"""Arrival-time profiles per fund and per ticker.

Times are whole seconds here; ``profile_report`` turns them into HH:MM:SS text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.clock import after_cutoff, before_cutoff, clock_text, whole_seconds
from duskline.functions.percentiles import (
    linear,
    linear_profile,
    nearest_profile,
    within_fences,
)
from duskline.operators.cohorts import dedupe_arrivals
from duskline.operators.skew import weight_of, weighted_rows


STATS = ["total_days", "miss_days", "max_time_before_cutoff", "max_time"]


def _history_stats(arrivals: DataFrame, keys: Sequence[str], cutoff: int) -> DataFrame:
    """The first step reduces to one row per key and date and combines on the map side; the
    second then counts rows, with no distinct count and no joins."""
    daily = arrivals.groupBy(*keys, "nav_date").agg(
        F.sum(weight_of(arrivals)).alias("n_rows"),
        F.max("sec").alias("latest"),
        F.max(F.when(before_cutoff("sec", cutoff), F.col("sec"))).alias("latest_before"),
    )
    return daily.groupBy(*keys).agg(
        F.count("nav_date").alias("total_days"),
        F.count_if(after_cutoff("latest", cutoff)).alias("miss_days"),
        F.max("latest_before").alias("max_time_before_cutoff"),
        F.max("latest").alias("max_time"),
        F.sum("n_rows").alias("n_rows"),
    )


def sla_stats(
    arrivals: DataFrame,
    *,
    entity: str = "fund_id",
    cutoff: int = c.CUTOFF,
    by: Sequence[str] = (),
) -> DataFrame:
    """Days, days with an arrival after the cut-off, latest arrival before it, latest arrival."""
    return _history_stats(arrivals, [*by, entity], cutoff).select(*by, entity, *STATS)


def _of_cohort(rows: DataFrame, stats: DataFrame, entity: Sequence[str]) -> DataFrame:
    """The rows of the entities in ``stats``, with their statistics.

    The other cohort goes before any percentile is made. Statistics ride along as grouping
    columns, so nothing is joined afterwards.
    """
    return rows.join(stats, list(entity))


def arrival_profile_short(
    arrivals: DataFrame,
    *,
    client: str = "client_name",
    max_short: int = c.SHORT_HISTORY_DAYS,
    cutoff: int = c.CUTOFF,
    by: Sequence[str] = (),
) -> DataFrame:
    """Funds with a short history: 1% and 50% points and cut-off statistics.

    Takes arrivals or a counted history; ``by`` are further keys, such as the feed.
    """
    fund = [*by, "fund_id"]
    stats = sla_stats(arrivals, cutoff=cutoff, by=by).where(F.col("total_days") <= max_short)
    rows = _of_cohort(dedupe_arrivals(arrivals, client=client, by=by), stats, fund)
    keys = [*by, client, "fund_id"]
    points = linear_profile(rows, [*keys, *STATS], c.SHORT_RANKS)
    return points.select(*keys, *c.SHORT_RANKS, *STATS)


def arrival_profile_long(
    arrivals: DataFrame,
    *,
    client: str = "client_name",
    max_short: int = c.SHORT_HISTORY_DAYS,
    cutoff: int = c.CUTOFF,
    k: float = c.OUTLIER_FENCE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Funds with a long history: eleven quantiles without outliers, cut-off statistics and
    the alert time, five minutes ahead of the latest arrival before the cut-off.

    Takes arrivals or a counted history; ``by`` are further keys, such as the feed.
    """
    fund, keys = [*by, "fund_id"], [*by, client, "fund_id"]
    stats = sla_stats(arrivals, cutoff=cutoff, by=by).where(F.col("total_days") > max_short)
    rows = weighted_rows(dedupe_arrivals(arrivals, client=client, by=by), keys)
    inliers = within_fences(_of_cohort(rows, stats, fund), keys, k)
    points = linear_profile(inliers, [*keys, *STATS], c.LONG_RANKS, weight=F.col("n"))
    return points.select(
        *keys,
        *c.LONG_RANKS,
        *STATS,
        (F.col("max_time_before_cutoff") - c.CUTOFF_ALERT_LEAD).alias("alert_time"),
    )


def ticker_profile(
    arrivals: DataFrame,
    entities: DataFrame,
    *,
    client: str = "client_name",
    max_short: int = c.SHORT_HISTORY_DAYS,
    cutoff: int = c.CUTOFF,
    k: float = c.OUTLIER_FENCE,
) -> DataFrame:
    """Tickers with a long history: nearest-rank quantiles and the median without outliers,
    the alert time two minutes ahead of the 99% point, and the clients and funds served.

    Takes arrivals or a counted history.
    """
    ranks = {name: rank for name, rank in c.LONG_RANKS.items() if name != "predicted_time"}
    median = whole_seconds(linear("sec", [50], F.col("n"))[0]).alias("predicted_time")
    held = ["total_days", "miss_days", "max_time"]
    stats = _history_stats(arrivals, ["ticker"], cutoff).where(F.col("total_days") > max_short)
    rows = _of_cohort(weighted_rows(arrivals, ["ticker"]), stats.select("ticker", *held), ["ticker"])
    inliers = within_fences(rows, ["ticker"], k)
    kept = [F.max(name).alias(name) for name in held]
    points = nearest_profile(inliers, ["ticker"], ranks, "sec", median, *kept)
    return points.join(entities, "ticker").select(
        client,
        "fund_id",
        "ticker",
        *c.LONG_RANKS,
        (F.col("quantile99") - c.LATEST_ALERT_LEAD).alias("alert_time"),
        *held,
    )


def ticker_profile_short(
    arrivals: DataFrame,
    *,
    client: str = "client_name",
    max_short: int = c.SHORT_HISTORY_DAYS,
    cutoff: int = c.CUTOFF,
) -> DataFrame:
    """Tickers with a short history, per client and fund: 1% and 50% points and statistics.

    Takes arrivals or a counted history.
    """
    keys = [client, "fund_id", "ticker"]
    stats = _history_stats(arrivals, keys, cutoff).where(F.col("total_days") <= max_short)
    rows = weighted_rows(arrivals, keys)
    points = linear_profile(
        _of_cohort(rows, stats.select(*keys, *STATS), keys),
        [*keys, *STATS],
        c.SHORT_RANKS,
        weight=F.col("n"),
    )
    return points.select(*keys, *c.SHORT_RANKS, *STATS)


TIME_COLUMNS = [*c.LONG_RANKS, "max_time_before_cutoff", "max_time", "alert_time"]


def profile_report(profile: DataFrame, time_columns: Sequence[str] | None = None) -> DataFrame:
    """The profile with its times as HH:MM:SS text."""
    wanted = TIME_COLUMNS if time_columns is None else time_columns
    return profile.withColumns(
        {name: clock_text(name) for name in profile.columns if name in wanted}
    )


def linear_quantiles(
    arrivals: DataFrame, keys: Sequence[str], ranks: Sequence[float], value: str = "sec"
) -> DataFrame:
    """Exact interpolated percentiles (ranks in percent), one column per rank."""
    points = arrivals.groupBy(*keys).agg(linear(value, list(ranks)).alias("_points"))
    return points.select(
        *keys, *[F.col("_points")[i].alias(f"p{rank:02d}") for i, rank in enumerate(ranks)]
    )


def nearest_quantiles(
    arrivals: DataFrame, keys: Sequence[str], ranks: Sequence[float], value: str = "sec"
) -> DataFrame:
    """Nearest-rank percentiles (ranks in percent), one column per rank."""
    names = {f"p{rank:02d}": rank for rank in ranks}
    rows = weighted_rows(arrivals, keys, [value])
    return nearest_profile(rows, keys, names, value)


def weekday_profile(
    arrivals: DataFrame, *, entity: str = "fund_id", rank: float | None = None
) -> DataFrame:
    """Per entity the all-days time and one time for each of Monday to Friday, as text.

    The median, or the given rank rounded to the second; 00:00:00 for a day without rows.
    """
    names = ["all_days", "monday", "tuesday", "wednesday", "thursday", "friday"]

    def time_on(day: int | None) -> Column:
        value = F.col("sec") if day is None else F.when(F.weekday("nav_date") == day, F.col("sec"))
        point = linear(value, [50 if rank is None else rank])[0]
        if rank is not None:
            point = F.rint(F.round(point, 6)).cast("int")
        else:
            point = whole_seconds(point)
        return clock_text(F.coalesce(point, F.lit(0)))

    days = [None, 0, 1, 2, 3, 4]
    return arrivals.groupBy(entity).agg(
        *[time_on(day).alias(name) for day, name in zip(days, names, strict=True)]
    )


def time_summary(arrivals: DataFrame, *, entity: str = "fund_id") -> DataFrame:
    """Rows, median time and sample standard deviation of the time per entity, as text."""
    return arrivals.groupBy(entity).agg(
        F.count("sec").alias("n"),
        clock_text(whole_seconds(F.median("sec"))).alias("median_time"),
        clock_text(whole_seconds(F.stddev_samp("sec"))).alias("standard_deviation"),
    )


def modal_arrival_minute(arrivals: DataFrame, *, entity: str = "fund_id") -> DataFrame:
    """The most frequent minute of the day per entity, the lowest on a tie, 0 without rows."""
    minutes = arrivals.withColumn("minute", F.floor(F.col("sec") / 60).cast("int"))
    counts = minutes.groupBy(entity, "minute").agg(F.count("minute").alias("n"))
    best = F.max_by("minute", F.struct("n", (-F.col("minute")).alias("early")))
    mode = F.coalesce(best, F.lit(0))
    return counts.groupBy(entity).agg(
        mode.alias("modal_minute"), clock_text(mode * 60).alias("modal_time")
    )
