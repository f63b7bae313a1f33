"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.functions.clock import bucket_floor, day_fraction, seconds_from_text
from duskline.operators import (
    alerts,
    cohorts,
    counted,
    curves,
    daily,
    forecast,
    history,
    outliers,
    profiles,
    quality,
    residuals,
    rollup,
)
from duskline.plans.deliveries import store_deliveries
from duskline.sources import arrivals as feed
from duskline.sources import schemas, sinks, tables
from registry import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CURVE_COLUMNS = [
    "quantile01",
    "quantile05",
    "quantile10",
    "quantile15",
    "quantile20",
    "predicted_time",
    "quantile60",
    "quantile70",
    "quantile80",
    "quantile95",
    "quantile99",
    "alert_time",
    "max_time_before_cutoff",
    "max_time",
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places: the last bit of a mean depends on the order of rows."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({name: F.round(name, places) for name in doubles})


def _new_folder(spark, name):
    return f"{sinks.shared_folder(spark)}/duskline-{name}-{uuid4().hex}"


# Normalising, cohorts, identities


@query
def normalize_arrivals(spark, sf_dir):
    raw = fx.as_text(fx.dense(spark, sf_dir))
    return feed.normalize_arrivals(raw, first="2024-01-02", last="2024-01-29")


@query
def normalization_audit(spark, sf_dir):
    return feed.normalization_audit(fx.as_text(fx.dense(spark, sf_dir)))


@query
def grid_audit(spark, sf_dir):
    return feed.grid_audit(fx.dense(spark, sf_dir))


@query
def time_parts(spark, sf_dir):
    rows = feed.split_timestamp(feed.with_arrival_timestamp(fx.dense(spark, sf_dir)))
    return rows.select(
        "ticker",
        "arrival_date",
        "arrival_time",
        F.round(day_fraction("sec"), 9).alias("event_time_numeric"),
        seconds_from_text(F.concat("arrival_time", F.lit(".250"))).alias("seconds"),
        F.weekday("arrival_date").alias("weekday"),
    )


@query
def active_cohort(spark, sf_dir):
    return cohorts.active_cohort(fx.sparse(spark, sf_dir))


@query
def inactive_cohort(spark, sf_dir):
    return cohorts.inactive_cohort(fx.sparse(spark, sf_dir))


@query
def forced_cohort(spark, sf_dir):
    return cohorts.active_cohort(
        fx.sparse(spark, sf_dir), month="1998-04-15", always_include=["7", "8", "11"]
    )


@query
def history_split(spark, sf_dir):
    return cohorts.history_split(fx.sparse(spark, sf_dir))


@query
def history_length(spark, sf_dir):
    return cohorts.history_length(fx.sparse(spark, sf_dir))


@query
def entity_map(spark, sf_dir):
    return cohorts.entity_map(fx.sparse(spark, sf_dir))


@query
def dedupe_arrivals(spark, sf_dir):
    return cohorts.dedupe_arrivals(fx.skewed(spark, sf_dir))


@query
def arrival_counts(spark, sf_dir):
    return cohorts.arrival_counts(fx.skewed(spark, sf_dir))


@query
def fund_counts(spark, sf_dir):
    return cohorts.fund_counts(fx.skewed(spark, sf_dir))


@query
def client_keys(spark, sf_dir):
    return cohorts.client_keys(fx.sparse(spark, sf_dir))


@query
def client_joined(spark, sf_dir):
    rows = fx.sparse(spark, sf_dir)
    return cohorts.with_client_identifier(rows, cohorts.client_keys(rows))


# Quantiles, outliers, profiles


@query
def quantile_linear(spark, sf_dir):
    ranks = [1, 5, 10, 15, 20, 25, 50, 60, 70, 75, 80, 95, 99]
    return rounded(profiles.linear_quantiles(fx.dense(spark, sf_dir), ["fund_id"], ranks))


@query
def quantile_nearest(spark, sf_dir):
    ranks = [1, 5, 10, 15, 20, 60, 70, 80, 95, 99]
    return profiles.nearest_quantiles(fx.dense(spark, sf_dir), ["ticker"], ranks)


@query
def iqr_split(spark, sf_dir):
    rows = outliers.label_outliers(fx.skewed(spark, sf_dir), ["ticker"], k=3.0)
    return rounded(rows)


@query
def iqr_split_narrow(spark, sf_dir):
    rows = fx.skewed(spark, sf_dir)
    return outliers.iqr_split(rows, ["fund_id"], k=1.5).outliers


@query
def iqr_on_fence(spark, sf_dir):
    # Whole minutes put values on the fences.
    rows = fx.skewed(spark, sf_dir).withColumn("sec", bucket_floor("sec", 60))
    return outliers.zone_counts(rows, ["ticker"], k=1.5)


@query
def outlier_counts(spark, sf_dir):
    return outliers.outlier_counts(fx.skewed(spark, sf_dir), "ticker")


@query
def outlier_times(spark, sf_dir):
    found = outliers.iqr_split(fx.skewed(spark, sf_dir), ["ticker"]).outliers
    return outliers.outlier_times(found)


@query
def sla_stats(spark, sf_dir):
    return profiles.sla_stats(fx.sparse(spark, sf_dir))


@query
def arrival_profile_short(spark, sf_dir):
    return profiles.profile_report(profiles.arrival_profile_short(fx.sparse(spark, sf_dir)))


@query
def arrival_profile_long(spark, sf_dir):
    return profiles.profile_report(profiles.arrival_profile_long(fx.dense(spark, sf_dir)))


@query
def arrival_profile_long_skewed(spark, sf_dir):
    return profiles.profile_report(profiles.arrival_profile_long(fx.skewed(spark, sf_dir)))


def _ticker_profile(spark, sf_dir):
    rows = fx.skewed(spark, sf_dir)
    return profiles.ticker_profile(rows, cohorts.entity_map(rows))


@query
def ticker_profile(spark, sf_dir):
    return profiles.profile_report(_ticker_profile(spark, sf_dir))


@query
def ticker_profile_short(spark, sf_dir):
    return profiles.profile_report(profiles.ticker_profile_short(fx.sparse(spark, sf_dir)))


@query
def weekday_profile_median(spark, sf_dir):
    return profiles.weekday_profile(fx.sparse(spark, sf_dir))


@query
def weekday_profile_quantile(spark, sf_dir):
    return profiles.weekday_profile(fx.dense(spark, sf_dir), rank=95)


@query
def time_summary(spark, sf_dir):
    return profiles.time_summary(fx.dense(spark, sf_dir), entity="ticker")


@query
def modal_minute(spark, sf_dir):
    return profiles.modal_arrival_minute(fx.dense(spark, sf_dir))


# Roll-ups and reports


@query
def rollup_ticker_fund(spark, sf_dir):
    return profiles.profile_report(
        rollup.tickers_to_funds(_ticker_profile(spark, sf_dir)),
        [*profiles.TIME_COLUMNS, "fund_min_time", "fund_max_time"],
    )


@query
def rollup_fund_client(spark, sf_dir):
    funds = rollup.tickers_to_funds(_ticker_profile(spark, sf_dir))
    return profiles.profile_report(
        rollup.funds_to_clients(funds),
        [*profiles.TIME_COLUMNS, "client_min_time", "client_max_time"],
    )


@query
def rollup_ticker_fund_short(spark, sf_dir):
    short = profiles.ticker_profile_short(fx.sparse(spark, sf_dir))
    return profiles.profile_report(
        rollup.tickers_to_funds(short, latest="max_time"),
        [*profiles.TIME_COLUMNS, "fund_min_time", "fund_max_time"],
    )


@query
def rollup_fund_client_short(spark, sf_dir):
    short = profiles.ticker_profile_short(fx.sparse(spark, sf_dir))
    funds = rollup.tickers_to_funds(short, latest="max_time")
    return profiles.profile_report(
        rollup.funds_to_clients(funds),
        [*profiles.TIME_COLUMNS, "client_min_time", "client_max_time"],
    )


@query
def rollup_time_dedupe(spark, sf_dir):
    profile = profiles.arrival_profile_short(fx.sparse(spark, sf_dir))
    return profiles.profile_report(rollup.fund_rollup(profile, dedupe="time"))


@query
def rollup_fund_dedupe(spark, sf_dir):
    profile = profiles.arrival_profile_long(fx.skewed(spark, sf_dir))
    rows = rollup.fund_rollup(
        profile,
        dedupe="fund",
        drop=["fund_id", "total_days", "miss_days", "max_time_before_cutoff", "max_time"],
        rename={"quantile99": "client_max_time", "quantile01": "client_min_time"},
    )
    return profiles.profile_report(
        rows, [*profiles.TIME_COLUMNS, "client_min_time", "client_max_time"]
    )


@query
def combine_reports(spark, sf_dir):
    # One published profile feeds the three report sets.
    short = sinks.settle(
        profiles.profile_report(profiles.ticker_profile_short(fx.sparse(spark, sf_dir)))
    )
    columns = short.columns
    early, likely = F.col("quantile01") < "18:05:00", F.col("predicted_time") < "18:05:00"
    return rollup.combine_reports(
        short.where(early & ~likely),
        short.where(likely),
        short.where(~early).drop("max_time_before_cutoff"),
        columns,
    )


# Volume


def _long_curve(spark, sf_dir, edge):
    profile = profiles.arrival_profile_long(fx.sparse(spark, sf_dir))
    return curves.volume_curve_5min(profile, CURVE_COLUMNS, edge=edge)


@query
def volume_curve_5min_keep(spark, sf_dir):
    return _long_curve(spark, sf_dir, "keep")


@query
def volume_curve_5min_zero(spark, sf_dir):
    return _long_curve(spark, sf_dir, "zero")


@query
def curve_ends(spark, sf_dir):
    return curves.curve_ends(_long_curve(spark, sf_dir, "keep"))


@query
def volume_curve_1min_short(spark, sf_dir):
    profile = profiles.arrival_profile_short(fx.sparse(spark, sf_dir))
    return curves.volume_curve_1min(profile, "max_time")


@query
def volume_curve_1min_long(spark, sf_dir):
    profile = profiles.arrival_profile_long(fx.sparse(spark, sf_dir))
    return curves.volume_curve_1min(profile, "quantile99")


@query
def volume_totals(spark, sf_dir):
    return curves.volume_totals(volume_curve_1min_long(spark, sf_dir))


@query
def bucket_counts(spark, sf_dir):
    rows = feed.with_arrival_timestamp(fx.dense(spark, sf_dir))
    return curves.bucket_counts(rows, ["client_name"])


@query
def bucket_floor_counts(spark, sf_dir):
    profile = profiles.arrival_profile_short(fx.sparse(spark, sf_dir))
    return curves.second_buckets(profile)


@query
def bin_history(spark, sf_dir):
    return history.bin_history(fx.dense(spark, sf_dir))


@query
def bin_history_keyed(spark, sf_dir):
    rows = fx.dense(spark, sf_dir)
    known = cohorts.with_client_identifier(rows, cohorts.client_keys(rows))
    return history.bin_history(known, entity="client_identifier")


# Forecast and its quality


def _history(spark, sf_dir):
    return history.bin_history(fx.dense(spark, sf_dir))


def _errors(spark, sf_dir):
    return quality.training_error(_history(spark, sf_dir))


@query
def end_of_day_volume(spark, sf_dir):
    return forecast.end_of_day_volume(_history(spark, sf_dir))


@query
def bin_forecast(spark, sf_dir):
    return rounded(forecast.bin_forecast(_history(spark, sf_dir)))


@query
def forecast_totals(spark, sf_dir):
    return forecast.forecast_totals(forecast.bin_forecast(_history(spark, sf_dir)))


@query
def limit_table(spark, sf_dir):
    """The bin texts come from a CSV file, as they do in production."""
    path = _new_folder(spark, "bins")
    axis = tables.bin_axis(spark).select(
        F.col("bin_label").alias("Bin"), F.col("time_bin").alias("Time_Bin")
    )
    sinks.publish_report(axis, path, "csv")
    rows = forecast.bin_forecast(_history(spark, sf_dir))
    return forecast.limit_table(rows, tables.read_time_bins(spark, path))


@query
def actual_totals(spark, sf_dir):
    return history.actual_totals(_history(spark, sf_dir))


@query
def xmr_limits(spark, sf_dir):
    return quality.xmr_limits(_history(spark, sf_dir))


@query
def spread_bin(spark, sf_dir):
    return quality.spread(_history(spark, sf_dir), ["client_name", "weekday", "bin"])


@query
def spread_weekday(spark, sf_dir):
    return quality.spread(_history(spark, sf_dir), ["client_name", "weekday"])


@query
def spread_overall(spark, sf_dir):
    return quality.spread(_history(spark, sf_dir), ["weekday"])


@query
def training_error(spark, sf_dir):
    return rounded(_errors(spark, sf_dir)).select(
        "client_name",
        "nav_date",
        "weekday",
        "bin",
        "cumsum",
        "predicted",
        "error",
        "absolute_error",
        "error_pct",
        "error_type",
    )


@query
def stored_forecast_error(spark, sf_dir):
    """The history against a forecast that was stored before."""
    path = _new_folder(spark, "forecast")
    days = _history(spark, sf_dir)
    sinks.publish_report(forecast.bin_forecast(days), path)
    stored = tables.read_files(spark, path)
    rows = quality.forecast_errors(forecast.join_forecast(days, stored))
    return rounded(rows).select("client_name", "nav_date", "bin", "predicted", "green", "error")


@query
def error_summary_client(spark, sf_dir):
    keys = ["client_name", "weekday"]
    return rounded(quality.error_summary(_errors(spark, sf_dir), keys))


@query
def error_summary_bin(spark, sf_dir):
    keys = ["client_name", "weekday", "bin"]
    return rounded(quality.error_summary(_errors(spark, sf_dir), keys))


@query
def error_summary_pct(spark, sf_dir):
    keys = ["client_name", "weekday", "bin"]
    return rounded(quality.error_summary(_errors(spark, sf_dir), keys, "error_pct"))


@query
def moving_average(spark, sf_dir):
    days = history.daily_volume(_history(spark, sf_dir))
    return rounded(quality.moving_average(days, ["client_name"], "nav_date", "volume", 3))


# Alerts


@query
def alert_level(spark, sf_dir):
    rows = alerts.with_alerts(_errors(spark, sf_dir))
    return rows.select("client_name", "nav_date", "bin", "cumsum", "predicted", "alert")


@query
def alert_summary(spark, sf_dir):
    return rounded(alerts.alert_summary(alerts.with_alerts(_errors(spark, sf_dir))))


@query
def alert_pivot(spark, sf_dir):
    return alerts.alert_pivot(alerts.with_alerts(_errors(spark, sf_dir)))


# Validation


# Nine places: a time over 86,400 with an end has at most seven, so none is cut at a half.


def _residuals(spark, sf_dir):
    rows = fx.skewed(spark, sf_dir)
    found = outliers.iqr_split(rows, ["ticker"]).outliers
    return residuals.counted_residuals(rows, _ticker_profile(spark, sf_dir), found)


@query
def prediction_residuals(spark, sf_dir):
    return rounded(_residuals(spark, sf_dir), 9).drop("n")


@query
def mae_overall(spark, sf_dir):
    return rounded(residuals.mae_overall(_residuals(spark, sf_dir)), 9)


@query
def mae_ticker(spark, sf_dir):
    return rounded(residuals.mae_by(_residuals(spark, sf_dir), "ticker"), 9)


@query
def mae_fund(spark, sf_dir):
    return rounded(residuals.mae_by(_residuals(spark, sf_dir), "fund_id"), 9)


@query
def mae_client(spark, sf_dir):
    return rounded(residuals.mae_by(_residuals(spark, sf_dir), "client_name"), 9)


@query
def signed_errors_ticker(spark, sf_dir):
    return rounded(residuals.signed_errors(_residuals(spark, sf_dir), "ticker"), 9)


@query
def signed_errors_fund(spark, sf_dir):
    known = cohorts.entity_map(fx.skewed(spark, sf_dir))
    return rounded(residuals.client_fund_errors(_residuals(spark, sf_dir), known), 9)


@query
def ticker_report(spark, sf_dir):
    return rounded(residuals.ticker_report(_residuals(spark, sf_dir)), 9)


# Feeds that have funds but no tickers


def _fund_residuals(spark, sf_dir):
    rows = fx.skewed(spark, sf_dir).drop("ticker")
    found = outliers.iqr_split(rows, ["fund_id"]).outliers
    profile = profiles.arrival_profile_long(rows)
    return residuals.counted_residuals(rows, profile, found, entity=["fund_id"])


@query
def fund_residuals(spark, sf_dir):
    return rounded(_fund_residuals(spark, sf_dir), 9)


@query
def fund_mae_overall(spark, sf_dir):
    return rounded(residuals.mae_overall(_fund_residuals(spark, sf_dir)), 9)


@query
def fund_signed_errors(spark, sf_dir):
    known = cohorts.entity_map(fx.skewed(spark, sf_dir), ["client_name", "fund_id"])
    return rounded(residuals.client_fund_errors(_fund_residuals(spark, sf_dir), known), 9)


@query
def fund_report(spark, sf_dir):
    return rounded(residuals.fund_report(_fund_residuals(spark, sf_dir)), 9)


# The counted history: written once, laid out by its key, with numbered clients


def _laid_out(spark, rows, key):
    names = sinks.settle(cohorts.client_keys(rows))
    numbered = cohorts.numbered_clients(rows, names)
    path = _new_folder(spark, "history")
    return sinks.publish_keyed(counted.counted_history(numbered), path, key), names


KEY = "client_identifier"


@query
def profile_short_from_history(spark, sf_dir):
    days, names = _laid_out(spark, fx.sparse(spark, sf_dir).drop("ticker"), "fund_id")
    profile = profiles.arrival_profile_short(days, client=KEY)
    return profiles.profile_report(cohorts.named_clients(profile, names))


@query
def profile_long_from_history(spark, sf_dir):
    days, names = _laid_out(spark, fx.skewed(spark, sf_dir).drop("ticker"), "fund_id")
    profile = profiles.arrival_profile_long(days, client=KEY)
    return profiles.profile_report(cohorts.named_clients(profile, names))


@query
def ticker_profile_from_history(spark, sf_dir):
    days, names = _laid_out(spark, fx.skewed(spark, sf_dir), "ticker")
    entities = cohorts.named_clients(cohorts.entity_map(days, [KEY, "fund_id", "ticker"]), names)
    return profiles.profile_report(profiles.ticker_profile(days, entities))


@query
def ticker_profile_short_from_history(spark, sf_dir):
    days, names = _laid_out(spark, fx.sparse(spark, sf_dir), "ticker")
    profile = profiles.ticker_profile_short(days, client=KEY)
    return profiles.profile_report(cohorts.named_clients(profile, names))


@query
def outliers_from_history(spark, sf_dir):
    days, names = _laid_out(spark, fx.skewed(spark, sf_dir), "ticker")
    return cohorts.named_clients(outliers.history_outliers(days, ["ticker"]), names)


@query
def outlier_counts_from_history(spark, sf_dir):
    days, _ = _laid_out(spark, fx.skewed(spark, sf_dir), "ticker")
    return outliers.outlier_counts(days, "ticker")


@query
def sla_stats_from_history(spark, sf_dir):
    days, _ = _laid_out(spark, fx.sparse(spark, sf_dir).drop("ticker"), "fund_id")
    return profiles.sla_stats(days)


@query
def profile_gaps(spark, sf_dir):
    return counted.profile_gaps(fx.uneven(spark, sf_dir))


@query
def profiles_by_feed(spark, sf_dir):
    profile = profiles.arrival_profile_long(fx.two_feeds(spark, sf_dir), by=["feed"])
    return profiles.profile_report(profile)


@query
def volume_curve_by_feed(spark, sf_dir):
    profile = profiles.arrival_profile_long(fx.two_feeds(spark, sf_dir), by=["feed"])
    return curves.volume_curve_5min(profile, CURVE_COLUMNS, by=["feed"])


@query
def volume_curve_5min_funds_short(spark, sf_dir):
    short = profiles.ticker_profile_short(fx.sparse(spark, sf_dir))
    funds = rollup.tickers_to_funds(short, latest="max_time")
    times = ["fund_min_time", "predicted_time", "max_time_before_cutoff", "fund_max_time"]
    return curves.volume_curve_5min(funds, times)


# History by the day


def _state(spark, sf_dir, rows, entity):
    """All days but the latest first, then the latest by itself."""
    path = _new_folder(spark, "days")
    latest = rows.agg(F.max("nav_date").alias("day")).first()["day"]
    earlier = rows.where(F.col("nav_date") < F.lit(latest))
    daily.write_state(daily.day_state(earlier, entity=entity), path)
    daily.add_day(rows, path, latest, entity=entity)
    return daily.read_state(spark, path, f"{entity} string")


@query
def history_increment(spark, sf_dir):
    state = _state(spark, sf_dir, fx.dense(spark, sf_dir), "client_name")
    return daily.history_from_state(state)


@query
def stats_increment(spark, sf_dir):
    state = _state(spark, sf_dir, fx.dense(spark, sf_dir), "fund_id")
    return daily.stats_from_state(state, entity="fund_id")


# Deliveries and what is stored of them


@query
def rejected_rows(spark, sf_dir):
    return feed.rejected_rows(fx.as_text(fx.dense(spark, sf_dir)))


@query
def observed_drops(spark, sf_dir):
    """Counted while the arrivals are written."""
    stored = store_deliveries(fx.as_text(fx.dense(spark, sf_dir)), _new_folder(spark, "deliveries"))
    return stored["drops"]


@query
def active_cohort_partitioned(spark, sf_dir):
    """As ``active_cohort``, from arrivals stored by month."""
    path = _new_folder(spark, "arrivals")
    rows = fx.sparse(spark, sf_dir)
    sinks.publish_arrivals(rows, path)
    stored = tables.read_arrivals(spark, path, rows.schema)
    return cohorts.active_cohort(stored).drop("yyyymm")


@query
def stored_date_range(spark, sf_dir):
    """Arrivals of some weeks out of a store of many months."""
    path = _new_folder(spark, "arrivals")
    rows = fx.sparse(spark, sf_dir)
    sinks.publish_arrivals(rows, path)
    return tables.read_arrivals(spark, path, rows.schema, "1995-03-10", "1995-05-20")


@query
def client_keys_merged(spark, sf_dir):
    """A dimension from the first days, and the names that came later."""
    rows = fx.sparse(spark, sf_dir)
    first = sinks.settle(cohorts.client_keys(rows.where("nav_date <= DATE '1992-01-03'")))
    return cohorts.merge_client_keys(first, rows)


@query
def catalog_table(spark, sf_dir):
    """A table of the catalog, with a column list."""
    name = f"duskline_arrivals_{uuid4().hex}"
    path = _new_folder(spark, "table")
    fx.sparse(spark, sf_dir).write.format("parquet").option("path", path).saveAsTable(name)
    return tables.read_table(spark, name, ["client_name", "fund_id", "nav_date"])


# Publishing: each writes to the shared folder and returns what is read back


@query
def partition_overwrite(spark, sf_dir):
    """Three months are published, then one of them again; the other two stay."""
    path = _new_folder(spark, "months")
    daily = (
        fx.sparse(spark, sf_dir)
        .groupBy("client_name", F.date_format("nav_date", "yyyyMM").alias("yyyymm"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    latest = sinks.month_of_latest(fx.sparse(spark, sf_dir))
    sinks.overwrite_months(daily.withColumn("run", F.lit(1)), path)
    sinks.overwrite_months(daily.where(F.col("yyyymm") == latest).withColumn("run", F.lit(2)), path)
    schema = "client_name string, n bigint, run int, yyyymm string"
    return spark.read.schema(schema).parquet(path)


@query
def read_month(spark, sf_dir):
    """One monthly partition of a published client dimension."""
    path = _new_folder(spark, "clients")
    rows = fx.sparse(spark, sf_dir)
    sinks.overwrite_months(sinks.with_month(cohorts.client_keys(rows), rows), path)
    stored = spark.read.schema(schemas.CLIENTS).parquet(path)
    return tables.read_partition(stored, sinks.month_of_latest(rows))


@query
def csv_report(spark, sf_dir):
    """A report published as CSV and read back with its schema."""
    path = _new_folder(spark, "report")
    profile = profiles.profile_report(profiles.arrival_profile_short(fx.sparse(spark, sf_dir)))
    sinks.publish_report(profile, path, "csv")
    return tables.read_csv(spark, path, profile.schema)


@query
def report_view(spark, sf_dir):
    """A result named for SQL."""
    profile = profiles.arrival_profile_short(fx.sparse(spark, sf_dir))
    name = f"short_profile_{uuid4().hex}"
    sinks.share_view(profile, name)
    return spark.sql(
        "SELECT client_name, count(*) AS funds, max(predicted_time) AS latest "
        f"FROM {name} GROUP BY client_name"
    )
