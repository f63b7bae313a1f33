"""Cases worked out by hand, and properties that must hold on any data."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import MIDDLE, sec
from pyspark.sql import functions as F

from duskline.functions import clock
from duskline.functions.percentiles import nearest_profile
from duskline.operators import (
    alerts,
    cohorts,
    curves,
    forecast,
    history,
    joins,
    outliers,
    profiles,
    quality,
    residuals,
    rollup,
    skew,
)
from duskline.plans.stages import Stages
from duskline.sources import arrivals as feed
from duskline.sources import schemas, sinks, tables
from registry import fixtures as fx


def rows(df):
    return sorted(tuple(row) for row in df.collect())


# Time of day


def test_clock_expressions(spark):
    df = spark.createDataFrame([(57600,), (65100,), (68400,), (57601,), (57540,)], "sec int")
    found = df.select(
        clock.clock_text("sec"),
        clock.bin_index("sec"),
        clock.bin_label(clock.bin_index("sec")),
        clock.ceil_minute("sec"),
        clock.minute_slot("sec"),
        clock.before_cutoff("sec"),
        clock.after_cutoff("sec"),
        clock.bin_index("sec", fold_out_of_range=True),
    ).collect()
    assert [tuple(row) for row in found] == [
        ("16:00:00", 1, 961, 57600, 0, True, False, 1),
        ("18:05:00", 26, 1086, 65100, 125, False, False, 26),
        ("19:00:00", 37, 1141, 68400, 180, False, True, 25),
        ("16:00:01", 1, 961, 57660, 1, True, False, 1),
        ("15:59:00", 0, 956, 57540, 0, True, False, 36),
    ]


def test_time_text(spark):
    df = spark.createDataFrame([("16:05:03.250",), ("18:05:00",)], "t string")
    assert rows(df.select(clock.seconds_from_text("t"))) == [(57903,), (65100,)]
    bad = spark.createDataFrame([("1900:00",)], "t string")
    with pytest.raises(Exception, match="INVALID|CAST"):
        bad.select(clock.seconds_from_text("t")).collect()


def test_normalize_keeps_real_dates_only(spark):
    raw = spark.createDataFrame(
        [
            ("4/9/2018", " F 1 ", "Ann", "4/9/18 16:05", "a"),
            ("04/30/2018", "F2", "Ann", "04/30/18 18:05", "b"),
            ("4/31/2018", "F3", "Ann", "4/30/18 16:05", "c"),
            ("4/30/2018", "F4", "Ann", "soon", "d"),
            ("4/30/2018", "F5", None, "4/30/18 16:05", "e"),
            ("5/1/2018", "F6", "Ann", "5/1/18 16:05", "f"),
        ],
        schemas.RAW_ARRIVALS,
    )
    found = feed.normalize_arrivals(raw, first="2017-10-02", last="2018-04-30")
    assert rows(found.select("fund_id", "nav_date", "sec")) == [
        ("F1", dt.date(2018, 4, 9), sec("16:05:00")),
        ("F2", dt.date(2018, 4, 30), sec("18:05:00")),
    ]
    assert rows(feed.normalization_audit(raw)) == [(6, 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        feed.normalize_arrivals(raw, last="2018-04-31")


# Percentiles


@pytest.mark.parametrize(("rank", "expected"), [(10, 1), (30, 3), (50, 3), (70, 5)])
def test_nearest_rank_rounds_half_to_even(spark, rank, expected):
    # Six values: positions 0.5, 1.5, 2.5 and 3.5 go to 0, 2, 2 and 4.
    df = spark.createDataFrame([("k", v) for v in range(1, 7)], "k string, sec int")
    found = nearest_profile(skew.weighted_rows(df, ["k"]), ["k"], {"p": rank})
    assert rows(found) == [("k", expected)]


def test_mode_takes_the_lowest_on_a_tie(arrivals):
    df = arrivals(
        [
            ("C", "F1", "T", 2, "17:10:59"),
            ("C", "F1", "T", 3, "17:10:00"),
            ("C", "F1", "T", 4, "16:20:01"),
            ("C", "F1", "T", 5, "16:20:59"),
            ("C", "F1", "T", 8, "18:00:00"),
        ]
    )
    empty = df.limit(1).withColumns({"fund_id": F.lit("F0"), "sec": F.lit(None).cast("int")})
    found = profiles.modal_arrival_minute(df.unionByName(empty))
    assert rows(found) == [("F0", 0, "00:00:00"), ("F1", 980, "16:20:00")]


def test_weekday_profile_fills_empty_days(arrivals):
    # 1 January 2024 is a Monday; the 6th is a Saturday and counts for all days only.
    df = arrivals(
        [
            ("C", "F", "T", 1, "16:00:00"),
            ("C", "F", "T", 8, "16:00:01"),
            ("C", "F", "T", 6, "18:00:00"),
        ]
    )
    assert rows(profiles.weekday_profile(df)) == [
        ("F", "16:00:01", "16:00:00", *["00:00:00"] * 4)
    ]
    assert rows(profiles.weekday_profile(df, rank=50))[0][2] == "16:00:00"


# Outliers


def test_values_on_a_fence_are_in_neither_part(spark):
    df = spark.createDataFrame(
        [("a", v) for v in (10, 20, 20, 30, 30, 45, 5)] + [("b", 7)] * 4 + [("b", 8)],
        "k string, sec int",
    )
    # a: quartiles 15 and 30, fences at 1.5 are -7.5 and 52.5. b: no spread at all.
    split = outliers.iqr_split(df, ["k"], k=1.5)
    assert rows(split.outliers) == [("b", 8)]
    assert rows(split.on_fence) == [("b", 7)] * 4
    assert split.inliers.count() == 7
    assert rows(outliers.zone_counts(df, ["k"], k=1.5)) == [("a", 7, 0, 0), ("b", 0, 1, 4)]


def test_split_parts_add_up(spark):
    df = fx.skewed(spark, MIDDLE)
    split = outliers.iqr_split(df, ["ticker"], k=3.0)
    parts = split.inliers.unionAll(split.outliers).unionAll(split.on_fence)
    assert parts.exceptAll(df).count() == 0 and df.exceptAll(parts).count() == 0


# Cohorts and joins


def test_cohorts_part_the_rows(spark, arrivals):
    df = arrivals(
        [("C", "F1", "T", day, "16:00:00") for day in range(1, 6)]
        + [("C", "F1", "T", 5, "17:00:00")]
        + [("C", "F2", "T", day, "16:00:00") for day in range(1, 7)]
    )
    split = cohorts.history_split(df)
    assert rows(split.select("fund_id", "cohort").distinct()) == [("F1", "short"), ("F2", "long")]
    rest = cohorts.inactive_cohort(df, month="2024-02-10")
    assert rest.count() == df.count()
    forced = cohorts.active_cohort(df, month="2024-02-10", always_include=["F2"])
    assert forced.count() == 6
    both = cohorts.active_cohort(df, always_include=["F2"])
    assert both.count() == df.count()


def test_dedupe_keeps_the_lowest_client(arrivals):
    df = arrivals([("B", "F", "T", 1, "16:00:00"), ("A", "F", "T", 1, "16:00:00")])
    assert rows(cohorts.dedupe_arrivals(df)) == [("A", "F", dt.date(2024, 1, 1), 57600)]


def test_client_keys_are_dense_over_many_partitions(spark):
    names = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(name,) for name in names * 2], "client_name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(cohorts.client_keys(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == [(i + 1, name) for i, name in enumerate(sorted(names))]


def test_client_dimension_drops_the_null_name(spark, arrivals):
    clients = spark.createDataFrame(
        [(1, "A", "m"), (1, "A", "m"), (2, "NULL", "m")], schemas.CLIENTS
    )
    df = arrivals([(n, "F", "T", 1, "16:00:00") for n in ("A", "NULL", "Z")])
    assert rows(cohorts.with_client_identifier(df, clients).select("client_identifier")) == [(1,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_without_broadcast_is_the_same(spark, how):
    # Key 0 holds a third of all rows and a sixth of the rows have no key.
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 6 != 1, F.col("id") % 500)
        .alias("k"),
        F.col("id").alias("v"),
    )
    lookup = spark.range(0, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    small = joins.lookup_join(facts, lookup, ["k"], how)
    large = joins.lookup_join(facts, lookup, ["k"], how, broadcast_rows=0)
    assert small.columns == large.columns
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    scans = large._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3000")
    assert scans == 1


def test_a_row_salt_spreads_hot_and_missing_keys(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).alias("k"), "id")
    salted = df.withColumn("salt", skew.row_salt(df, ["k"], 16))
    assert salted.where("k = 7").agg(F.min("salt"), F.max("salt")).first() == (0, 15)
    missing = salted.where("k is null").agg(F.max("salt"), F.countDistinct("salt")).first()
    assert missing[0] < 0 and missing[1] > 1900


def test_a_hot_ticker_with_a_short_history_is_counted_first(spark):
    # One date, so no profile, but all rows of the ticker would meet in one window.
    hot = spark.range(3000).select(
        F.lit("A").alias("client_name"),
        F.lit("F").alias("fund_id"),
        F.lit("hot").alias("ticker"),
        F.to_date(F.lit("2024-01-02")).alias("nav_date"),
        (F.col("id") % 5).cast("int").alias("sec"),
    )
    df = fx.skewed(spark, MIDDLE).select(*hot.columns)
    both = df.unionByName(hot)
    weighted = skew.weighted_rows(both, ["ticker"])
    assert weighted.where("ticker = 'hot'").agg(F.count("*"), F.sum("n")).first() == (5, 3000)
    known = cohorts.entity_map(df)
    assert rows(profiles.ticker_profile(both, known)) == rows(profiles.ticker_profile(df, known))


def test_lookup_join_measures_before_it_broadcasts(spark):
    df = spark.range(100).withColumn("name", F.lit("x" * 100))
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, rows=99)
    assert not joins.fits_broadcast(df, size=10_000)


# Profiles


def test_cutoff_itself_is_no_miss(arrivals):
    df = arrivals(
        [
            ("C", "F", "T", 1, "18:05:00"),
            ("C", "F", "T", 2, "18:05:01"),
            ("C", "F", "T", 2, "18:04:59"),
            ("C", "F", "T", 2, "18:30:00"),
        ]
    )
    assert rows(profiles.sla_stats(df)) == [("F", 2, 1, sec("18:04:59"), sec("18:30:00"))]


def test_profile_without_an_early_arrival(arrivals):
    df = arrivals([("C", "F", "T", d, "18:30:00") for d in (1, 2)])
    found = profiles.profile_report(profiles.arrival_profile_short(df)).first().asDict()
    assert found["max_time_before_cutoff"] is None
    assert found["predicted_time"] == "18:30:00" and found["miss_days"] == 2


def test_numbered_clients_give_the_same_profile(spark):
    df = fx.skewed(spark, MIDDLE)
    keys = cohorts.client_keys(df)
    known = cohorts.with_client_identifier(df, keys)
    text = cohorts.dedupe_arrivals(known, client="client_identifier")
    assert "SortAggregate" not in text._jdf.queryExecution().executedPlan().toString()
    numbered = profiles.arrival_profile_long(known, client="client_identifier")
    named = profiles.arrival_profile_long(df)
    back = numbered.join(keys, "client_identifier").select(*named.columns)
    assert rows(back) == rows(named)


def test_quantiles_rise_with_rank(spark):
    found = profiles.arrival_profile_long(fx.skewed(spark, MIDDLE))
    names = ["quantile01", "quantile05", "predicted_time", "quantile80", "quantile95", "quantile99"]
    falls = F.lit(False)
    for low, high in zip(names, names[1:], strict=False):
        falls = falls | (F.col(low) > F.col(high))
    assert found.where(falls).count() == 0
    assert found.where(F.col("alert_time") != F.col("max_time_before_cutoff") - 300).count() == 0


# Roll-ups


def profile_of(spark, data):
    return spark.createDataFrame(
        data,
        "client_name string, fund_id string, ticker string, predicted_time int, "
        "quantile01 int, quantile99 int",
    )


def test_ties_at_the_top_stay(spark):
    profile = profile_of(
        spark,
        [
            ("C", "F1", "a", 100, 1, 200),
            ("C", "F1", "b", 100, 1, 200),
            ("C", "F1", "c", 100, 2, 200),
            ("C", "F1", "d", 90, 1, 200),
            ("C", "F2", "e", 100, 1, 300),
            ("C", "F3", "f", None, 1, 300),
        ],
    )
    funds = rollup.tickers_to_funds(profile)
    assert rows(funds) == [
        ("C", "F1", 100, 1, 200),
        ("C", "F1", 100, 2, 200),
        ("C", "F2", 100, 1, 300),
    ]
    clients = rollup.funds_to_clients(funds)
    assert clients.columns == [
        "client_name",
        "predicted_time",
        "client_min_time",
        "client_max_time",
    ]
    assert clients.count() == 3


def test_fund_rollup_by_time_and_by_fund(spark):
    profile = profile_of(
        spark, [("C", f, "t", p, 1, 9) for f, p in (("F2", 5), ("F1", 5), ("F3", 6), ("F3", 4))]
    )
    kept = dict(drop=["ticker"])
    by_time = rollup.fund_rollup(profile, dedupe="time", **kept)
    assert rows(by_time.select("fund_id", "predicted_time")) == [("F1", 5), ("F3", 6)]
    by_fund = rollup.fund_rollup(profile, dedupe="fund", **kept)
    assert rows(by_fund.select("fund_id")) == [("F1",), ("F2",), ("F3",)]
    with pytest.raises(ValueError):
        rollup.fund_rollup(profile, dedupe="client")


def test_combine_reports_drops_incomplete_rows_first(spark):
    full = spark.createDataFrame([("a", 1), ("b", None)], "ticker string, early int")
    short = spark.createDataFrame([("c",), (None,)], "ticker string")
    found = rollup.combine_reports(full, full.where("ticker = 'b'"), short, ["ticker", "early"])
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 1), ("c", None)]


# Volume


def test_five_minute_curve_edges(spark):
    data = [("16:00:00", "15:58:30"), ("16:04:59", "17:00:00"), ("19:00:00", "19:00:01")]
    profile = spark.createDataFrame([(sec(a), sec(b)) for a, b in data], "one int, two int")
    curve = curves.volume_curve_5min(profile, ["one", "two"]).orderBy("time")
    keep = [tuple(row) for row in curve.collect()]
    assert len(keep) == 37
    assert keep[0] == ("16:00:00", 2, 0) and keep[12] == ("17:00:00", 2, 1)
    assert keep[-1] == ("19:00:00", 3, 1)
    zero = curves.volume_curve_5min(profile, ["one", "two"], edge="zero").orderBy("time").collect()
    assert tuple(zero[-1]) == ("19:00:00", 0, 1)


def test_one_minute_curve_rounds_up_and_folds(spark):
    data = [("C", "15:59:00", "16:00:01"), ("C", "16:00:00", "19:00:01"), ("D", "15:58:00", "19:30:00")]
    profile = spark.createDataFrame(
        [(n, sec(a), sec(b)) for n, a, b in data], "client_name string, predicted_time int, late int"
    )
    curve = curves.volume_curve_1min(profile, "late")
    assert curve.count() == 2 * 181
    found = {(r[0], r[1]): (r[2], r[3]) for r in curve.collect()}
    assert found[("C", "16:00:00")] == (2, 0) and found[("C", "16:01:00")] == (2, 1)
    assert found[("C", "19:00:00")] == (2, 1) and found[("D", "19:00:00")] == (0, 0)


def test_bin_history_is_dense(spark, arrivals):
    df = arrivals(
        [
            ("C", "F", "T", 1, "16:00:00"),
            ("C", "F", "T", 1, "16:04:59"),
            ("C", "F", "T", 1, "19:00:00"),
            ("C", "F", "T", 1, "19:00:01"),
            ("C", "F", "T", 1, "15:59:59"),
            ("C", "F", "T", 6, "16:00:00"),
            ("D", "F", "T", 2, "20:00:00"),
        ]
    )
    found = history.bin_history(df)
    assert found.count() == 37
    ends = rows(found.where("bin in (1, 37)").select("bin", "bin_label", "n", "cumsum", "share"))
    assert ends == [(1, 961, 2, 2, 0.6667), (37, 1141, 1, 3, 1.0)]
    folded = history.bin_history(df, fold_out_of_range=True)
    assert folded.where("client_name = 'C' and bin = 37").first()["cumsum"] == 5
    assert folded.where("client_name = 'D' and bin = 25").first()["n"] == 1


def test_running_totals_never_fall_and_shares_end_at_one(spark):
    found = history.bin_history(fx.dense(spark, MIDDLE))
    assert found.where("n < 0").count() == 0
    assert found.where("bin = 37 and share <> 1").count() == 0
    pairs = fx.dense(spark, MIDDLE).where("weekday(nav_date) <= 4").select("client_name", "nav_date")
    assert found.count() == pairs.distinct().count() * 37


# Forecast, quality, alerts


def days(spark, volumes):
    """A history with the given final totals, one Monday each, all arriving in bin 1."""
    data = []
    for week, volume in enumerate(volumes):
        date = dt.date(2024, 1, 1) + dt.timedelta(weeks=week)
        for b in range(1, 38):
            data.append(("C", date, 0, b, 956 + 5 * b, volume if b == 1 else 0, volume, 1.0))
    return spark.createDataFrame(
        data,
        "client_name string, nav_date date, weekday int, bin int, bin_label int, "
        "n long, cumsum long, share double",
    )


def test_forecast_by_window_equals_forecast_by_join(spark):
    found = history.bin_history(fx.dense(spark, MIDDLE))
    beside = forecast.with_forecast(found)
    joined = forecast.join_forecast(found, forecast.bin_forecast(found)).select(*beside.columns)
    assert beside.exceptAll(joined).count() == 0 and joined.exceptAll(beside).count() == 0


def test_median_volume_and_rounding(spark):
    found = forecast.bin_forecast(days(spark, [2, 3])).first()
    # The median of 2 and 3 is 2.5, and a half rounds up.
    assert found["day_volume"] == 2.5 and found["predicted"] == 3.0


def test_control_limits(spark):
    found = quality.xmr_limits(days(spark, [10, 12, 11, 30])).where("bin = 1")
    values = found.orderBy("nav_date").select("moving_range", "centre", "range_centre", "is_outlier")
    # Medians 11.5 and 1.5 are rounded up; limits are 12 ± 2.66 * 2.
    assert [tuple(row) for row in values.collect()] == [
        (0, 12, 2, 0),
        (2, 12, 2, 0),
        (1, 12, 2, 0),
        (19, 12, 2, 1),
    ]


def test_moving_average_waits_for_its_width(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(1, 6)], "k string, o int, v double")
    found = quality.moving_average(df, ["k"], "o", "v", 3).orderBy("o").collect()
    assert [row["moving_average"] for row in found] == [None, None, 2.0, 3.0, 4.0]


def test_alert_order_and_missing_labels(spark):
    schema = (
        "client_name string, weekday int, n int, cumsum int, predicted int, "
        "red_1 int, red_5 int, red_10 int, red_20 int"
    )
    levels = (10, 2, 4, 6, 8)
    df = spark.createDataFrame([("C", 0, 1, v, *levels) for v in (10, 9, 8, 7, 5, 3, 1)], schema)
    labelled = alerts.with_alerts(df)
    assert [r["alert"] for r in labelled.orderBy(F.desc("cumsum")).collect()] == [
        "GREEN",
        "AMBER",
        "AMBER",
        "RED_20",
        "RED_10",
        "RED_5",
        "RED_1",
    ]
    assert rows(alerts.alert_summary(labelled)) == [("C", 0, 1, 2, 1, 2, 3, 4, 7, 0.07)]
    only_green = alerts.with_alerts(df.where("cumsum = 10"))
    assert rows(alerts.alert_summary(only_green)) == [("C", 0, 1, 0, 0, 0, 0, 0, 1, 0.01)]
    assert rows(alerts.alert_pivot(only_green)) == [("C", 0, 1, 0, 0, 0, 0, 0)]


def test_each_row_has_one_alert(spark):
    labelled = alerts.with_alerts(quality.training_error(history.bin_history(fx.dense(spark, MIDDLE))))
    assert labelled.where("alert is null").count() == 0


# Validation


def test_residuals_keep_unpredicted_arrivals(spark, arrivals):
    actual = arrivals(
        [("C", "F", "a", 1, "16:00:00"), ("C", "F", "a", 1, "16:00:00"), ("C", "F", "b", 1, "16:00:00")]
    )
    predictions = spark.createDataFrame(
        [("C", "F", "a", 1, sec("16:14:24"), 3, 4)],
        "client_name string, fund_id string, ticker string, quantile01 int, predicted_time int, "
        "alert_time int, quantile99 int",
    )
    found = residuals.prediction_residuals(actual, predictions, actual.where("ticker = 'b'"))
    assert found.count() == 3
    assert found.where("ticker = 'b' and outlier = 'Outlier' and diff_sec is null").count() == 1
    assert rows(residuals.mae_overall(found)) == [(0.01, 0.01)]
    assert rows(residuals.signed_errors(found.where("ticker = 'a'"), "fund_id")) == [
        ("F", None, 0, 0.01, 1, 0.01)
    ]
    report = residuals.ticker_report(found.where("ticker = 'a'")).first()
    assert report["mae"] == 0.01 and report["client_name"] == "C"


# Reading and publishing


def test_month_overwrite_leaves_other_months(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "202401"), (2, "202402")], "v int, yyyymm string")
    new = spark.createDataFrame([(3, "202402")], "v int, yyyymm string")
    sinks.overwrite_months(old, path)
    sinks.overwrite_months(new, path)
    back = spark.read.schema("v int, yyyymm string").parquet(path)
    assert rows(back) == [(1, "202401"), (3, "202402")]
    month = tables.read_partition(back, "202402")
    text = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in text


def test_a_month_can_become_empty(spark, arrivals, tmp_path):
    df = arrivals([("C", "F", "T", 1, "16:00:00")])
    stages = Stages(str(tmp_path), df)
    assert stages.month == "202401"
    assert stages.publish("t", df).count() == 1
    assert stages.publish("t", df.where("sec < 0")).count() == 0
    assert spark.read.parquet(str(tmp_path / "t")).columns[-1] == "yyyymm"
    with pytest.raises(ValueError):
        Stages(str(tmp_path), df.where("sec < 0"))


def test_date_range_reaches_the_scan(spark, arrivals, tmp_path):
    path = str(tmp_path / "arrivals")
    arrivals([("C", "F", "T", day, "16:00:00") for day in range(1, 20)]).write.parquet(path)
    kept = feed.date_range(tables.read_files(spark, path, ["fund_id", "nav_date"]), "2024-01-05", "2024-01-06")
    assert kept.count() == 2
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(nav_date,2024-01-05)" in text
    assert "ReadSchema: struct<fund_id:string,nav_date:date>" in text


def test_catalog_table_months(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS duskline_test LOCATION '{tmp_path}/db'")
    old = spark.createDataFrame([(1, "202401"), (2, "202402")], "v int, yyyymm string")
    sinks.overwrite_table_months(old, "duskline_test.months")
    sinks.overwrite_table_months(old.where("v = 2").withColumn("v", F.lit(5)), "duskline_test.months")
    back = tables.read_table(spark, "duskline_test.months", ["v", "yyyymm"])
    assert rows(back) == [(1, "202401"), (5, "202402")]
    spark.sql("DROP DATABASE duskline_test CASCADE")


def test_bin_dimension_from_csv(spark, tmp_path):
    path = str(tmp_path / "bins")
    axis = tables.bin_axis(spark)
    named = axis.select(F.col("bin_label").alias("Bin"), F.col("time_bin").alias("Time_Bin"))
    sinks.publish_report(named, path, "csv")
    back = tables.read_time_bins(spark, path)
    assert rows(back) == rows(axis.select("bin_label", "time_bin"))


def test_volume_totals_keep_every_time(spark):
    curve = spark.range(300).selectExpr("'a' as client_name", "cast(id as string) as time", "id as volume_x")
    assert curves.volume_totals(curve).count() == 300
