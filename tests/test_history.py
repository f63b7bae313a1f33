"""The counted history, gaps, feeds, residuals of funds, daily state, and stored deliveries."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter

import pytest
from conftest import SMALL, sec
from pyspark.sql import functions as F

from duskline.operators import cohorts, counted, daily, outliers, profiles, residuals
from duskline.operators.history import bin_history
from duskline.plans.arrival_quantiles import learn_arrival_quantiles
from duskline.plans.deliveries import store_deliveries
from duskline.plans.ticker_chain import learn_tickers
from duskline.plans.volume_forecast import train_volume_forecast
from duskline.sources import arrivals as feed
from duskline.sources import sinks, tables
from registry import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return Counter(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def counting(spark, df):
    """The table, and the number of its rows that have been read so far."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    # Not deterministic, so that no part of it is dropped or merged.
    return df.where(seen.asNondeterministic()(F.col("fund_id"))), lambda: read.value


# Counted history


@pytest.fixture(scope="module")
def by_fund(spark, tmp_path_factory):
    rows = fx.sparse(spark, SMALL).drop("ticker")
    names = sinks.settle(cohorts.client_keys(rows))
    history = counted.counted_history(cohorts.numbered_clients(rows, names))
    return sinks.publish_keyed(history, str(tmp_path_factory.mktemp("fund") / "history"), "fund_id")


def test_counted_again_is_the_same(spark, arrivals):
    rows = [("A", "F", "T", 3, "17:00:00")] * 5 + [("A", "F", "T", 4, "17:00:00"), (None, "F", None, 4, "17:00:01")]
    once = counted.counted_history(arrivals(rows))
    assert {r.n for r in once.collect()} == {5, 1}
    assert rows_of(counted.counted_history(once)) == rows_of(once)
    assert once.agg(F.sum("n")).first()[0] == len(rows)


@pytest.mark.parametrize(
    "made",
    [
        lambda h: profiles.arrival_profile_short(h, client="client_identifier"),
        lambda h: profiles.arrival_profile_long(h, client="client_identifier"),
        lambda h: profiles.sla_stats(h),
        lambda h: outliers.history_outliers(h, ["fund_id"]),
        lambda h: outliers.outlier_counts(h, "fund_id"),
        lambda h: cohorts.dedupe_arrivals(h, client="client_identifier"),
    ],
)
def test_laid_out_history_is_not_shuffled_or_sorted_by_name(spark, by_fund, made):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(made(by_fund))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and "SortAggregate" not in text
    assert "Bucketed: true" in text


def test_laid_out_history_reads_back_by_path(spark, by_fund):
    location = re.search(r"file:(\S+?)[\],]", plan(by_fund))
    assert by_fund.count() > 0 and location
    again = spark.read.schema(by_fund.schema).parquet(location[1].rstrip("]"))
    assert rows_of(again) == rows_of(by_fund)


def test_publishing_a_history_again_replaces_it(spark, arrivals, tmp_path):
    for rows in ([("A", "F", "T", 3, "17:00:00")], [("B", "G", "T", 4, "17:00:00")] * 2):
        made = sinks.publish_keyed(counted.counted_history(arrivals(rows)), str(tmp_path / "h"), "fund_id")
        assert [(r.client_name, r.n) for r in made.collect()] == [(rows[0][0], len(rows))]


@pytest.mark.parametrize("job", [learn_tickers, learn_arrival_quantiles])
def test_jobs_read_the_arrivals_three_times(spark, tmp_path, job):
    rows, read = counting(spark, fx.skewed(spark, SMALL))
    job(rows, str(tmp_path))
    assert read() <= 3 * 1000


# Gaps


def test_every_pair_is_in_a_profile_or_a_gap(spark, arrivals, tmp_path):
    times = ["16:50:00", "16:58:00", "17:01:00", "17:03:00", "17:05:00", "17:10:00", "17:12:00"]
    rows = [("A", "steady", "T", day, "17:00:00") for day in range(2, 12)]
    rows += [("B", "wide", "T", day, t) for day, t in enumerate(times, 2)]
    rows += [("C", "wide", "T", day, t) for day, t in enumerate(times, 2)]
    rows += [("A", "new", "T", day, t) for day, t in enumerate(times[:3], 2)]
    rows += [(None, "nobody", "T", 2, "17:00:00")]
    made = learn_arrival_quantiles(arrivals(rows), str(tmp_path))

    def pairs(name):
        return {(r.client_name, r.fund_id) for r in made[name].collect()}

    assert pairs("profile_short") >= {("A", "new")} and pairs("profile_long") == {("B", "wide")}
    gaps = {(r.client_name, r.fund_id): (r.reason, r.total_days, r.n_arrivals) for r in made["profile_gaps"].collect()}
    assert gaps[("A", "steady")] == ("on_fences", 10, 10)
    assert gaps[("C", "wide")] == ("other_client", 7, 7)
    assert gaps[(None, "nobody")] == ("incomplete", 1, 1)
    everyone = {(client, fund) for client, fund, *_ in rows}
    assert pairs("profile_short") | pairs("profile_long") | set(gaps) == everyone


def test_gaps_of_the_uneven_fixture(spark):
    rows = fx.uneven(spark, SMALL)
    gaps = counted.profile_gaps(rows)
    assert {r.reason for r in gaps.select("reason").distinct().collect()} == {"on_fences", "other_client", "incomplete"}
    pair = ["client_name", "fund_id"]
    parts = [p.select(*pair) for p in (gaps, profiles.arrival_profile_short(rows), profiles.arrival_profile_long(rows))]
    named = [p.where("client_name IS NOT NULL") for p in parts]
    whole = rows.where("client_name IS NOT NULL").select(*pair).distinct()
    assert rows_of(named[0].union(named[1]).union(named[2])) == rows_of(whole)
    assert counted.profile_gaps(rows.limit(0)).count() == 0


# Feeds


def test_two_feeds_in_one_run_are_two_runs(spark, tmp_path):
    both = fx.two_feeds(spark, SMALL).drop("ticker")
    together = learn_arrival_quantiles(both, str(tmp_path / "both"))
    for name in ("even", "skewed"):
        alone = learn_arrival_quantiles(both.where(F.col("feed") == name).drop("feed"), str(tmp_path / name))
        for table, df in alone.items():
            # Clients are numbered over all feeds, so the names are compared.
            if table not in ("history", "outliers", "client_names"):
                part = together[table].where(F.col("feed") == name).drop("feed")
                assert rows_of(part) == rows_of(df), table
    text = plan(together["residuals"].where("feed = 'even'"))
    assert re.search(r"PartitionFilters: \[[^\]]*feed", text)


# Residuals


def test_counted_residuals_by_hand(spark, arrivals):
    actual = arrivals(
        [("A", "F", "T", 2, "17:00:00")] * 3
        + [("A", "F", "T", 2, "18:30:00"), ("A", "G", "U", 3, "17:00:00"), ("A", None, "V", 3, "17:00:00")]
    )
    marks = arrivals([("A", "F", "T", 2, "18:30:00"), ("A", "F", "T", 9, "18:30:00"), ("A", None, "V", 3, "17:00:00")])
    at = sec("17:10:00")
    known = spark.createDataFrame(
        [("A", "F", at, at, at, at), ("A", "F", at, at, at, at), ("B", "F", at, at + 60, at, at)],
        "client_name string, fund_id string, quantile01 int, predicted_time int, alert_time int, quantile99 int",
    )
    found = residuals.counted_residuals(actual, known, marks, entity=["fund_id"])
    got = sorted((r.fund_id or "", r.sec, r.outlier, r.client_name or "", r.diff_sec or 0, r.n) for r in found.collect())
    noon, late = sec("17:00:00"), sec("18:30:00")
    assert got == [
        ("", noon, "NotOutlier", "", 0, 1),
        ("F", noon, "NotOutlier", "A", 600, 6),
        ("F", noon, "NotOutlier", "B", 660, 3),
        ("F", late, "Outlier", "A", -4800, 2),
        ("F", late, "Outlier", "B", -4740, 1),
        ("G", noon, "NotOutlier", "", 0, 1),
    ]
    overall = residuals.mae_overall(found).first()
    assert overall.mae_inliers == pytest.approx((6 * 600 + 3 * 660) / 9 / 86400)
    assert overall.mae == pytest.approx((6 * 600 + 3 * 660 + 2 * 4800 + 4740) / 12 / 86400)
    signs = {r.fund_id: r for r in residuals.signed_errors(found, "fund_id").collect()}
    assert (signs["F"].negative_count, signs["F"].positive_count, signs["G"].mae) == (2, 2, None)
    assert residuals.prediction_residuals(actual, known, marks, entity=["fund_id"]).count() == 14


def test_residuals_run_no_job_while_they_are_built(spark):
    # A table that cannot be read: building on it must not touch it.
    broken = fx.skewed(spark, SMALL).withColumn("sec", F.raise_error(F.lit("read")).cast("int"))
    known = spark.createDataFrame(
        [], "ticker string, fund_id string, client_name string, quantile01 int, predicted_time int, alert_time int, quantile99 int"
    )
    made = residuals.counted_residuals(broken, known, broken)
    assert len(re.findall(r"Exchange hashpartitioning\((?:ticker|fund_id)[^)]*nav_date", plan(made))) == 1


def test_fund_job_validates_on_later_arrivals(spark, tmp_path):
    rows = fx.skewed(spark, SMALL).drop("ticker")
    early, later = rows.where("nav_date < DATE '2024-01-20'"), rows.where("nav_date >= DATE '2024-01-20'")
    made = learn_arrival_quantiles(early, str(tmp_path), actual=later)
    assert made["residuals"].agg(F.sum("n")).first()[0] == later.count()
    assert 0 < made["error_overall"].first()["mae"] < 1
    assert made["fund_error_report"].count() == made["profile_long"].count() > 0


def test_ticker_job_publishes_short_funds(spark, tmp_path):
    rows = fx.sparse(spark, SMALL)
    made = learn_tickers(rows, str(tmp_path))
    assert made["fund_bins_short"].columns == [
        "time",
        "volume_fund_min_time",
        "volume_predicted_time",
        "volume_max_time_before_cutoff",
        "volume_fund_max_time",
    ]
    last = made["fund_bins_short"].where("time = '19:00:00'").first()
    assert last["volume_predicted_time"] == made["funds_short"].count() > 0


# Days


def test_days_are_added_replaced_and_emptied(spark, arrivals, tmp_path):
    path = str(tmp_path / "state")
    rows = [("A", "F", "T", 2, "17:00:00"), ("B", "F", "T", 2, "20:00:00"), ("A", "F", "T", 3, "18:30:00"), ("A", "F", "T", 6, "17:00:00")]
    daily.write_state(daily.day_state(arrivals(rows)), path)
    found = daily.history_from_state(daily.read_state(spark, path))
    assert rows_of(found) == rows_of(bin_history(arrivals(rows)))
    rows += [("A", "F", "T", 4, "17:00:00"), ("A", "F", "T", 3, "17:01:00")]
    for day in (3, 4):
        daily.add_day(arrivals(rows), path, dt.date(2024, 1, day))
    state = daily.read_state(spark, path)
    assert rows_of(daily.history_from_state(state)) == rows_of(bin_history(arrivals(rows)))
    wanted = profiles.sla_stats(arrivals(rows), entity="client_name")
    assert rows_of(daily.stats_from_state(state).drop("n_rows")) == rows_of(wanted)
    daily.add_day(arrivals(rows).where("client_name = 'C'"), path, "2024-01-03")
    kept = [r for r in rows if r[3] != 3]
    assert rows_of(daily.history_from_state(daily.read_state(spark, path))) == rows_of(bin_history(arrivals(kept)))


def test_a_counted_day_is_the_same_state(spark):
    rows = fx.dense(spark, SMALL)
    assert rows_of(daily.day_state(counted.counted_history(rows))) == rows_of(daily.day_state(rows))


def test_a_day_reads_its_own_files(spark, tmp_path):
    rows = fx.dense(spark, SMALL)
    sinks.publish_arrivals(rows, str(tmp_path), by_day=True)
    stored = tables.read_arrivals(spark, str(tmp_path), rows.schema)
    assert rows_of(stored.drop("yyyymm")) == rows_of(rows)
    day = daily.date_range(stored, "2024-01-16", "2024-01-16")
    assert re.search(r"PartitionFilters: \[[^\]]*nav_date", plan(daily.day_state(day)))
    folders = {r.file.split("/")[-2] for r in day.select(F.input_file_name().alias("file")).distinct().collect()}
    assert folders == {"nav_date=2024-01-16"}


# Deliveries


RAW = "nav_date string, fund_id string, client_name string, datetime string, date_identifier string"


def _delivery(date="3/11/2018", time="3/11/18 02:30", client="A"):
    return (date, " F 1 ", client, time, "x")


def test_times_do_not_depend_on_the_session_zone(spark):
    # 02:30 does not exist in New York on that day, nor midnight in Sao Paulo on 4 November.
    rows = [_delivery(), _delivery("11/4/2018", "11/4/18 00:10"), _delivery("1/2/2018", "01/02/18 16:05")]
    raw = spark.createDataFrame(rows, RAW)
    wanted = [
        (dt.date(2018, 1, 2), dt.datetime(2018, 1, 2, 16, 5), sec("16:05:00")),
        (dt.date(2018, 3, 11), dt.datetime(2018, 3, 11, 2, 30), sec("02:30:00")),
        (dt.date(2018, 11, 4), dt.datetime(2018, 11, 4, 0, 10), sec("00:10:00")),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "America/Sao_Paulo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for made in (feed.normalize_arrivals(raw), feed.observed_arrivals(raw)[0]):
                assert sorted((r.nav_date, r.arrival_ts, r.sec) for r in made.collect()) == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


BAD = [
    _delivery("2/30/2018"),
    _delivery("2018-03-11"),
    _delivery("13/1/2018"),
    _delivery("3/11/18"),
    _delivery(" 3/11/2018"),
    _delivery(time="3/11/18 24:00"),
    _delivery(time="3/11/18 2:30"),
    _delivery(time="3/11/2018 02:30"),
    _delivery(time="2/29/18 02:30"),
    _delivery(time=""),
    _delivery(client=None),
]


def test_what_no_real_time_names_is_rejected(spark):
    raw = spark.createDataFrame([*BAD, _delivery(), _delivery("2/29/2020", "2/29/20 16:00")], RAW)
    found = feed.rejected_rows(raw)
    assert rows_of(found.drop("reason")) == rows_of(spark.createDataFrame(BAD, RAW))
    reasons = Counter(r.reason for r in found.collect())
    assert reasons == {"bad_date": 5, "bad_time": 5, "incomplete": 1}
    assert feed.normalize_arrivals(raw).count() == 2
    audit = feed.normalization_audit(raw).first().asDict()
    assert audit == {"rows_read": 13, "rows_incomplete": 1, "rows_bad_date": 5, "rows_bad_time": 5, "rows_kept": 2}


def test_a_pattern_is_letters_and_separators(spark):
    one = spark.range(1).select(F.lit("2018.04.09").alias("d"), F.lit("9-4-2018 7:05:09").alias("t"))
    made = one.select(feed.parse_date("d", "yyyy.M.d"), feed.parse_timestamp("t", "d-M-yyyy H:mm:ss"))
    assert tuple(made.first()) == (dt.date(2018, 4, 9), dt.datetime(2018, 4, 9, 7, 5, 9))
    assert one.select(feed.parse_date("t", "yyyy.M.d")).first()[0] is None
    with pytest.raises(ValueError):
        feed.parse_date("d", "EEE d")


def test_stored_deliveries(spark, tmp_path):
    raw = fx.as_text(fx.dense(spark, SMALL)).withColumn("feed", F.lit("even"))
    delivered, read = counting(spark, raw)
    made = store_deliveries(delivered, str(tmp_path))
    assert read() == 2 * raw.count()
    kept = feed.normalize_arrivals(raw)
    assert rows_of(made["arrivals"].drop("yyyymm")) == rows_of(kept) and "feed" in kept.columns
    assert rows_of(made["drops"]) == rows_of(feed.normalization_audit(raw))
    assert made["rejected"].count() + made["arrivals"].count() == raw.count()


def test_a_month_of_the_store_is_read_alone(spark, tmp_path):
    rows = fx.sparse(spark, SMALL)
    sinks.publish_arrivals(rows, str(tmp_path))
    stored = tables.read_arrivals(spark, str(tmp_path), rows.schema)
    active = cohorts.active_entities(stored, month="1998-04-15")
    assert re.search(r"PartitionFilters: \[[^\]]*yyyymm[^\]]*199804", plan(active))
    assert rows_of(active) == rows_of(cohorts.active_entities(rows, month="1998-04-15"))
    latest = cohorts.active_entities(stored)
    assert re.search(r"PartitionFilters: \[[^\]]*yyyymm", plan(latest))
    assert rows_of(latest) == rows_of(cohorts.active_entities(rows))
    # A month that comes again replaces its own partition.
    again = rows.where("date_trunc('month', nav_date) = DATE '1998-04-01'").limit(3)
    sinks.publish_arrivals(again, str(tmp_path))
    months = tables.read_arrivals(spark, str(tmp_path), rows.schema).groupBy("yyyymm").count()
    held = {r.yyyymm: r["count"] for r in months.collect()}
    assert held["199804"] == 3 and sum(held.values()) > 1000


# Client keys


def test_client_numbers_last(spark, arrivals):
    first = cohorts.client_keys(arrivals([("D", "F", "T", 2, "17:00:00"), ("B", "F", "T", 2, "17:00:00")]))
    later = arrivals([(c, "F", "T", 3, "17:00:00") for c in ("E", "B", "A", None, "C", "A")])
    merged = {r.client_name: r.client_identifier for r in cohorts.merge_client_keys(first, later).collect()}
    assert merged == {"B": 1, "D": 2, "A": 3, "C": 4, "E": 5}
    nothing = first.limit(0)
    assert {r.client_identifier for r in cohorts.merge_client_keys(nothing, later).collect()} == {1, 2, 3, 4}


def test_forecast_job_keeps_numbers(spark, tmp_path):
    rows = fx.dense(spark, SMALL)
    old = spark.createDataFrame([(7, "C1"), (9, "gone")], "client_identifier int, client_name string")
    made = train_volume_forecast(rows, tables.bin_axis(spark), str(tmp_path), clients=old, merge_clients=True)
    numbers = {r.client_name: r.client_identifier for r in made["clients"].collect()}
    assert numbers == {"C1": 7, "gone": 9, "C0": 10}
    assert {r.client_identifier for r in made["forecast"].select("client_identifier").distinct().collect()} == {7, 10}


def test_a_month_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_BYTES", "1m", raising=False)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    rows = spark.range(0, 100_000, 1, 1).select(
        F.sha2(F.col("id").cast("string"), 256).alias("client_name"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 31).cast("int")).alias("nav_date"),
        (F.col("id") % 3600).cast("int").alias("sec"),
    )
    sinks.publish_arrivals(rows, str(tmp_path))
    assert len(list((tmp_path / "yyyymm=202401").glob("*.parquet"))) > 1
    stored = tables.read_arrivals(spark, str(tmp_path), rows.schema).drop("yyyymm")
    assert stored.exceptAll(rows).isEmpty() and rows.exceptAll(stored).isEmpty()
    assert spark.conf.get(size, None) == before
