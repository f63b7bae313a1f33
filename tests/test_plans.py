"""Physical plans, and the jobs end to end."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from duskline.plans.arrival_quantiles import learn_arrival_quantiles
from duskline.plans.ticker_chain import learn_tickers
from duskline.plans.volume_forecast import train_volume_forecast
from duskline.sources.tables import bin_axis
from registry import fixtures as fx
from registry.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", plan(df)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoopJoin", text)


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [
        ("normalize_arrivals", 0),
        ("active_cohort", 0),
        ("iqr_split", 0),
        ("bin_history", 1),
        ("bin_forecast", 2),
        ("training_error", 2),
        ("alert_summary", 2),
        ("xmr_limits", 2),
        ("quantile_linear", 2),
        ("quantile_nearest", 2),
    ],
)
def test_shuffles_of_the_large_side(spark, name, shuffles):
    df = contract.queries()[name](spark, SMALL)
    # The lookup sides of the cohort queries are settled before; sparse adds no shuffle here.
    assert exchanges(df) <= shuffles


def test_scan_reads_only_what_is_needed(spark):
    text = plan(contract.queries()["bin_history"](spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert "PushedFilters: [IsNotNull(ts)]" in text


def test_volume_forecast_job(spark, tmp_path):
    rows = fx.dense(spark, SMALL)
    tables = train_volume_forecast(rows, bin_axis(spark), str(tmp_path))
    days = rows.where("weekday(nav_date) <= 4").select("client_name", "nav_date").distinct()
    assert tables["bin_history"].count() == days.count() * 37
    assert tables["limits"].count() == 37 * 5
    assert tables["alerts"].agg({"rows_seen": "sum"}).first()[0] == tables["errors"].count()
    before = sorted(tables["forecast"].collect())
    again = train_volume_forecast(rows, bin_axis(spark), str(tmp_path))
    assert sorted(again["forecast"].collect()) == before


def test_arrival_quantiles_job(spark, tmp_path):
    rows = fx.sparse(spark, SMALL)
    tables = learn_arrival_quantiles(rows, str(tmp_path))
    funds = rows.select("fund_id").distinct().count()
    parts = ("profile_short", "profile_long", "profile_gaps")
    assert sum(tables[name].count() for name in parts) == funds
    assert tables["bins_long"].count() == 37
    assert tables["curve_long_totals"].count() == 181
    assert tables["clients_long"].count() > 0


def test_ticker_job(spark, tmp_path):
    rows = fx.skewed(spark, SMALL)
    tables = learn_tickers(rows, str(tmp_path))
    assert tables["tickers"].count() == 15
    assert tables["residuals"].agg({"n": "sum"}).first()[0] == rows.count()
    assert tables["outliers"].agg({"n": "sum"}).first()[0] == 10
    assert tables["clients"].count() >= 2
    assert 0 < tables["error_overall"].first()["mae"] < 1
