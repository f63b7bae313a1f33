"""The feed with tickers: profiles, roll-ups, curves, and validation on later arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duskline import constants as c
from duskline.operators.cohorts import client_keys, entity_map, named_clients, numbered_clients
from duskline.operators.counted import counted_history
from duskline.operators.curves import volume_curve_5min
from duskline.operators.outliers import history_outliers, outlier_counts, outlier_times
from duskline.operators.profiles import profile_report, ticker_profile, ticker_profile_short
from duskline.operators.residuals import (
    client_fund_errors,
    counted_residuals,
    mae_by,
    mae_overall,
    signed_errors,
    ticker_report,
)
from duskline.operators.rollup import funds_to_clients, tickers_to_funds
from duskline.plans.stages import Stages

TICKER_TIMES = [*c.LONG_RANKS, "alert_time", "max_time"]
SHORT_TIMES = [*c.SHORT_RANKS, "max_time_before_cutoff", "max_time"]
FUND_NAMES = {"quantile01": "fund_min_time", "quantile99": "fund_max_time"}
SHORT_FUND_NAMES = {"quantile01": "fund_min_time", "max_time": "fund_max_time"}
KEY = "client_identifier"


def learn_tickers(
    arrivals: DataFrame, folder: str, *, actual: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Normalised ticker arrivals in; profiles, roll-ups, curves and residuals out.

    ``actual`` are the arrivals to validate on; by default those the profile was made from.
    The arrivals are read for the month, for the clients, and for the counted history; all else
    is made from that history, which is laid out by ticker.
    """
    stages = Stages(folder, arrivals)
    publish = stages.publish

    names = publish("client_names", client_keys(arrivals))
    counted = counted_history(numbered_clients(arrivals, names))
    history = stages.publish_history("history", counted, "ticker")

    known = entity_map(history, [KEY, "fund_id", "ticker"])
    entities = publish("entities", named_clients(known, names))
    profile = publish("tickers", ticker_profile(history, entities))
    funds = publish("funds", tickers_to_funds(profile))
    publish("clients", funds_to_clients(funds))
    publish("ticker_report", profile_report(profile))
    publish("ticker_bins", volume_curve_5min(profile, TICKER_TIMES))
    fund_times = [FUND_NAMES.get(name, name) for name in TICKER_TIMES]
    publish("fund_bins", volume_curve_5min(funds, fund_times))

    numbered = ticker_profile_short(history, client=KEY)
    short = publish("tickers_short", named_clients(numbered, names))
    short_funds = publish("funds_short", tickers_to_funds(short, latest="max_time"))
    publish("clients_short", funds_to_clients(short_funds))
    publish("ticker_bins_short", volume_curve_5min(short, SHORT_TIMES))
    fund_times = [SHORT_FUND_NAMES.get(name, name) for name in SHORT_TIMES]
    publish("fund_bins_short", volume_curve_5min(short_funds, fund_times))

    outliers = publish("outliers", history_outliers(history, ["ticker"]))
    publish("outlier_counts", outlier_counts(history, "ticker"))
    publish("outlier_times", outlier_times(outliers))

    rows = history if actual is None else actual
    residuals = publish("residuals", counted_residuals(rows, profile, outliers))
    publish("error_overall", mae_overall(residuals))
    publish("error_by_ticker", mae_by(residuals, "ticker"))
    publish("error_by_fund", mae_by(residuals, "fund_id"))
    publish("error_by_client", mae_by(residuals, "client_name"))
    publish("signed_by_ticker", signed_errors(residuals, "ticker"))
    publish("signed_by_fund", client_fund_errors(residuals, entities))
    publish("ticker_error_report", ticker_report(residuals))
    return stages.tables
