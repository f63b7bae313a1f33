"""Profiles, curves and validation for feeds that have funds but no tickers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from duskline import constants as c
from duskline.operators.cohorts import client_keys, entity_map, named_clients, numbered_clients
from duskline.operators.counted import counted_history, profile_gaps
from duskline.operators.curves import volume_curve_1min, volume_curve_5min, volume_totals
from duskline.operators.outliers import history_outliers
from duskline.operators.profiles import (
    TIME_COLUMNS,
    arrival_profile_long,
    arrival_profile_short,
    profile_report,
)
from duskline.operators.residuals import (
    client_fund_errors,
    counted_residuals,
    fund_report,
    mae_by,
    mae_overall,
    signed_errors,
)
from duskline.operators.rollup import fund_rollup
from duskline.plans.stages import Stages

SHORT_TIMES = [*c.SHORT_RANKS, "max_time_before_cutoff", "max_time"]
RENAMED = {"quantile99": "client_max_time", "quantile01": "client_min_time"}
KEY = "client_identifier"


def learn_arrival_quantiles(
    arrivals: DataFrame,
    folder: str,
    *,
    dedupe: str = "time",
    actual: DataFrame | None = None,
    by: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Normalised arrivals in; published profiles, roll-ups, curves and residuals out.

    ``actual`` are the arrivals to validate on; by default those the profiles were made from.
    Where the arrivals have a column ``feed``, all feeds are learned in one run, each by itself,
    and the tables are partitioned by it. The arrivals are read for the month, for the clients,
    and for the counted history; all else is made from that history, which is laid out by fund.
    """
    by = [name for name in ("feed",) if name in arrivals.columns] if by is None else list(by)
    stages = Stages(folder, arrivals, by)
    publish = stages.publish

    names = publish("client_names", client_keys(arrivals))
    counted = counted_history(numbered_clients(arrivals, names).drop("ticker"))
    history = stages.publish_history("history", counted, "fund_id")

    known = entity_map(history, [*by, KEY, "fund_id"])
    pairs = publish("client_funds", named_clients(known, names))
    numbered = arrival_profile_short(history, client=KEY, by=by)
    short = publish("profile_short", named_clients(numbered, names))
    numbered = arrival_profile_long(history, client=KEY, by=by)
    long = publish("profile_long", named_clients(numbered, names))
    publish("profile_gaps", named_clients(profile_gaps(history, client=KEY, by=by), names))
    publish("report_short", profile_report(short))
    publish("report_long", profile_report(long))

    publish("curve_short", volume_curve_1min(short, "max_time", by=by))
    curve = publish("curve_long", volume_curve_1min(long, "quantile99", by=by))
    publish("curve_long_totals", volume_totals(curve, by=by))
    publish("bins_short", volume_curve_5min(short, SHORT_TIMES, by=by))
    publish("bins_long", volume_curve_5min(long, TIME_COLUMNS, by=by))

    clients = publish("clients_short", fund_rollup(short, dedupe=dedupe, by=by))
    times = ["quantile01", "predicted_time"]
    publish("client_bins_short", volume_curve_5min(clients, times, by=by))
    dropped = ["fund_id", "total_days", "miss_days", "max_time_before_cutoff", "max_time"]
    clients = publish(
        "clients_long", fund_rollup(long, dedupe=dedupe, drop=dropped, rename=RENAMED, by=by)
    )
    times = [RENAMED.get(name, name) for name in c.LONG_RANKS]
    publish("client_bins_long", volume_curve_5min(clients, [*times, "alert_time"], by=by))

    outliers = publish("outliers", history_outliers(history, [*by, "fund_id"]))
    rows = history if actual is None else actual
    residuals = publish(
        "residuals", counted_residuals(rows, long, outliers, entity=["fund_id"], by=by)
    )
    publish("error_overall", mae_overall(residuals, by=by))
    publish("error_by_fund", mae_by(residuals, "fund_id", by=by))
    publish("error_by_client", mae_by(residuals, "client_name", by=by))
    publish("signed_by_fund", signed_errors(residuals, "fund_id", by=by))
    publish("signed_by_client_fund", client_fund_errors(residuals, pairs, by=by))
    publish("fund_error_report", fund_report(residuals, by=by))
    return stages.tables
