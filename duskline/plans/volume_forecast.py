"""Train the volume forecast and publish everything derived from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from duskline.operators.alerts import alert_summary, with_alerts
from duskline.operators.cohorts import (
    active_cohort,
    client_keys,
    merge_client_keys,
    with_client_identifier,
)
from duskline.operators.forecast import (
    bin_forecast,
    end_of_day_volume,
    forecast_totals,
    join_forecast,
    limit_table,
)
from duskline.operators.history import actual_totals, bin_history
from duskline.operators.quality import error_summary, forecast_errors, spread, xmr_limits
from duskline.plans.stages import Stages

KEY = "client_identifier"


def train_volume_forecast(
    arrivals: DataFrame,
    time_bins: DataFrame,
    folder: str,
    *,
    clients: DataFrame | None = None,
    merge_clients: bool = False,
    active_month: dt.date | str | None = None,
    always_include: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Normalised arrivals in, published tables out.

    ``clients`` is a stored client dimension; arrivals of clients that it lacks are left out, or
    with ``merge_clients`` get numbers after the largest, and the merged dimension is published.

    The arrivals are scanned for the clients, for the active funds, and once for the bin
    history. All else is made from the history as written.
    """
    stages = Stages(folder, arrivals)
    tables: dict[str, DataFrame] = {}

    def publish(name: str, df: DataFrame) -> DataFrame:
        tables[name] = stages.publish(name, df)
        return tables[name]

    if clients is None:
        clients = publish("clients", client_keys(arrivals))
    elif merge_clients:
        clients = publish("clients", merge_client_keys(clients, arrivals))
    kept = active_cohort(arrivals, month=active_month, always_include=always_include)
    known = with_client_identifier(kept, clients)
    history = publish("bin_history", bin_history(known, entity=KEY))

    publish("control_limits", xmr_limits(history, entity=KEY))
    publish("spread_by_bin", spread(history, [KEY, "weekday", "bin"]))
    publish("spread_by_weekday", spread(history, [KEY, "weekday"]))
    publish("spread_overall", spread(history, ["weekday"]))
    publish("end_of_day_volume", end_of_day_volume(history, entity=KEY))
    publish("actual_totals", actual_totals(history))

    forecast = publish("forecast", bin_forecast(history, entity=KEY))
    publish("forecast_totals", forecast_totals(forecast))
    publish("limits", limit_table(forecast, time_bins))

    errors = publish("errors", forecast_errors(join_forecast(history, forecast, entity=KEY)))
    publish("client_error", error_summary(errors, [KEY, "weekday"]))
    publish("bin_error", error_summary(errors, [KEY, "weekday", "bin"]))
    publish("bin_error_pct", error_summary(errors, [KEY, "weekday", "bin"], "error_pct"))
    publish("alerts", alert_summary(with_alerts(errors), entity=KEY))
    return tables
