"""History that grows by the day: what one day adds, and what is made of all days.

The state has one row per entity and date. Days add nothing to each other, so a new or repeated
day replaces its own partition and no older arrival is read again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.clock import after_cutoff, before_cutoff, bin_index, in_window
from duskline.operators.history import running_history
from duskline.operators.skew import weight_of
from duskline.sources.arrivals import date_range
from duskline.sources.sinks import overwrite_month, overwrite_months


def day_state(
    arrivals: DataFrame, *, entity: str = "client_name", cutoff: int = c.CUTOFF
) -> DataFrame:
    """Per entity and date: arrivals, their number in each bin of the window, the latest arrival,
    and the latest before the cut-off. One shuffle, combined on the map side."""
    bin_ = F.when(in_window("sec"), bin_index("sec"))
    n = weight_of(arrivals)
    counters = [
        F.sum(F.when(bin_ == i, n).otherwise(0)).cast("long") for i in range(1, c.BIN_COUNT + 1)
    ]
    return arrivals.groupBy(entity, "nav_date").agg(
        F.sum(n).alias("n_rows"),
        F.array(*counters).alias("bins"),
        F.max("sec").alias("latest"),
        F.max(F.when(before_cutoff("sec", cutoff), F.col("sec"))).alias("latest_before"),
    )


def write_state(state: DataFrame, path: str) -> None:
    """Replace the days found in ``state``; all others stay."""
    overwrite_months(state.hint("rebalance", "nav_date"), path, "nav_date")


def add_day(
    arrivals: DataFrame, path: str, day: dt.date | str, *, entity: str = "client_name"
) -> str:
    """Read one day of arrivals and replace its part of the state, also when it has become empty."""
    day = dt.date.fromisoformat(str(day))
    state = day_state(date_range(arrivals, day, day), entity=entity)
    return overwrite_month(state.drop("nav_date"), path, day.isoformat(), "nav_date")


def read_state(spark: SparkSession, path: str, entity: str = "client_name string") -> DataFrame:
    """The days written so far; ``entity`` is the column with its type."""
    fields = "n_rows bigint, bins array<bigint>, latest int, latest_before int, nav_date date"
    return spark.read.schema(f"{entity}, {fields}").parquet(path)


def history_from_state(state: DataFrame, *, entity: str = "client_name") -> DataFrame:
    """The bin history, as ``bin_history`` makes it from arrivals."""
    seen = F.aggregate("bins", F.lit(0).cast("long"), lambda total, n: total + n) > 0
    counts = (
        state.where((F.weekday("nav_date") <= 4) & seen)
        .select(entity, "nav_date", F.posexplode("bins").alias("_at", "n"))
        .select(entity, "nav_date", (F.col("_at") + 1).alias("bin"), "n")
    )
    return running_history(counts, entity=entity)


def stats_from_state(
    state: DataFrame, *, entity: str = "client_name", cutoff: int = c.CUTOFF
) -> DataFrame:
    """Days, missed days, latest arrival before the cut-off, latest arrival, and arrivals."""
    return state.groupBy(entity).agg(
        F.count("nav_date").alias("total_days"),
        F.count_if(after_cutoff("latest", cutoff)).alias("miss_days"),
        F.max("latest_before").alias("max_time_before_cutoff"),
        F.max("latest").alias("max_time"),
        F.sum("n_rows").alias("n_rows"),
    )
