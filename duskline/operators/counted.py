"""The counted history: arrivals as one row per client, entity, date and second, with their number.

Profiles, fences, statistics and outlier counts take it in place of arrivals. Written in buckets of
one key (``sinks.publish_keyed``), it is shuffled once; what is grouped by that key, alone or with
others, then needs no further shuffle. A key has at most one row per second, date and client there,
however many arrivals it had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.percentiles import within_fences
from duskline.operators.cohorts import dedupe_arrivals
from duskline.operators.skew import weight_of, weighted_rows

HISTORY = ["feed", "client_identifier", "client_name", "fund_id", "ticker", "nav_date", "sec"]


def counted_history(arrivals: DataFrame) -> DataFrame:
    """Rows per known column and ``n``, the arrivals behind each; adds up what was counted before."""
    keys = [name for name in HISTORY if name in arrivals.columns]
    return arrivals.groupBy(*keys).agg(F.sum(weight_of(arrivals)).alias("n"))


def profile_gaps(
    history: DataFrame,
    *,
    client: str = "client_name",
    max_short: int = c.SHORT_HISTORY_DAYS,
    k: float = c.OUTLIER_FENCE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Client and fund pairs that are in neither profile, with the reason.

    ``other_client``: every arrival is also one of a client that comes first, who keeps it.
    ``on_fences``: a long history without an arrival strictly inside its fences, such as one that
    always comes at the same second. ``incomplete``: no client, fund or time to speak of.
    """
    pair = [*by, client, "fund_id"]
    days = (
        history.groupBy(*by, "fund_id", "nav_date")
        .agg(F.lit(1).alias("_day"))
        .groupBy(*by, "fund_id")
        .agg(F.count("nav_date").alias("total_days"))
    )
    kept = dedupe_arrivals(history, client=client, by=by)
    rows = weighted_rows(kept, pair)
    inside = within_fences(rows, pair, k).groupBy(*pair).agg(F.sum("n").alias("n_inside"))
    owned = rows.groupBy(*pair).agg(F.sum("n").alias("n_owned"))
    found = (
        history.groupBy(*pair)
        .agg(F.sum(weight_of(history)).alias("n_arrivals"), F.count("sec").alias("_timed"))
        .join(days, [*by, "fund_id"], "left")
        .join(owned, pair, "left")
        .join(inside, pair, "left")
    )
    incomplete = F.col(client).isNull() | F.col("fund_id").isNull() | (F.col("_timed") == 0)
    reason = (
        F.when(incomplete, "incomplete")
        .when(F.col("n_owned").isNull(), "other_client")
        .when((F.col("total_days") > max_short) & F.col("n_inside").isNull(), "on_fences")
    )
    return (
        found.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*pair, "reason", F.coalesce("total_days", F.lit(0)).alias("total_days"), "n_arrivals")
    )
