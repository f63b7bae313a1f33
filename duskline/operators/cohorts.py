"""Which entities take part, who they are, and how they are numbered."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.operators.joins import lookup_join
from duskline.sources.sinks import settle


def _in_month(arrivals: DataFrame, month: dt.date | str | None) -> Column:
    """Dates of one month: the one given by any of its days, or that of the latest date.

    Where arrivals are stored by month, the condition is on that partition column, so the files
    of other months are not read.
    """
    if "yyyymm" in arrivals.columns:
        if month is None:
            return F.col("yyyymm") == arrivals.agg(F.max("yyyymm")).scalar()
        return F.col("yyyymm") == dt.date.fromisoformat(str(month)).strftime("%Y%m")
    if month is None:
        start = arrivals.agg(F.trunc(F.max("nav_date"), "month").alias("start")).scalar()
        return F.trunc("nav_date", "month") == start
    first = dt.date.fromisoformat(str(month)).replace(day=1)
    following = (first + dt.timedelta(days=32)).replace(day=1)
    return (F.col("nav_date") >= F.lit(first)) & (F.col("nav_date") < F.lit(following))


def active_entities(
    arrivals: DataFrame,
    *,
    entity: str = "fund_id",
    month: dt.date | str | None = None,
    always_include: Sequence[str] = (),
) -> DataFrame:
    """Entities with an arrival in the month, plus those named."""
    wanted = _in_month(arrivals, month)
    if always_include:
        wanted = wanted | F.col(entity).isin(list(always_include))
    return arrivals.where(wanted).select(entity).distinct()


def active_cohort(
    arrivals: DataFrame,
    *,
    entity: str = "fund_id",
    month: dt.date | str | None = None,
    always_include: Sequence[str] = (),
) -> DataFrame:
    """The whole history of the active entities; each row once, forced entities included."""
    active = active_entities(arrivals, entity=entity, month=month, always_include=always_include)
    return lookup_join(arrivals, active, [entity], "left_semi")


def inactive_cohort(
    arrivals: DataFrame, *, entity: str = "fund_id", month: dt.date | str | None = None
) -> DataFrame:
    """The history of the entities without an arrival in the month."""
    active = active_entities(arrivals, entity=entity, month=month)
    return lookup_join(arrivals, active, [entity], "left_anti")


def history_length(arrivals: DataFrame, entity: str = "fund_id") -> DataFrame:
    """Distinct dates per entity. Repeats fall away on the map side of the first step."""
    return (
        arrivals.select(entity, "nav_date")
        .distinct()
        .groupBy(entity)
        .agg(F.count("nav_date").alias("n_days"))
    )


def history_split(
    arrivals: DataFrame, *, entity: str = "fund_id", max_short: int = c.SHORT_HISTORY_DAYS
) -> DataFrame:
    """Arrivals with ``cohort``: short up to ``max_short`` distinct dates, else long."""
    cohort = F.when(F.col("n_days") <= max_short, "short").otherwise("long")
    lengths = history_length(arrivals, entity).select(entity, cohort.alias("cohort"))
    return lookup_join(arrivals, lengths, [entity], "inner")


def entity_map(
    arrivals: DataFrame, columns: Sequence[str] = ("client_name", "fund_id", "ticker")
) -> DataFrame:
    return arrivals.select(*columns).distinct()


def dedupe_arrivals(
    arrivals: DataFrame, *, client: str = "client_name", by: Sequence[str] = ()
) -> DataFrame:
    """One row per fund, date and time; the lowest client stays.

    A minimum of names makes Spark sort the rows. Clients numbered in name order give the
    same answer by hashing, in about half the time: ``client="client_identifier"``.
    """
    return (
        arrivals.groupBy(*by, "fund_id", "nav_date", "sec")
        .agg(F.min(client).alias(client))
        .select(*by, client, "fund_id", "nav_date", "sec")
    )


def numbered_clients(arrivals: DataFrame, names: DataFrame) -> DataFrame:
    """Arrivals with ``client_identifier`` in place of the name; all rows stay.

    ``names`` are the numbers in name order that ``client_keys`` gives, so the lowest number is
    the lowest name, and minima of clients combine by hashing.
    """
    known = names.select("client_name", "client_identifier")
    return lookup_join(arrivals, known, ["client_name"], "left").drop("client_name")


def named_clients(df: DataFrame, names: DataFrame) -> DataFrame:
    """The names again, in place of ``client_identifier``."""
    known = names.select("client_identifier", "client_name")
    columns = ["client_name" if name == "client_identifier" else name for name in df.columns]
    return df.join(known, "client_identifier", "left").select(*columns)


def arrival_counts(
    arrivals: DataFrame, keys: Sequence[str] = ("client_name", "fund_id", "nav_date", "sec")
) -> DataFrame:
    """Rows per key."""
    return arrivals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def fund_counts(arrivals: DataFrame) -> DataFrame:
    """Distinct arrivals of each fund over all dates: counted per date, then added up."""
    daily = arrival_counts(dedupe_arrivals(arrivals), ["fund_id", "nav_date"])
    return daily.groupBy("fund_id").agg(F.sum("n").alias("n"))


def client_keys(arrivals: DataFrame) -> DataFrame:
    """Number the distinct client names 1, 2, 3, … in name order.

    The names are sorted by range partitioning. Each sorted partition is numbered by itself
    and shifted by the sizes of those before it, so no task sees all names; the only
    unpartitioned step runs over one row per partition.
    """
    names = arrivals.where(F.col("client_name").isNotNull()).select("client_name").distinct()
    placed = settle(
        names.orderBy("client_name").withColumn("_place", F.monotonically_increasing_id())
    ).select(
        "client_name",
        F.shiftright("_place", 33).alias("_part"),
        F.col("_place").bitwiseAND((1 << 33) - 1).alias("_row"),
    )
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_before") + F.col("_row") + 1).cast("int").alias("client_identifier"),
        "client_name",
    )


def merge_client_keys(clients: DataFrame, arrivals: DataFrame) -> DataFrame:
    """A stored client dimension with the names that are new in ``arrivals``.

    Numbers once given stay; new names follow from the largest, in name order. Names are told
    apart before they are sorted, so only the new ones are numbered.
    """
    lowest = F.min("client_identifier").alias("client_identifier")
    known = clients.groupBy("client_name").agg(lowest).select("client_identifier", "client_name")
    new = client_keys(
        arrivals.select("client_name").distinct().join(known, "client_name", "left_anti")
    )
    largest = known.agg(F.coalesce(F.max("client_identifier"), F.lit(0))).scalar()
    moved = (F.col("client_identifier") + largest).cast("int").alias("client_identifier")
    return known.unionByName(new.select(moved, "client_name"))


def client_dimension(clients: DataFrame) -> DataFrame:
    """Distinct named clients; the text ``NULL`` is no name."""
    return (
        clients.select("client_identifier", "client_name")
        .distinct()
        .where(F.col("client_name") != "NULL")
    )


def with_client_identifier(arrivals: DataFrame, clients: DataFrame) -> DataFrame:
    """Arrivals of known clients with their number; incomplete rows are dropped."""
    return lookup_join(arrivals, client_dimension(clients), ["client_name"], "inner").na.drop("any")
