"""From text deliveries to typed arrival rows."""

from __future__ import annotations

import datetime as dt
import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from duskline import constants as c
from duskline.functions.clock import (
    after_cutoff,
    arrival_timestamp,
    in_window,
    is_business_day,
    seconds_of_day,
)

# Text patterns of the feeds; they accept one- and two-digit parts alike.
DATE_PATTERN = "M/d/yyyy"
TIMESTAMP_PATTERN = "M/d/yy HH:mm"


# How a letter of a pattern is written, and which part of a timestamp it gives.
LETTERS = {"yyyy": (r"\d{4}", 0), "yy": (r"\d{2}", 0), "M": (r"\d{1,2}", 1), "d": (r"\d{1,2}", 2)}
LETTERS |= {"HH": (r"\d{2}", 3), "H": (r"\d{1,2}", 3), "mm": (r"\d{2}", 4), "ss": (r"\d{2}", 5)}


def _parsed(text: Column | str, pattern: str) -> Column:
    """A timestamp without zone, or null where the text does not fit or names no real time.

    The parts are read as numbers and put together, so no session time zone has a say.
    """
    text = F.col(text) if isinstance(text, str) else text
    pieces = re.findall(r"[A-Za-z]+|[^A-Za-z]+", pattern)
    letters = [piece for piece in pieces if piece[0].isalpha()]
    if not set(letters) <= set(LETTERS) or any(c.isdigit() for c in pattern):
        raise ValueError(f"a pattern is made of {', '.join(LETTERS)} and separators, not {pattern!r}")
    shape = "".join(LETTERS[p][0] if p in LETTERS else re.escape(p) for p in pieces)
    numbers = F.split(text, r"\D+")
    parts = [F.lit(2000), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)]
    for i, letter in enumerate(letters):
        number = F.get(numbers, F.lit(i)).try_cast("int")
        parts[LETTERS[letter][1]] = number + 2000 if letter == "yy" else number
    return F.when(text.rlike(f"^{shape}$"), F.try_make_timestamp_ntz(*parts))


def parse_date(text: Column | str, pattern: str = DATE_PATTERN) -> Column:
    """Null where the text is no date, instead of an error."""
    return _parsed(text, pattern).cast("date")


def parse_timestamp(text: Column | str, pattern: str = TIMESTAMP_PATTERN) -> Column:
    """Clock time as written, the same in every session time zone."""
    return _parsed(text, pattern)


def _bound(value: dt.date | str | None) -> Column | None:
    return None if value is None else F.lit(dt.date.fromisoformat(str(value)))


def normalize_arrivals(
    raw: DataFrame,
    *,
    time_column: str = "datetime",
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
) -> DataFrame:
    """Complete rows with real dates between ``first`` and ``last``, both included."""
    lowest, highest = _bound(first), _bound(last)

    def valid(row: Column) -> Column:
        kept = row["nav_date"].isNotNull() & row["arrival_ts"].isNotNull()
        if lowest is not None:
            kept = kept & (row["nav_date"] >= lowest)
        if highest is not None:
            kept = kept & (row["nav_date"] <= highest)
        return kept

    # Parsing costs most here. A filter on parsed columns would be pushed below them and
    # parse the text again for every condition; an array of one row is parsed once.
    parsed = F.struct(
        parse_date("nav_date").alias("nav_date"), parse_timestamp(time_column).alias("arrival_ts")
    )
    return (
        raw.na.drop("any")
        .select(*_held(raw), F.inline(F.filter(F.array(parsed), valid)))
        .withColumn("sec", seconds_of_day("arrival_ts"))
    )


def _held(raw: DataFrame) -> list[Column | str]:
    """What is kept of a delivery besides its times."""
    extra = [name for name in ("feed", "ticker") if name in raw.columns]
    fund = F.translate("fund_id", " ", "").alias("fund_id")
    return ["client_name", fund, *extra]


def _judged(raw: DataFrame, time_column: str) -> DataFrame:
    """The delivery with its parsed times in ``_p`` and, where it is dropped, the ``reason``."""
    complete = F.lit(True)
    for name in raw.columns:
        complete = complete & F.col(name).isNotNull()
    parsed = F.struct(
        parse_date("nav_date").alias("nav_date"), parse_timestamp(time_column).alias("arrival_ts")
    )
    reason = (
        F.when(~complete, "incomplete")
        .when(F.col("_p.nav_date").isNull(), "bad_date")
        .when(F.col("_p.arrival_ts").isNull(), "bad_time")
    )
    return raw.withColumn("_p", parsed).withColumn("reason", reason)


def rejected_rows(raw: DataFrame, *, time_column: str = "datetime") -> DataFrame:
    """The deliveries that ``normalize_arrivals`` drops, as they came, with the first reason."""
    judged = _judged(raw, time_column)
    return judged.where(F.col("reason").isNotNull()).select(*raw.columns, "reason")


def observed_arrivals(
    raw: DataFrame, *, time_column: str = "datetime"
) -> tuple[DataFrame, Observation]:
    """``normalize_arrivals`` over all dates, and an observation that counts on the way.

    The counts are those of ``normalization_audit``. They are there once the arrivals have been
    written, and cost no scan of their own.
    """
    seen = Observation(f"deliveries-{uuid4().hex}")
    reason = F.col("reason")
    judged = _judged(raw, time_column).observe(
        seen,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(reason == "incomplete").alias("rows_incomplete"),
        F.count_if(reason == "bad_date").alias("rows_bad_date"),
        F.count_if(reason == "bad_time").alias("rows_bad_time"),
        F.count_if(reason.isNull()).alias("rows_kept"),
    )
    kept = judged.where(reason.isNull()).select(*_held(raw), "_p.nav_date", "_p.arrival_ts")
    return kept.withColumn("sec", seconds_of_day("arrival_ts")), seen


def normalization_audit(raw: DataFrame, *, time_column: str = "datetime") -> DataFrame:
    """How many rows ``normalize_arrivals`` keeps or drops, by reason, in one pass."""
    complete = F.lit(True)
    for name in raw.columns:
        complete = complete & F.col(name).isNotNull()
    bad_date = F.col("_date").isNull()
    bad_time = F.col("_ts").isNull()
    parsed = raw.withColumns(
        {"_date": parse_date("nav_date"), "_ts": parse_timestamp(time_column)}
    )
    return parsed.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~complete).alias("rows_incomplete"),
        F.count_if(complete & bad_date).alias("rows_bad_date"),
        F.count_if(complete & ~bad_date & bad_time).alias("rows_bad_time"),
        F.count_if(complete & ~bad_date & ~bad_time).alias("rows_kept"),
    )


def date_range(
    df: DataFrame,
    first: dt.date | str | None,
    last: dt.date | str | None,
    column: str = "nav_date",
) -> DataFrame:
    """Inclusive date filter; a bound that is no date raises."""
    lowest, highest = _bound(first), _bound(last)
    if lowest is not None:
        df = df.where(F.col(column) >= lowest)
    if highest is not None:
        df = df.where(F.col(column) <= highest)
    return df


def with_arrival_timestamp(arrivals: DataFrame) -> DataFrame:
    return arrivals.withColumn("arrival_ts", arrival_timestamp("nav_date", "sec"))


def split_timestamp(df: DataFrame, column: str = "arrival_ts") -> DataFrame:
    """Adds the date and the HH:MM:SS text of a timestamp."""
    return df.withColumns(
        {
            "arrival_date": F.to_date(column),
            "arrival_time": F.date_format(column, "HH:mm:ss"),
        }
    )


def grid_audit(arrivals: DataFrame) -> DataFrame:
    """Rows that the volume jobs keep, and those they drop, by reason."""
    business = is_business_day("nav_date")
    sec = F.col("sec")
    return arrivals.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~business).alias("rows_weekend"),
        F.count_if(business & (sec < c.WINDOW_OPEN)).alias("rows_before_window"),
        F.count_if(business & (sec > c.WINDOW_CLOSE)).alias("rows_after_window"),
        F.count_if(business & in_window(sec)).alias("rows_kept"),
        F.count_if(after_cutoff(sec)).alias("rows_after_cutoff"),
    )
