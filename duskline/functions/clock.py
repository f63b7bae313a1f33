"""Time-of-day column expressions. Every one is a built-in Spark expression, so the
jobs that use them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskline import constants as c


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def seconds_of_day(ts: Column | str) -> Column:
    ts = _col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def arrival_timestamp(date: Column | str, sec: Column | str) -> Column:
    """Date plus seconds of day, without a time zone."""
    return _col(date).cast("timestamp_ntz") + F.make_dt_interval(secs=_col(sec))


def day_fraction(sec: Column | str) -> Column:
    return _col(sec) / F.lit(float(c.DAY_SECONDS))


def whole_seconds(value: Column | str) -> Column:
    """Truncate to a whole second; the rounding first absorbs floating noise."""
    return F.floor(F.round(_col(value), 6)).cast("int")


def clock_text(sec: Column | str) -> Column:
    """Whole seconds as HH:MM:SS text; null stays null."""
    sec = _col(sec)
    text = F.format_string(
        "%02d:%02d:%02d",
        F.floor(sec / 3600),
        F.floor(sec % 3600 / 60),
        (sec % 60).cast("bigint"),
    )
    return F.when(sec.isNotNull(), text)


def strip_fraction(text: Column | str) -> Column:
    return F.substring_index(_col(text), ".", 1)


def seconds_from_text(text: Column | str) -> Column:
    """HH:MM:SS text, with or without a fraction, as seconds; other text raises."""
    parts = F.split(strip_fraction(text), ":")
    return (
        parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int")
    )


def weekday_index(date: Column | str) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(_col(date))


def is_business_day(date: Column | str) -> Column:
    return weekday_index(date) <= 4


def bin_index(sec: Column | str, *, fold_out_of_range: bool = False) -> Column:
    """Five-minute bin from 16:00, the first bin being 1.

    ``fold_out_of_range`` counts every hour other than 16 and 17 as hour 18.
    """
    sec = _col(sec)
    if fold_out_of_range:
        hour = F.floor(sec / 3600)
        minute = F.floor(sec % 3600 / 60)
        offset = F.when(hour == 16, 0).when(hour == 17, 60).otherwise(120)
        return (F.floor((offset + minute) / 5) + 1).cast("int")
    return (F.floor((sec - c.WINDOW_OPEN) / c.BIN_SECONDS) + 1).cast("int")


def in_window(sec: Column | str) -> Column:
    """From 16:00:00 to 19:00:00, both included."""
    return _col(sec).between(c.WINDOW_OPEN, c.WINDOW_CLOSE)


def bin_label(bin_: Column | str) -> Column:
    return F.lit(c.FIRST_BIN_LABEL) + (_col(bin_) - 1) * 5


def bucket_floor(seconds: Column | str, width: int = c.BIN_SECONDS) -> Column:
    seconds = _col(seconds)
    return seconds - seconds % width


def ceil_minute(sec: Column | str) -> Column:
    """The next full minute; a full minute stays."""
    return (F.ceil(_col(sec) / 60) * 60).cast("int")


def minute_slot(sec: Column | str) -> Column:
    """Minute of the delivery window, 0 to 180, for a time rounded up to the minute.

    15:59:00 counts as 16:00:00; any other time off the axis has no slot.
    """
    sec = ceil_minute(sec)
    sec = F.when(sec == c.WINDOW_OPEN - 60, c.WINDOW_OPEN).otherwise(sec)
    slot = F.floor((sec - c.WINDOW_OPEN) / 60).cast("int")
    return F.when(slot.between(0, c.MINUTE_COUNT - 1), slot)


def before_cutoff(sec: Column | str, cutoff: int = c.CUTOFF) -> Column:
    return _col(sec) < cutoff


def after_cutoff(sec: Column | str, cutoff: int = c.CUTOFF) -> Column:
    """Strictly after: an arrival on the cut-off itself is no miss."""
    return _col(sec) > cutoff
