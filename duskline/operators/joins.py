"""Joining a large table to one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from duskline.operators.skew import row_salt
from duskline.sources.sinks import settle

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16  # tasks that share a key when a table is too large to be broadcast


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            size = size + 8
    return size


def fits_broadcast(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Measured, not estimated: rows and bytes of a settled table."""
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")
    ).first()
    return found["rows"] <= rows and (found["bytes"] or 0) <= size


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table to a table with one row per key (inner, left, semi or anti).

    The lookup side is settled and measured first. When it fits, it is broadcast and the
    large side is not shuffled at all. When it does not fit, the large side is shuffled by key
    and salt, and the lookup side is repeated per salt; rows without a key are spread as well.
    """
    lookup = settle(lookup)
    columns = list(facts.columns)
    if not how.startswith("left_"):
        columns += [name for name in lookup.columns if name not in keys]
    if fits_broadcast(lookup, broadcast_rows):
        return facts.join(F.broadcast(lookup), list(keys), how).select(*columns)
    on = [*keys, "_salt"]
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        facts.withColumn("_salt", row_salt(facts, keys, SALTS)).join(salted, on, how).select(*columns)
    )
