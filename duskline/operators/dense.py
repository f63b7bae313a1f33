"""Counts on a complete axis, without joining to a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_counts(df: DataFrame, keys: Sequence[str], slot: str, slots: int) -> DataFrame:
    """Rows per key and slot 1 … ``slots``, zeros included, as column ``n``.

    One counter per slot in a single aggregate: one shuffle, of one row per key and task.
    """
    counters = F.array(*[F.count_if(F.col(slot) == i) for i in range(1, slots + 1)])
    return (
        df.groupBy(*keys)
        .agg(counters.alias("_counts"))
        .select(*keys, F.posexplode("_counts").alias("_at", "n"))
        .select(*keys, (F.col("_at") + 1).alias(slot), "n")
    )


def dense_measures(
    counts: DataFrame, keys: Sequence[str], slot: str, slots: int, measures: Sequence[str]
) -> DataFrame:
    """Spread counted rows over slots 0 … ``slots - 1``, zeros included.

    ``counts`` has one row per key and slot, so at most ``slots`` entries meet per key; rows
    without a slot only make their key appear.
    """
    entry = F.struct(F.col(slot), F.struct(*measures))
    held = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col(slot).isNotNull(), entry))).alias("_held")
    )
    spread = held.select(
        *keys, "_held", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias(slot)
    )
    found = F.try_element_at("_held", F.col(slot))
    return spread.select(
        *keys, slot, *[F.coalesce(found[name], F.lit(0)).alias(name) for name in measures]
    )
