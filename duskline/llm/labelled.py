"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of text of a sample, and of each label's with `each`.
SAMPLE_BYTES = 64 << 20


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, y) outside the fold `held_out`, without null labels and ids; a doc_id labelled twice has its larger label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & (fold(modulus) != held_out))
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    most: int,
    each: bool = False,
    most_bytes: int = SAMPLE_BYTES,
) -> pa.Table:
    """(doc_id, y, text) of at most `most` labelled documents outside the fold `held_out`.

    Documents are chosen by the hash of doc_id, with `each` that many of every label, and as many of
    them in that order as hold `most_bytes` bytes of text together. Of rows that repeat a doc_id the
    least text is taken, so the bounds hold for rows.
    """
    known = training_labels(labels, label, modulus, held_out)
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = known.orderBy(order).limit(most)
    if each:
        chosen = known.where("y = 1").orderBy(order).limit(most).unionAll(known.where("y <> 1").orderBy(order).limit(most))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * `most` rows of two numbers are broadcast.
    found = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # At most 2 * `most` rows meet in these windows.
    before = Window.partitionBy("y" if each else F.lit(0)).orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(F.octet_length("text").cast("long")).over(before) <= most_bytes
    return found.withColumn("within", within).where("within").drop("within").toArrow().sort_by("doc_id")


def sample(*args, **named) -> tuple[list[str], list[int]]:
    """Texts and labels of `sample_rows`."""
    table = sample_rows(*args, **named)
    return table.column("text").to_pylist(), table.column("y").to_pylist()
