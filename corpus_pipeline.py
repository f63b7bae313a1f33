"""The corpus pipeline: each stage filters or changes what its predecessor kept.

A stage is called when what the one before it returned has been written, so it first clears the
tables which that one settled on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duskline.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from duskline.llm.queries import tokenizer_files
from duskline.llm.tables import clear_settled, settled, table


# Rows of an Arrow batch: long texts come in few, and a worker holds a batch and what it makes of it.
BATCH_ROWS = 2000


def _begin(spark: SparkSession) -> None:
    clear_settled(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return near_dedup.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return suffix_dedup.drop_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return packing.packed(docs, *tokenizer_files())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", sequences),
]

# A trained classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
