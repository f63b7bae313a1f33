"""Hand-off between the steps of a job: written tables, by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.sources.sinks import overwrite_month, publish_keyed


class Stages:
    """Publishes the tables of one run under one folder that all executors share.

    A later step reads what an earlier one wrote, so it costs a scan of a small table and
    survives lost executors. All tables of a run carry the month of its latest arrival, and
    a second run for that month replaces them, empty tables included. Tables of a run over
    several feeds are partitioned by ``by`` within the month.
    """

    def __init__(self, folder: str, arrivals: DataFrame, by: Sequence[str] = ()):
        latest = arrivals.agg(F.date_format(F.max("nav_date"), "yyyyMM").alias("yyyymm"))
        self.folder = folder
        self.by = list(by)
        self.month = latest.first()["yyyymm"]
        self.tables: dict[str, DataFrame] = {}
        if self.month is None:
            raise ValueError("there are no arrivals to learn from")

    def publish(self, name: str, df: DataFrame) -> DataFrame:
        """Replace this month of the table and return it as it was written."""
        parts = [column for column in self.by if column in df.columns]
        written = overwrite_month(df, f"{self.folder}/{name}", self.month, parts=parts)
        found = df.sparkSession.read.schema(df.schema).parquet(written)
        self.tables[name] = found.select(*df.columns)
        return self.tables[name]

    def publish_history(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """As ``publish``, in buckets of one key, so that grouping by it needs no shuffle."""
        path = f"{self.folder}/{name}/yyyymm={self.month}"
        self.tables[name] = publish_keyed(df, path, key)
        return self.tables[name]
