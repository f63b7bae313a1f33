"""From raw deliveries to the stored arrivals that the other jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duskline.sources.arrivals import observed_arrivals, rejected_rows
from duskline.sources.sinks import publish_arrivals, publish_report
from duskline.sources.tables import read_arrivals


def store_deliveries(
    raw: DataFrame, folder: str, *, time_column: str = "datetime", by_day: bool = False
) -> dict[str, DataFrame]:
    """Arrivals by month, the deliveries that were dropped, and how many of each there are.

    The counts come from the pass that writes the arrivals. The dropped deliveries are a second
    read, since they are kept as they came.
    """
    spark = raw.sparkSession
    arrivals, seen = observed_arrivals(raw, time_column=time_column)
    path = f"{folder}/arrivals"
    publish_arrivals(arrivals, path, by_day=by_day)
    rejected = rejected_rows(raw, time_column=time_column)
    publish_report(rejected, f"{folder}/rejected")
    counts = [(name, count) for name, count in seen.get.items()]
    drops = spark.createDataFrame([tuple(n for _, n in counts)], ", ".join(f"{k} bigint" for k, _ in counts))
    publish_report(drops, f"{folder}/drops")
    return {
        "arrivals": read_arrivals(spark, path, arrivals.schema),
        "rejected": spark.read.schema(rejected.schema).parquet(f"{folder}/rejected"),
        "drops": spark.read.schema(drops.schema).parquet(f"{folder}/drops"),
    }
