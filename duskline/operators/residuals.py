"""Predictions against what then arrived.

Residuals are counted: one row per entity, date, second and prediction, with ``n`` arrivals behind
it. Every error is made from these rows. They are the distinct ones, so an error over distinct rows
takes each once, and one over all arrivals takes each ``n`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.functions.clock import day_fraction
from duskline.operators.skew import weight_of

PREDICTED = ["client_name", "quantile01", "predicted_time", "alert_time", "quantile99"]


def counted_residuals(
    actual: DataFrame,
    predictions: DataFrame,
    outliers: DataFrame,
    *,
    entity: Sequence[str] = ("ticker", "fund_id"),
    by: Sequence[str] = (),
    predicted: Sequence[str] = PREDICTED,
) -> DataFrame:
    """Distinct arrivals with their number, their outlier mark, their prediction and the difference.

    ``actual`` and ``outliers`` are rows or counted ones. Both are counted together by entity,
    date and second, so a hot entity is combined on the map side and marks need no join; then an
    entity has at most one row per date and second, and the predictions are joined to these.
    ``entity`` is a ticker and its fund, or the fund alone. The difference is kept in whole
    seconds and as a fraction of a day; arrivals without a prediction stay, with nulls, also
    those whose entity is null.
    """
    entity = [*by, *entity]
    spot = [*entity, "nav_date", "sec"]
    seen = actual.select(*spot, weight_of(actual).alias("n"), F.lit(0).alias("marked"))
    marks = outliers.select(*spot, F.lit(0).cast("long").alias("n"), F.lit(1).alias("marked"))
    rows = (
        seen.unionByName(marks)
        .groupBy(*spot)
        .agg(F.sum("n").alias("n"), F.max("marked").alias("marked"))
        .where(F.col("n") > 0)
    )
    # A mark is joined by equality in the row form of this, so an incomplete spot has none.
    complete = F.lit(True)
    for name in spot:
        complete = complete & F.col(name).isNotNull()
    known = (
        predictions.groupBy(*entity, *predicted)
        .agg(F.count(F.lit(1)).alias("_times"))
        .select(*entity, *predicted, "_times")
    )
    diff = F.col("predicted_time") - F.col("sec")
    outlier = F.when((F.col("marked") == 1) & complete, "Outlier").otherwise("NotOutlier")
    return rows.join(known, entity, "left").select(
        *spot,
        outlier.alias("outlier"),
        *predicted,
        diff.alias("diff_sec"),
        day_fraction(diff).alias("diff_day"),
        (F.col("n") * F.coalesce("_times", F.lit(1))).alias("n"),
    )


def prediction_residuals(
    actual: DataFrame,
    predictions: DataFrame,
    outliers: DataFrame,
    *,
    entity: Sequence[str] = ("ticker", "fund_id"),
) -> DataFrame:
    """Every actual arrival as a row of its own, as often as it came."""
    counted = counted_residuals(actual, predictions, outliers, entity=entity)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return counted.withColumn("_time", times).drop("_time", "n")


def _mean(value: Column, weight: Column | None = None) -> Column:
    """Mean of whole seconds as a fraction of a day; sums are exact."""
    if weight is None:
        return day_fraction(F.avg(value))
    rows = F.sum(F.when(value.isNotNull(), weight))
    return day_fraction(F.try_divide(F.sum(value * weight), rows))


def counted(residuals: DataFrame) -> DataFrame:
    """Residuals as distinct rows with their number; counted ones are such rows already."""
    if "n" in residuals.columns:
        return residuals
    return residuals.groupBy(*residuals.columns).agg(F.count(F.lit(1)).alias("n"))


def mae_overall(residuals: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute difference over all arrivals, and without those marked as outliers."""
    diff, weight = F.abs("diff_sec"), weight_of(residuals)
    inlier = F.when(F.col("outlier") == "NotOutlier", diff)
    return residuals.groupBy(*by).agg(
        _mean(diff, weight).alias("mae"), _mean(inlier, weight).alias("mae_inliers")
    )


def mae_by(residuals: DataFrame, entity: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute difference per entity, over the distinct rows."""
    return counted(residuals).groupBy(*by, entity).agg(_mean(F.abs("diff_sec")).alias("mae"))


def signed_errors(residuals: DataFrame, entity: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Per entity over the distinct rows: late and early predictions apart,
    and their mean."""
    diff = F.col("diff_sec")
    negative = F.when(diff < 0, diff)
    positive = F.when(diff >= 0, diff)
    return counted(residuals).groupBy(*by, entity).agg(
        _mean(negative).alias("negative_mean"),
        F.count(negative).alias("negative_count"),
        _mean(positive).alias("positive_mean"),
        F.count(positive).alias("positive_count"),
        _mean(F.abs(diff)).alias("mae"),
    )


def client_fund_errors(
    residuals: DataFrame, client_funds: DataFrame, *, by: Sequence[str] = ()
) -> DataFrame:
    """Signed errors per fund with the client it belongs to."""
    fund = [*by, "fund_id"]
    pairs = client_funds.groupBy("client_name", *fund).agg(F.lit(1).alias("_pair"))
    return (
        signed_errors(residuals, "fund_id", by=by)
        .join(pairs, fund, "left")
        .select(
            *by,
            "client_name",
            "fund_id",
            "negative_mean",
            "negative_count",
            "positive_mean",
            "positive_count",
            "mae",
        )
    )


def entity_report(
    residuals: DataFrame,
    entity: str,
    *,
    by: Sequence[str] = (),
    predicted: Sequence[str] = PREDICTED,
) -> DataFrame:
    """Each predicted entity with its times and its mean absolute error.

    Sums per entity and prediction come first; the error of an entity is then a window over its
    few sums, so the rows are read once and not joined.
    """
    held = [name for name in ("fund_id", *predicted) if name != entity]
    diff = F.abs("diff_sec")
    sums = counted(residuals).groupBy(*by, entity, *held).agg(
        F.sum(diff).alias("_sum"), F.count(diff).alias("_rows")
    )
    whole = Window.partitionBy(*by, entity)
    error = F.try_divide(F.sum("_sum").over(whole), F.sum("_rows").over(whole))
    return sums.select(*by, entity, *held, day_fraction(error).alias("mae"))


def ticker_report(residuals: DataFrame) -> DataFrame:
    """The report of tickers, over the distinct rows."""
    return entity_report(residuals, "ticker")


def fund_report(residuals: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The report of funds, for feeds without tickers."""
    return entity_report(residuals, "fund_id", by=by)
