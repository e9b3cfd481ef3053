"""Aggregation of points to spatial units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def typical_day_mean(df: DataFrame, unit: str, ts: str, value: str) -> DataFrame:
    """Each unit's mean of daily means."""
    daily = df.groupBy(unit, F.to_date(ts).alias("day")).agg(F.avg(value).alias("m"))
    return daily.groupBy(unit).agg(F.avg("m").alias(value))


def observation_counts(df: DataFrame, unit: str, value: str) -> DataFrame:
    """``unit, n_obs, pct``: non-null values by unit and their share in percent. One row per unit is summed at once."""
    counts = df.groupBy(unit).agg(F.count(value).alias("n_obs"))
    total = counts.agg(F.sum("n_obs").alias("total"))
    return counts.join(F.broadcast(total)).select(unit, "n_obs", F.try_divide(100.0 * F.col("n_obs"), F.col("total")).alias("pct"))


def well_sampled(df: DataFrame, unit: str, value: str, quantile: float | None) -> DataFrame:
    """Rows of units with more values than the quantile of the units' counts; all rows if it is null or 0."""
    if not quantile:
        return df
    counts = observation_counts(df, unit, value)
    limit = counts.agg(F.percentile("n_obs", F.lit(quantile)).alias("limit"))
    kept = counts.join(F.broadcast(limit)).where(F.col("n_obs") > F.col("limit")).select(unit)
    return df.join(kept, unit, "left_semi")


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
