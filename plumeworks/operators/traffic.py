"""Traffic counts and time filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import cut_lineage
from .quantiles import exact_quantiles


def time_filters(df: DataFrame, ts: str, start_day: str | None = None, end_day: str | None = None, start_hour: int | None = None, end_hour: int | None = None, weekday: bool = False, weekend: bool = False) -> DataFrame:
    """Days inclusive, hours from start to before end, weekdays or weekends (not both). Hour 0 is a bound like any other."""
    if weekday and weekend:
        raise ValueError("weekday and weekend exclude each other")
    if start_day is not None and end_day is not None:
        df = df.where(F.col(ts).between(F.lit(start_day).cast("timestamp"), F.lit(end_day).cast("timestamp")))
    if start_hour is not None and end_hour is not None:
        df = df.where((F.hour(ts) >= start_hour) & (F.hour(ts) < end_hour))
    if weekday or weekend:
        df = df.where(F.weekday(ts) < 5 if weekday else F.weekday(ts) >= 5)
    return df


def hourly_sums(df: DataFrame, ts: str, site: str, volume: str) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", ts).alias("hour"), site).agg(F.sum(volume).alias(volume))


def faulty_sites(df: DataFrame, site: str, volume: str, share: float = 0.8) -> DataFrame:
    """Sites whose share of zeros is above the limit."""
    return df.groupBy(site).agg(F.avg((F.col(volume) == 0).cast("int")).alias("zeros")).where(F.col("zeros") > share).select(site)


def quantile_trim(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows strictly between two quantiles of all values."""
    a, b = exact_quantiles(df, value, [low, high])
    return df.where((F.col(value) > F.lit(a)) & (F.col(value) < F.lit(b)))


def site_means(df: DataFrame, ts: str, site: str, volume: str, faulty_share: float = 0.8) -> DataFrame:
    """Hourly sums without faulty sites and extreme values, then each site's mean as ``avg_traffic``."""
    hourly = hourly_sums(df, ts, site, volume)
    sound = cut_lineage(hourly.join(faulty_sites(hourly, site, volume, faulty_share), site, "left_anti"))
    return quantile_trim(sound, volume).groupBy(site).agg(F.avg(volume).alias("avg_traffic"))


def aggregated_sites(df: DataFrame, ts: str, site: str, place: str, count: str, **when) -> DataFrame:
    """``site, place, avg_traffic`` from counts that are hourly already; ``when`` goes to time_filters. Time zones are left out by a cast before."""
    return time_filters(df.withColumn(ts, F.col(ts).cast("timestamp_ntz")), ts, **when).groupBy(site, place).agg(F.avg(count).alias("avg_traffic"))


def with_places(df: DataFrame, places: DataFrame, site: str) -> DataFrame:
    """Inner join with one row per site."""
    return df.join(places.dropDuplicates([site]), site)
