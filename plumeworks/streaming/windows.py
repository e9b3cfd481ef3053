"""Streaming forms of the hourly sums and of the split by gaps, with watermarks that bound their state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_sums(stream: DataFrame, ts: str, site: str, volume: str, late: str = "1 hour") -> DataFrame:
    """Tumbling hourly sums by site; rows later than the watermark are dropped."""
    of = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return of.groupBy(F.window(ts, "1 hour"), site).agg(F.sum(volume).alias(volume)).select(F.col("window.start").alias("hour"), site, volume)


def sessions(stream: DataFrame, ts: str, vehicle: str, value: str, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """One row for each trajectory: rows of a vehicle no further apart than the gap."""
    of = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return of.groupBy(F.session_window(ts, gap), vehicle).agg(F.count("*").alias("n"), F.avg(value).alias(value)).select(F.col("session_window.start").alias("start"), vehicle, "n", value)


def hourly_medians(stream: DataFrame, ts: str, value: str, late: str = "1 hour") -> DataFrame:
    """Tumbling hourly medians; the daily median of these is a batch step over what is written."""
    of = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return of.groupBy(F.window(ts, "1 hour")).agg(F.percentile(value, F.lit(0.5)).alias(value)).select(F.col("window.start").alias("hour"), value)


def rates(stream: DataFrame, ts: str, vehicle: str, value: str, max_gap_s: float = 60, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``vehicle, ts, rate`` of each step of at most max_gap_s seconds; other rows have no rate.

    Only the last time and value of a vehicle are kept between batches, and are let go
    once the watermark is idle_ms past them; rows later than the watermark are dropped. A batch is sorted by time; a row that is older than the last one of the
    batches before has no rate and does not replace it. Rows without a time or value are left out.
    """
    of = stream.select(F.col(vehicle).cast("string").alias("vehicle"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "value"], kind="stable")
        last_us, last = state.get if state.exists else (None, None)
        us, v = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), rows["value"].to_numpy()
        new = np.ones(len(us), bool) if last_us is None else us >= last_us
        rate = np.full(len(us), np.nan)
        t, x = us[new], v[new]
        before_t = np.r_[t[0] - np.int64(2e6 * max_gap_s) - 1 if last_us is None else last_us, t[:-1]] if len(t) else t
        before_x = np.r_[x[0] if last is None else last, x[:-1]] if len(t) else x
        gap, change = (t - before_t) / 1e6, np.abs(x - before_x)
        with np.errstate(divide="ignore", invalid="ignore"):
            rate[new] = np.where(gap <= max_gap_s, change / gap, np.nan)
        if len(t):
            state.update((int(t[-1]), float(x[-1])))
        state.setTimeoutTimestamp(max(int(us.max()) // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"vehicle": key[0], "ts": rows["ts"], "rate": rate})

    known = of.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    of = known.groupBy("vehicle").applyInPandasWithState(step, "vehicle string, ts timestamp, rate double", "us long, value double", "append", GroupStateTimeout.EventTimeTimeout)
    return of.withColumn("rate", F.nanvl("rate", F.lit(None).cast("double")))
