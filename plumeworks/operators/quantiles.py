"""Exact quantiles of a whole column without meeting in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Different values that one task orders.
MOST = 1_000_000
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, at: list[float], most: int = MOST) -> list[float | None]:
    """The quantiles ``at`` (0 to 1) with linear interpolation, as ``percentile`` gives them; None without values. Nulls are left out.

    A table of at most ``most`` values is ordered as it is. Beyond, a mergeable sketch
    brackets each rank, the rows below the bracket are counted, and the bracket is
    narrowed until it holds at most ``most`` different values; the result stays exact.
    """
    of = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = of.count()
    if not n:
        return [None] * len(at)
    if n <= most:
        return list(of.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in at])).alias("q")).first()["q"])
    out = []
    for q in at:
        place = q * (n - 1)
        low, high = math.floor(place), math.ceil(place)
        a, b = _ranked(of, n, low, high, most)
        out.append(a if low == high or a == b else (high - place) * a + (place - low) * b)
    return out


def _ranked(of: DataFrame, n: int, low: int, high: int, most: int) -> tuple[float, float]:
    """The values at two neighbouring ranks (from 0) of n values."""
    while True:
        slack = 2 / ACCURACY
        ends = F.percentile_approx("v", F.array(F.lit(max(low / n - slack, 0.0)), F.lit(min((high + 1) / n + slack, 1.0))), ACCURACY)
        a, b = of.agg(ends.alias("e")).first()["e"]
        below, inside = of.agg(F.count_if(F.col("v") < a).alias("b"), F.count_if(F.col("v").between(a, b)).alias("i")).first()
        if not below <= low <= high < below + inside:
            a, b, below, inside = None, None, 0, n
        bracket = of if a is None else of.where(F.col("v").between(a, b))
        counts = bracket.groupBy("v").agg(F.count("*").alias("c"))
        if inside == n or inside <= most or counts.count() <= most:
            break
        of, n, low, high = bracket, inside, low - below, high - below
    upto = counts.withColumn("u", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    r = upto.agg(*[F.min(F.when(F.col("u") > k - below, F.col("v"))) for k in (low, high)]).first()
    return r[0], r[1]
