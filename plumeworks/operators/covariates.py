"""Covariates of spatial units: pivots, outer merges, shares, selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(df: DataFrame, unit: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """Sums by unit, a column for each kind; missing ones are 0. Fixed kinds spare a pass to find them."""
    return df.groupBy(unit).pivot(kind, kinds).agg(F.sum(value)).na.fill(0, kinds)


def share_of_area(df: DataFrame, columns: list[str], area: str) -> DataFrame:
    return df.withColumns({c: F.try_divide(100.0 * F.col(c), F.col(area)) for c in columns})


def drop_mostly_zero(df: DataFrame, columns: list[str], most: float = 0.25) -> DataFrame:
    """df without the columns whose share of zeros is above the limit, found in one pass."""
    zeros = df.agg(*[F.avg((F.col(c) == 0).cast("int")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if zeros[c] is not None and zeros[c] > most])


def merge_units(tables: list[DataFrame], unit: str) -> DataFrame:
    """Full outer joins on the unit; repeated columns come from the first table that has them. Then complete rows only."""
    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.drop(*[c for c in b.columns if c != unit and c in a.columns]), unit, "full_outer")

    return reduce(join, tables).na.drop("any")


def pearson(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are present; null where one of them does not vary."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pearson's r of each pair, over rows where both are present, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[i] for i, p in enumerate(pairs)}


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` of each pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.col(a), F.col(b)).alias("r")) for a, b in pairs]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def select_covariates(df: DataFrame, target: str, columns: list[str], least: float = 0.2, most: float = 0.5, least_cv: float = 0.1) -> list[str]:
    """Columns that follow the target, by strength, that do not follow a stronger one, and that vary."""
    r = correlations(df, [target, *columns])
    of = lambda a, b: abs(r.get((a, b), r.get((b, a))) or 0.0)
    kept: list[str] = []
    for c in sorted(columns, key=lambda c: (-of(target, c), c)):
        if of(target, c) > least and all(of(c, k) <= most for k in kept):
            kept.append(c)
    cv = df.agg(*[F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias(c) for c in kept]).first() if kept else {}
    kept = [c for c in kept if cv[c] is not None and cv[c] >= least_cv]
    if not kept:
        raise ValueError("no covariate is left")
    return kept


def variance_inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The diagonal of the inverse correlation matrix, which one pass over the rows gives."""
    r = correlations(df, columns)
    m = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i + 1 :], i + 1):
            m[i, j] = m[j, i] = r[(a, b)] or 0.0
    return dict(zip(columns, np.diag(np.linalg.pinv(m)).tolist()))


def reduce_multicollinearity(df: DataFrame, columns: list[str], most: float = 5.0) -> list[str]:
    """Drops the column with the largest inflation until all are within the limit; correlations are computed once."""
    r, kept = correlations(df, columns), list(columns)
    while len(kept) > 1:
        m = np.eye(len(kept))
        for i, a in enumerate(kept):
            for j, b in enumerate(kept):
                if i != j:
                    m[i, j] = r.get((a, b), r.get((b, a))) or 0.0
        vif = np.diag(np.linalg.pinv(m))
        if vif.max() <= most:
            break
        kept.pop(int(vif.argmax()))
    return kept


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / standard deviation (of the population) of each column."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    of = df.join(F.broadcast(stats))
    return of.withColumns({c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}).select(df.columns)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, n``: counts in equal bins from the least to the greatest value, whose top edge belongs to the last bin."""
    b = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    of = df.where(F.col(value).isNotNull()).join(F.broadcast(b))
    number = F.when(F.col("__a") == F.col("__b"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(value) - F.col("__a")) / ((F.col("__b") - F.col("__a")) / bins)) + 1))
    return of.groupBy(number.cast("long").alias("bin")).agg(F.count("*").alias("n"))
