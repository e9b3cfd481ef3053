"""Local outlier factors, and how outlier sets are combined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.space import Splits, nearest_k
from .graphs import cut_lineage
from .quantiles import exact_quantiles

#: Places in a shard of knn_features, about; shards at most; and places in the sample for each shard.
SHARD, LEAVES, SAMPLE = 8192, 16384, 64


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR of each column; an IQR of 0 counts as 1."""
    scaled = {}
    for c in columns:
        a, m, b = exact_quantiles(df, c, [0.25, 0.5, 0.75])
        scaled[c] = F.lit(None).cast("double") if m is None else (F.col(c) - m) / ((b - a) or 1.0)
    return df.withColumns(scaled)


def lof(neighbours: DataFrame, k: int) -> DataFrame:
    """``node, lof`` from ``focal, neighbor, dist, rank``: each stage a join on the neighbour table."""
    near = neighbours.where(F.col("rank") <= k)
    kdist = near.groupBy(F.col("focal").alias("neighbor")).agg(F.max("dist").alias("kd"))
    reach = near.join(kdist, "neighbor").withColumn("reach", F.greatest("dist", "kd"))
    lrd = reach.groupBy("focal").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = lrd.select(F.col("focal").alias("neighbor"), F.col("lrd").alias("o"))
    of = near.join(other, "neighbor").groupBy("focal").agg(F.avg("o").alias("o")).join(lrd, "focal")
    return of.select(F.col("focal").alias("node"), (F.col("o") / F.col("lrd")).alias("lof"))


def knn_features(df: DataFrame, key: str, columns: list[str], k: int, shard: int = SHARD, leaves: int = LEAVES) -> DataFrame:
    """``focal, neighbor, dist, rank``: the k nearest other rows by Euclidean distance over several columns, ties to the smaller key; fewer where there are fewer rows.

    Rows of one place are one: a place has its k + 1 smallest keys. A k-d tree, split at
    the medians of a sample of SAMPLE places for each leaf, deals places to shards of about
    ``shard``; with more than ``leaves`` of them shards grow. In its shard each place
    finds its nearest, whose last distance bounds what else is needed: it is sent to just
    the shards that the ball of that radius comes into, and what these find is merged.
    Rows with a null or NaN feature take no part. A shard's places fit a task.
    """
    spark, most = df.sparkSession, k + 1
    v = F.array(*[F.col(c).cast("double") + 0.0 for c in columns])
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= most)
    places = cut_lineage(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("p"), "v", "ids"))
    n = places.count()
    want = min(leaves, -(-n // shard)) if n else 1
    part = F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < max(1, min(1_000_000, 1_000_000 * SAMPLE * want // max(n, 1)))
    sample = [r.v for r in places.where(part).select("v").collect()] if want > 1 else []
    tree = Splits.of(np.array(sample, float).reshape(-1, len(columns)), want)
    shared = spark.sparkContext.broadcast(tree)

    def dealt(pdf: pd.DataFrame, radius: np.ndarray, own: np.ndarray | None) -> pd.DataFrame:
        row, leaf = shared.value.reached(np.stack(pdf["v"].to_list()), radius)
        out = pdf.iloc[row].assign(leaf=leaf)
        return out if own is None else out[leaf != own[row]]

    def to_leaves(frames):
        for pdf in frames:
            if len(pdf):
                yield dealt(pdf, np.zeros(len(pdf)), None)[["p", "v", "leaf"]]

    found, names = "p long, v array<double>, leaf int, near array<struct<d:double,q:long>>", ["d", "q"]

    def lists(ids: np.ndarray, place: np.ndarray, dist: np.ndarray) -> list:
        return [[dict(zip(names, pair)) for pair in zip(d.tolist(), ids[q].tolist())] for q, d in zip(place, dist)]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p").reset_index(drop=True)
        x = np.stack(pdf["v"].to_list())
        place, dist = nearest_k(x, x, most)
        return pdf.assign(near=lists(pdf["p"].to_numpy(), place, dist))[["p", "v", "leaf", "near"]]

    at = cut_lineage(places.select("p", "v").mapInPandas(to_leaves, "p long, v array<double>, leaf int"))
    near = cut_lineage(at.groupBy("leaf").applyInPandas(inside, found))
    every = near.select("p", "near")
    if tree.leaves > 1:

        def sent(frames):
            for pdf in frames:
                if len(pdf):
                    yield dealt(pdf, pdf["radius"].to_numpy(), pdf["leaf"].to_numpy())[["p", "v", "leaf", "radius"]]

        def border(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(asked):
                return pd.DataFrame({"p": pd.Series(dtype="int64"), "near": pd.Series(dtype=object)})
            mine = mine.sort_values("p").reset_index(drop=True)
            place, dist = nearest_k(np.stack(asked["v"].to_list()), np.stack(mine["v"].to_list()), most)
            got = [[pair for pair in some if pair["d"] <= r] for some, r in zip(lists(mine["p"].to_numpy(), place, dist), asked["radius"])]
            return pd.DataFrame({"p": asked["p"].to_numpy(), "near": got})

        radius = F.when(F.size("near") < most, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
        asks = near.select("p", "v", "leaf", radius.alias("radius")).mapInPandas(sent, "p long, v array<double>, leaf int, radius double")
        more = at.groupBy("leaf").cogroup(asks.groupBy("leaf")).applyInPandas(border, "p long, near array<struct<d:double,q:long>>")
        every = every.union(more).groupBy("p").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near"))
    pairs = every.select("p", F.explode("near").alias("n")).select("p", "n.d", "n.q").join(places.select(F.col("p").alias("q"), "ids"), "q")
    ids = pairs.groupBy("p").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("i")))))), 1, most).alias("near"))
    focal = rows.join(places.select("p", "v"), "v").select("p", F.col("id").alias("focal")).join(ids, "p")
    others = F.slice(F.filter("near", lambda x: x["i"] != F.col("focal")), 1, k)
    return focal.select("focal", F.posexplode(others).alias("r", "n")).select("focal", F.col("n.i").alias("neighbor"), F.col("n.d").alias("dist"), (F.col("r") + 1).alias("rank"))


def best_lof(df: DataFrame, key: str, columns: list[str], choices: tuple[int, ...] = (20, 30, 40, 50, 60, 70), spread: str = "std", limit: float = -1.5) -> tuple[DataFrame, int]:
    """(``node, lof, is_spatial_outlier``, chosen k): the k whose scores spread most, the first of equal ones. Neighbours are found once, for the largest k."""
    near = cut_lineage(knn_features(df, key, columns, max(choices)))
    best, most, chosen = None, -1.0, choices[0]
    for k in choices:
        scores = lof(near, k)
        s = scores.agg(F.stddev_pop("lof") if spread == "std" else F.percentile("lof", F.lit(0.75)) - F.percentile("lof", F.lit(0.25))).first()[0] or 0.0
        if s > most:
            best, most, chosen = scores, s, k
    return best.withColumn("is_spatial_outlier", -F.col("lof") < limit), chosen


def combine(points: DataFrame, key: str, temporal: DataFrame, spatial: DataFrame, method: str = "intersection") -> tuple[DataFrame, DataFrame]:
    """(cleaned, outliers): points without the combined outliers, and all flagged points with three flags."""
    if method not in ("union", "intersection"):
        raise ValueError("method must be union or intersection")
    t, s = temporal.select(key).distinct().withColumn("is_temporal_outlier", F.lit(True)), spatial.select(key).distinct().withColumn("is_spatial_outlier", F.lit(True))
    of = points.join(t, key, "left").join(s, key, "left").na.fill(False, ["is_temporal_outlier", "is_spatial_outlier"])
    of = of.withColumn("is_spatiotemp_outlier", F.col("is_temporal_outlier") & F.col("is_spatial_outlier"))
    drop = F.col("is_spatiotemp_outlier") if method == "intersection" else F.col("is_temporal_outlier") | F.col("is_spatial_outlier")
    return of.where(~drop).select(points.columns), of.where(F.col("is_temporal_outlier") | F.col("is_spatial_outlier"))
