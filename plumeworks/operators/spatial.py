"""Spatial joins as equi joins on grid cells, refined by exact predicates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions import pairs as K
from ..functions import planar
from .graphs import cut_lineage
from .rows import fresh

#: Rows of which knn looks at all pairs.
FEW = 5000
#: Segments in a cell of nearest_segment, about, and points that one task takes of it.
CELL_SEGMENTS, SLICE = 4096, 50000
#: Rows of either side that one task of in_cells takes of a cell, about.
SIDE = 4096


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def cover(df: DataFrame, low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float, cx: str = "__cx", cy: str = "__cy") -> DataFrame:
    """A row for each grid cell that a bounding box touches, as ``cx, cy``."""
    wide = df.withColumn(cx, F.explode(F.sequence(cell(low_x, size), cell(high_x, size))))
    return wide.withColumn(cy, F.explode(F.sequence(cell(low_y, size), cell(high_y, size))))


def in_cells(left: DataFrame, right: DataFrame, size: float, run: Callable[[pa.Table, pa.Table, Iterator[tuple[np.ndarray, np.ndarray]], tuple[float, float]], Iterator[pa.Table]], kind: StructType) -> DataFrame:
    """What ``run`` makes of the pairs of rows whose boxes ``__x1, __y1, __x2, __y2`` meet, each pair once.

    The grid cells that a box touches deal the rows to tasks; a pair is found in the cell
    of the boxes' common corner. A cell of many rows is cut into slices of about SIDE,
    each slice of one side with each of the other. run has a slice's rows of both sides,
    blocks of numbers of the rows that are pairs, and the cell's corner.
    """
    at, box, arrow = ["__cx", "__cy"], ["__x1", "__y1", "__x2", "__y2"], to_arrow_schema(kind)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # left and right may be one table
    sides = [cover(df, *map(F.col, box), size) for df in (left, right)]
    slices = [s.groupBy(at).agg(F.ceil(F.count("*") / SIDE).alias(n)) for s, n in zip(sides, ("__m", "__n"))]
    of = slices[0].join(slices[1], at)
    by = [*at, "__s", "__t"]
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    dealt = []
    for side, mine, other, s, t in ((sides[0], "__m", "__n", "__s", "__t"), (sides[1], "__n", "__m", "__t", "__s")):
        cut = side.join(of, at).withColumn(s, F.pmod(F.xxhash64(*box), F.col(mine))).withColumn(t, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        dealt.append(cut.drop("__m", "__n").repartition(tasks, *by).groupBy(by))

    def pairs(key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:
        cx, cy = (k.as_py() for k in key[:2])
        boxes = [[t.column(c).to_numpy() for c in box] for t in (l, r)]
        first = lambda axis: [np.floor(b[axis] / size) == (cx, cy)[axis] for b in boxes]
        (a, b), (c, d) = first(0), first(1)
        found = K.boxes_that_meet(*boxes, a, b)
        # the corner's cell is the greater of both boxes' first cells, by either axis
        kept = ((i[some], j[some]) for i, j in found for some in [c[i] | d[j]])
        made = [t.select(arrow.names).cast(arrow) for t in run(l, r, kept, (cx * size, cy * size))]
        return pa.concat_tables(made) if made else arrow.empty_table()

    return dealt[0].cogroup(dealt[1]).applyInArrow(pairs, kind)


def within(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, size: float, how: str = "inner") -> DataFrame:
    """Points with the polygons that contain them; the cells of each polygon's box are the join key."""
    px, py, cx, cy, *box = fresh([*points.columns, *polygons.columns], "px", "py", "cx", "cy", "x1", "y1", "x2", "y2")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxed = polygons.withColumns(dict(zip(box, (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))))
    of = cover(boxed, *map(F.col, box), size, cx, cy)
    inside = F.col(x).between(F.col(box[0]), F.col(box[2])) & F.col(y).between(F.col(box[1]), F.col(box[3]))  # before the outline is looked at
    left = points.withColumns({px: cell(F.col(x), size), py: cell(F.col(y), size)})
    on = (F.col(px) == F.col(cx)) & (F.col(py) == F.col(cy)) & inside & G.contains(F.col(ring), F.col(x), F.col(y))
    return left.join(of, on, how).drop(px, py, cx, cy, *box)


def segments(lines: DataFrame, key: str, line: str) -> DataFrame:
    """``key, x1, y1, x2, y2``: a row for each step of each line."""
    pairs = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line) - 1).alias("b"))
    of = lines.where(F.size(line) > 1).select(key, F.posexplode(pairs).alias("n", "s"))
    return of.select(key, "n", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def nearest_segment(points: DataFrame, segs: DataFrame, point: str, key: str, x: str, y: str, size: float, place: bool = False) -> DataFrame:
    """``point, key, dist``: the nearest line of each point, ties to the smaller key; with ``place`` also ``px, py``, the nearest place on it.

    A task has a cell's points and the segments that come within an eighth of its width;
    what is found within somewhat less is certain. The width is that of about
    CELL_SEGMENTS segments in a cell, ``size`` at least and an eighth of a mean segment;
    for the points that are left it grows fourfold until it spans all segments, so no
    distance is too far. A cell of many points is cut into slices of about SLICE, each
    with the cell's segments; these fit a task. A null or NaN coordinate, or no segment
    at all, gives a null key and distance.
    """
    ends, kinds = ["x1", "y1", "x2", "y2"], {point: dict(points.dtypes)[point], key: dict(segs.dtypes)[key]}
    known = F.coalesce(~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")) & F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(False))
    more = ["px", "py"] if place else []
    none = [F.lit(None).cast(kinds[key]).alias(key), *[F.lit(None).cast("double").alias(c) for c in ("dist", *more)]]
    lost = points.where(~known).select(point, *none)
    found = segs.select(key, *ends).dropna()
    b = found.agg(F.max(F.greatest("x1", "x2")).alias("x"), F.min(F.least("x1", "x2")).alias("u"), F.max(F.greatest("y1", "y2")).alias("y"), F.min(F.least("y1", "y2")).alias("v"), F.count("*").alias("n"), F.avg(G.distance(*map(F.col, ends))).alias("l")).first()
    if not b.n:
        return lost.union(points.where(known).select(point, *none))
    todo = points.where(known).select(F.col(point).alias("__p"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    reach = todo.agg(F.max(F.abs("__x")) + F.max(F.abs("__y"))).first()[0] or 0.0
    last = 32 * (max(b.x - b.u, b.y - b.v) + abs(b.u) + abs(b.v) + reach + 1)
    size = min(max(size, b.l / 8, math.sqrt((b.x - b.u) * (b.y - b.v) * CELL_SEGMENTS / b.n)), last)
    out = None

    def run(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values([key, *ends], kind="stable")
        xy, of = mine[["__x", "__y"]].to_numpy(float), near[ends].to_numpy(float)
        which, dist = planar.nearest(xy, of)
        keys = near[key].reset_index(drop=True)
        got = mine[["__p", "__x", "__y"]].reset_index(drop=True)
        if not len(keys):
            return got.assign(**dict.fromkeys(["__k", "dist", *more]))
        px, py = planar.feet(xy, of[which])
        at = {"px": px, "py": py} if place else {}
        return got.assign(**{"__k": keys.take(which).reset_index(drop=True), "dist": dist} | at)

    while True:
        edge, certain, at = size / 8, size * 0.12, ["__cx", "__cy", "__s"]
        mine = todo.withColumns({"__cx": cell(F.col("__x"), size), "__cy": cell(F.col("__y"), size)})
        full = mine.groupBy("__cx", "__cy").agg(F.ceil(F.count("*") / SLICE).alias("__n")).where("__n > 1")  # at most a row for each SLICE points
        slices = lambda df: df.join(F.broadcast(full), ["__cx", "__cy"], "left").withColumn("__n", F.coalesce("__n", F.lit(1).cast("long")))
        mine = slices(mine).withColumn("__s", F.pmod(F.xxhash64("__p", "__x", "__y"), "__n")).drop("__n")
        wide = cover(found, F.least("x1", "x2") - edge, F.least("y1", "y2") - edge, F.greatest("x1", "x2") + edge, F.greatest("y1", "y2") + edge, size)
        # cells that the segment comes near: it is within half the diagonal of the widened cell from the middle
        wide = wide.where(G.to_segment((F.col("__cx") + 0.5) * size, (F.col("__cy") + 0.5) * size, *map(F.col, ends)) <= (size / 2 + edge) * 1.4143)
        wide = slices(wide).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
        schema = f"__p {kinds[point]}, __x double, __y double, __k {kinds[key]}, dist double" + "".join(f", {c} double" for c in more)
        got = cut_lineage(mine.groupBy(*at).cogroup(wide.groupBy(*at)).applyInPandas(run, schema))
        sure = got if size >= last else got.where(F.col("dist") <= certain)
        out = sure if out is None else out.union(sure)
        todo = got.where(F.col("dist").isNull() | (F.col("dist") > certain)).select("__p", "__x", "__y")
        if size >= last or not todo.limit(1).count():
            best = out.groupBy("__p").agg(F.min(F.struct("dist", F.col("__k").alias("k"), *more)).alias("b"))
            return lost.union(best.select(F.col("__p").alias(point), F.col("b.k").alias(key), F.col("b.dist").alias("dist"), *[f"b.{c}" for c in more]))
        size = min(4 * size, last)


def knn(df: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """``focal, neighbor, dist, rank``: the k nearest other rows, ties to the smaller key.

    Up to FEW rows every pair is looked at. Beyond, candidates come from the 3 x 3 cells
    around a point, about k points in a cell, and a point is settled when its k-th
    distance is within a cell's width; for the rest the width doubles until it spans all.
    Rows with a null coordinate take no part.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = df.agg(F.count("*").alias("n"), F.max(x).alias("x"), F.min(x).alias("u"), F.max(y).alias("y"), F.min(y).alias("v")).first()
    if b.n > FEW:
        one = df.select(F.col(key).alias("focal"), F.col(x).alias("__x"), F.col(y).alias("__y"))
        return _knn_by_cells(one, one.toDF("neighbor", "__u", "__v"), k, b)
    a = df.select(F.col(key).alias("focal"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    b = df.select(F.col(key).alias("neighbor"), F.col(x).alias("__u"), F.col(y).alias("__v"))
    d = G.distance(F.col("__x"), F.col("__y"), F.col("__u"), F.col("__v"))
    pairs = a.join(b, F.col("focal") != F.col("neighbor")).select("focal", "neighbor", d.alias("dist"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("focal").orderBy("dist", "neighbor"))).where(F.col("rank") <= k)


def _knn_by_cells(one: DataFrame, other: DataFrame, k: int, box, apart: bool = False) -> DataFrame:
    """``focal, neighbor, dist, rank``: of ``focal, __x, __y`` the k nearest of ``neighbor, __u, __v``, of other keys unless ``apart``; box: ``n`` rows of other, and the bounds of all."""
    wide = max(box.x - box.u, box.y - box.v) or 1.0
    size = max(math.sqrt((box.x - box.u) * (box.y - box.v) * (k + 1) / box.n), wide * (k + 1) / box.n)
    todo, out = one, None
    ring = F.array(*map(F.lit, (-1, 0, 1)))
    while True:
        cells = other.withColumns({"__cx": cell(F.col("__u"), size), "__cy": cell(F.col("__v"), size)})
        around = todo.withColumn("__cx", F.explode(F.transform(ring, lambda d: cell(F.col("__x"), size) + d)))
        around = around.withColumn("__cy", F.explode(F.transform(ring, lambda d: cell(F.col("__y"), size) + d)))
        d = G.distance(F.col("__x"), F.col("__y"), F.col("__u"), F.col("__v"))
        pairs = around.join(cells, ["__cx", "__cy"]).select("focal", "neighbor", d.alias("dist"))
        pairs = pairs if apart else pairs.where("focal <> neighbor")
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("focal").orderBy("dist", "neighbor"))).where(F.col("rank") <= k)
        if size < wide:  # a k-th neighbour within the width: none nearer is outside the cells looked at
            ranked = ranked.withColumn("__k", F.max(F.when(F.col("rank") == k, F.col("dist"))).over(W.partitionBy("focal"))).where(F.col("__k") <= size).drop("__k")
        sure = cut_lineage(ranked)
        out = sure if out is None else out.union(sure)
        if size >= wide:
            return out
        todo = cut_lineage(todo.join(sure.select("focal").distinct(), "focal", "left_anti"))
        if not todo.limit(1).count():
            return out
        size = min(2 * size, wide)


def distance_band(df: DataFrame, key: str, x: str, y: str, limit: float) -> DataFrame:
    """``focal, neighbor, dist`` of other rows within the limit, by cells of its width."""
    a = df.select(F.col(key).alias("focal"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    b = df.select(F.col(key).alias("neighbor"), F.col(x).alias("__u"), F.col(y).alias("__v")).withColumns({"__cx": cell(F.col("__u"), limit), "__cy": cell(F.col("__v"), limit)})
    ring = F.array(*map(F.lit, (-1, 0, 1)))
    a = a.withColumn("__cx", F.explode(F.transform(ring, lambda d: cell(F.col("__x"), limit) + d))).withColumn("__cy", F.explode(F.transform(ring, lambda d: cell(F.col("__y"), limit) + d)))
    d = G.distance(F.col("__x"), F.col("__y"), F.col("__u"), F.col("__v"))
    return a.join(b, ["__cx", "__cy"]).where(F.col("focal") != F.col("neighbor")).select("focal", "neighbor", d.alias("dist")).where(F.col("dist") <= limit)


def in_box(df: DataFrame, box: DataFrame, x: str, y: str, bx: str, by: str) -> DataFrame:
    """Rows inside the bounding box of another table's points, which is one row."""
    b = box.agg(F.min(bx).alias("__a"), F.max(bx).alias("__b"), F.min(by).alias("__c"), F.max(by).alias("__d"))
    return df.join(F.broadcast(b), F.col(x).between(F.col("__a"), F.col("__b")) & F.col(y).between(F.col("__c"), F.col("__d"))).drop("__a", "__b", "__c", "__d")


def row_standardized(weights: DataFrame) -> DataFrame:
    """``focal, neighbor, w``: equal weights that sum to 1 for each focal row."""
    return weights.select("focal", "neighbor", (1 / F.count("*").over(W.partitionBy("focal"))).alias("w"))


def spatial_lag(weights: DataFrame, df: DataFrame, key: str, value: str, out: str = "lag") -> DataFrame:
    """``key, lag``: each row's weighted sum of its neighbours' values."""
    of = weights.join(df.select(F.col(key).alias("neighbor"), F.col(value).alias("__v")), "neighbor")
    return of.groupBy(F.col("focal").alias(key)).agg(F.sum(F.col("w") * F.col("__v")).alias(out))


def idw(known: DataFrame, unknown: DataFrame, key: str, x: str, y: str, value: str, k: int = 5, power: float = 2.0, few: int = FEW) -> DataFrame:
    """``key, value``: each unknown row's inverse-distance mean of its k nearest known rows; a distance of 0 counts as 1e-12.

    Up to ``few`` known rows are each held against every unknown one; more are found by
    grid cells, as in knn. Rows with a null coordinate take no part, and without known
    rows there is no result.
    """
    placed = lambda df: df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = placed(known).select(F.col(key).alias("neighbor"), F.col(x).alias("__u"), F.col(y).alias("__v"), F.col(value).alias("__w"))
    a = placed(unknown).select(F.col(key).alias("focal"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    n = b.count()
    if n > few:
        every = b.select("__u", "__v").union(a.select("__x", "__y"))
        box = every.agg(F.max("__u").alias("x"), F.min("__u").alias("u"), F.max("__v").alias("y"), F.min("__v").alias("v"), F.lit(n).alias("n")).first()
        near = _knn_by_cells(a, b.drop("__w"), k, box, apart=True).join(b.select("neighbor", "__w"), "neighbor").withColumn("d", F.greatest("dist", F.lit(1e-12)))
    else:
        d = F.greatest(G.distance(F.col("__x"), F.col("__y"), F.col("__u"), F.col("__v")), F.lit(1e-12))
        pairs = a.join(b, F.lit(True)).select("focal", "neighbor", "__w", d.alias("d"))
        near = pairs.withColumn("r", F.row_number().over(W.partitionBy("focal").orderBy("d", "neighbor"))).where(F.col("r") <= k)
    weight = 1 / F.pow("d", F.lit(power))
    return near.groupBy(F.col("focal").alias(key)).agg((F.sum(F.col("__w") * weight) / F.sum(weight)).alias(value))
