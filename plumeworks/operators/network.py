"""Map matching on a road network without a service: a snap to the nearest road, and a hidden Markov model over candidate segments.

The model is that of Newson and Krumm: a point is emitted by a segment with a normal
error of its distance, and two points in a row are the likelier the less the way along
the roads differs from the straight line between them. The most likely sequence of
segments is found for each chunk of a trajectory in one task, which gets only the
segments in the cells along the chunk's way.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import planar
from .spatial import cell, cover, nearest_segment, segments

#: Decimal places to which segment ends are rounded when they are taken for the same junction.
PLACES = 3


@dataclass(frozen=True)
class Model:
    """radius: candidates of a point are the segments within it. sigma: standard error of a point in metres. beta: mean difference of way and straight line.

    Ways of more than ``detour`` straight lines and four radii are not looked for.
    """

    radius: float = 50.0
    sigma: float = 5.0
    beta: float = 5.0
    detour: float = 3.0


def snap_to_roads(points: DataFrame, roads: DataFrame, point: str, key: str, line: str, x: str = "x", y: str = "y", size: float = 1000.0) -> DataFrame:
    """``point, key, dist, px, py``: the nearest road of each point, ties to the smaller key, and the place on it; nulls as in nearest_segment."""
    return nearest_segment(points, segments(roads, key, line), point, key, x, y, size, place=True)


class Roads:
    """Segments ``(n, 4)`` as a graph: ends that agree when rounded are one junction, and every segment is taken both ways."""

    def __init__(self, segs: np.ndarray):
        self.segs, self.length = segs, np.hypot(segs[:, 2] - segs[:, 0], segs[:, 3] - segs[:, 1])
        _, node = np.unique(np.r_[segs[:, :2], segs[:, 2:]].round(PLACES) + 0.0, axis=0, return_inverse=True)
        self.ends = node.reshape(2, -1).T
        self._ends, self._length = self.ends.tolist(), self.length.tolist()
        self.out: dict[int, list[tuple[int, float]]] = {}
        for (u, v), n in zip(self.ends.tolist(), self.length.tolist()):
            self.out.setdefault(u, []).append((v, n))
            self.out.setdefault(v, []).append((u, n))
        self.known: dict[int, tuple[float, dict[int, float]]] = {}

    def ways(self, start: int, limit: float) -> dict[int, float]:
        """Shortest ways from a junction to those within the limit."""
        if start in self.known and self.known[start][0] >= limit:
            return self.known[start][1]
        best, heap = {}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in best:
                continue
            best[u] = d
            for v, n in self.out[u]:
                if v not in best and d + n <= limit:
                    heapq.heappush(heap, (d + n, v))
        self.known[start] = limit, best
        return best

    def way(self, a: tuple, b: tuple, limit: float) -> float:
        """The way between places (segment, metres from its first end) along the roads; infinite beyond the limit."""
        (i, s), (j, t) = a[:2], b[:2]
        best = abs(s - t) if i == j else math.inf
        for u, leave in zip(self._ends[i], (s, self._length[i] - s)):
            if leave <= limit:
                known = self.ways(u, limit)
                for v, enter in zip(self._ends[j], (t, self._length[j] - t)):
                    best = min(best, leave + known.get(v, math.inf) + enter)
        return best if best <= limit else math.inf


def layers(xy: np.ndarray, roads: Roads, model: Model) -> list[list[tuple[int, float, float]]]:
    """For each point its candidates (segment, metres from its first end, distance) in the order of segments."""
    out: list[list] = [[] for _ in xy]
    usable = np.flatnonzero(np.isfinite(xy).all(1))
    p, s, d = planar.within(xy[usable], roads.segs, model.radius)
    px, py = planar.feet(xy[usable[p]], roads.segs[s])
    along = np.hypot(px - roads.segs[s, 0], py - roads.segs[s, 1])
    for k in np.lexsort((s, p)):
        out[usable[p[k]]].append((int(s[k]), float(along[k]), float(d[k])))
    return out


def viterbi(xy: np.ndarray, roads: Roads, model: Model, of: list[list[tuple]] | None = None) -> list[tuple | None]:
    """The candidate of each point in the likeliest sequence; None for points without candidates, which the sequence leaves out.

    Where no candidate of a point can be reached from those before, a new sequence
    begins. Of equally likely sequences the one with earlier segments is taken.
    """
    of = layers(xy, roads, model) if of is None else of
    out: list[tuple | None] = [None] * len(xy)
    steps: list[tuple[int, list[float], list[int]]] = []  # (point, costs, the candidate before) of the sequence so far

    def settle() -> None:
        if steps:
            k = int(np.argmin(steps[-1][1]))
            for i, _, before in reversed(steps):
                out[i], k = of[i][k], before[k]
            steps.clear()

    for i, mine in enumerate(of):
        if not mine:
            continue
        emit = [0.5 * (d / model.sigma) ** 2 for *_, d in mine]
        if steps:
            j, costs, _ = steps[-1]
            straight = math.dist(xy[i], xy[j])
            limit = model.detour * straight + 4 * model.radius
            total, before = [], []
            for b, e in zip(mine, emit):
                each = [c + abs(roads.way(a, b, limit) - straight) / model.beta for a, c in zip(of[j], costs)]
                k = int(np.argmin(each))
                total.append(each[k] + e)
                before.append(k)
            if min(total) < math.inf:
                steps.append((i, total, before))
                continue
            settle()
        steps.append((i, emit, [0] * len(mine)))
    settle()
    return out


def _corridors(points: DataFrame, chunk: str, order: list[str], x: str, y: str, width: float) -> DataFrame:
    """``chunk, __cx, __cy``: the cells along each chunk's way, and those around them."""
    w = W.partitionBy(chunk).orderBy(*order)
    step = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(chunk, F.col(x).alias("x"), F.col(y).alias("y"), F.coalesce(F.lead(x).over(w), F.col(x)).alias("u"), F.coalesce(F.lead(y).over(w), F.col(y)).alias("v"))
    n = F.ceil(F.sqrt(F.pow(F.col("u") - F.col("x"), 2) + F.pow(F.col("v") - F.col("y"), 2)) / width).cast("int")
    part = step.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.coalesce(F.try_divide("t", "n"), F.lit(0.0)))
    middle = part.select(chunk, cell(F.col("x") + (F.col("u") - F.col("x")) * F.col("t"), width).alias("cx"), cell(F.col("y") + (F.col("v") - F.col("y")) * F.col("t"), width).alias("cy")).distinct()
    around = F.array(*[F.struct((F.col("cx") + i).alias("__cx"), (F.col("cy") + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return middle.select(chunk, F.explode(around).alias("c")).select(chunk, "c.*").distinct()


def match_to_roads(points: DataFrame, roads: DataFrame, chunk: str, order: list[str], key: str, line: str, x: str = "x", y: str = "y", model: Model = Model(), width: float = 500.0) -> DataFrame:
    """The points with ``road, matched_x, matched_y, match_dist``: where the likeliest sequence of roads has them, nulls where no road is within the radius.

    points: rows of a plane in metres in chunks that fit a task, as chunk_ids makes them;
    ties in ``order`` should be settled by a key in it. roads: ``key, line``. A way that
    leaves the cells of ``width`` along the chunk, and the cells around these, is not
    found. A null coordinate is a point without candidates; repeated points are points
    of their own; without roads all are unmatched. Columns of points by the four names
    are replaced. Segments with the same ends, in either direction, are one way: that of
    the smallest key and, in it, the earliest.
    """
    new = ["road", "matched_x", "matched_y", "match_dist"]
    points = points.drop(*new)
    kind, ends = dict(roads.dtypes)[key], ["x1", "y1", "x2", "y2"]
    segs = segments(roads, key, line).select(F.col(key).alias("__k"), "n", *ends).dropna()
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    segs = segs.groupBy(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).agg(F.min(F.struct("__k", "n", *ends)).alias("s")).select("s.*")
    wide = cover(segs, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), width)
    near = _corridors(points, chunk, order, x, y, width).join(wide, ["__cx", "__cy"]).select(F.col(chunk).alias("__chunk"), "__k", "n", *ends).distinct()

    def run(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(order, kind="stable").reset_index(drop=True)
        other = other.sort_values(["__k", "n"], kind="stable").reset_index(drop=True)
        if not len(mine):
            return mine.assign(**dict.fromkeys(new))
        net, xy = Roads(other[ends].to_numpy(float)), mine[[x, y]].to_numpy(float)
        found = viterbi(xy, net, model) if len(other) else [None] * len(mine)
        rows = []
        for f in found:
            if f is None:
                rows.append((None, None, None, None))
                continue
            (x1, y1, x2, y2), t = net.segs[f[0]], f[1] / net.length[f[0]] if net.length[f[0]] else 0.0
            rows.append((other["__k"][f[0]], x1 + (x2 - x1) * t, y1 + (y2 - y1) * t, f[2]))
        return mine.assign(**{n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(new)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + f", road {kind}, matched_x double, matched_y double, match_dist double"
    return points.groupBy(chunk).cogroup(near.groupBy("__chunk")).applyInPandas(run, schema)
