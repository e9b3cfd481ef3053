import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeworks.config import PRESETS
from plumeworks.functions import planar, projection
from plumeworks.operators import matching, network

LINE = "line array<struct<x:double,y:double>>"


def floyd(segs):
    """All ways between junctions, and the junctions of each segment's ends."""
    nodes = sorted({tuple(np.round(p, 3)) for s in segs for p in (s[:2], s[2:])})
    d = np.full((len(nodes),) * 2, math.inf)
    np.fill_diagonal(d, 0)
    ends = [tuple(nodes.index(tuple(np.round(p, 3))) for p in (s[:2], s[2:])) for s in segs]
    for (u, v), s in zip(ends, segs):
        d[u, v] = d[v, u] = min(d[u, v], math.dist(s[:2], s[2:]))
    for k in range(len(nodes)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d, ends


@pytest.mark.parametrize("seed", range(12))
def test_likeliest_sequence_is_that_of_enumeration(seed):
    rnd = np.random.default_rng(seed)
    nodes = rnd.uniform(0, 60, (6, 2))
    segs = np.array([[*nodes[a], *nodes[b]] for a, b in itertools.combinations(range(6), 2) if rnd.random() < 0.5] or [[0.0, 0.0, 1.0, 1.0]])
    model = network.Model(radius=18.0, sigma=4.0, beta=3.0, detour=2.0)
    xy = rnd.uniform(0, 60, (5, 2))
    xy[3] = xy[2] if seed % 3 == 0 else xy[3]  # a repeated point
    roads = network.Roads(segs)
    of = network.layers(xy, roads, model)
    for p, cands in zip(xy, of):
        near = planar.to_segments(p[0], p[1], segs)
        assert [c[0] for c in cands] == np.flatnonzero(near <= 18.0).tolist() and np.allclose([c[2] for c in cands], near[near <= 18.0])
    d, ends = floyd(segs)
    size = [math.dist(s[:2], s[2:]) for s in segs]

    def way(a, b, limit):
        (i, s, _), (j, t, _) = a, b
        each = [abs(s - t) if i == j else math.inf] + [x + d[u, v] + y for u, x in zip(ends[i], (s, size[i] - s)) for v, y in zip(ends[j], (t, size[j] - t))]
        return min(each) if min(each) <= limit + 1e-9 else math.inf

    def cost(seq):
        total = sum(0.5 * (c[2] / 4.0) ** 2 for _, c in seq)
        for (i, a), (j, b) in zip(seq, seq[1:]):
            straight = math.dist(xy[i], xy[j])
            total += abs(way(a, b, 2.0 * straight + 72.0) - straight) / 3.0
        return total

    got = network.viterbi(xy, roads, model, of)
    assert [g is None for g in got] == [not c for c in of]
    seen = [i for i, c in enumerate(of) if c]
    best = min((cost(list(zip(seen, seq))) for seq in itertools.product(*(of[i] for i in seen))), default=0.0)
    if best < math.inf:
        assert math.isclose(cost([(i, got[i]) for i in seen]), best, rel_tol=1e-9, abs_tol=1e-9)


def test_a_trace_stays_on_its_road(spark):
    """The cross street is nearer to the third point; a point far from all roads, one without a place, an empty table, clashing names."""
    roads = [(1, [(0.0, 0.0), (100.0, 0.0), (200.0, 0.0)]), (2, [(100.0, -100.0), (100.0, 0.0 + 4e-4), (100.0, 100.0)]), (3, [(900.0, 900.0), (901.0, 900.0)])]
    points = [(0, 20.0, 3.0), (1, 60.0, -3.0), (2, 101.0, 6.0), (3, 140.0, 2.0), (4, 500.0, 500.0), (5, None, 1.0), (6, 180.0, -1.0), (6, 180.0, -1.0)]
    lines = spark.createDataFrame(roads, f"id long, {LINE}")
    df = spark.createDataFrame([(*p, "c", "other", 1) for p in points], "i long, x double, y double, chunk string, road string, n int")
    got = sorted((r.i, r.road, r.matched_x, r.matched_y) for r in network.match_to_roads(df, lines, "chunk", ["i"], "id", "line").collect())
    assert got == [(0, 1, 20.0, 0.0), (1, 1, 60.0, 0.0), (2, 1, 101.0, 0.0), (3, 1, 140.0, 0.0), (4, None, None, None), (5, None, None, None), (6, 1, 180.0, 0.0), (6, 1, 180.0, 0.0)]
    near = {r.i: (r.id, r.px, r.py, r.dist) for r in network.snap_to_roads(df.where("i < 6"), lines, "i", "id", "line").collect()}
    assert near[2][:2] == (2, 100.0) and near[2][2:] == pytest.approx((6.0, 1.0)) and near[0] == (1, 20.0, 0.0, 3.0) and near[5] == (None, None, None, None)
    assert network.match_to_roads(df.limit(0), lines, "chunk", ["i"], "id", "line").count() == 0
    assert network.match_to_roads(df, lines.limit(0), "chunk", ["i"], "id", "line").where("road IS NULL").count() == 8


def test_days_are_matched_on_the_ways(spark):
    east, north = 709000.0, 736000.0
    p = lambda x, y: {"x": east + x, "y": north + y}
    flat = spark.createDataFrame([(1, [p(0, 0), p(100, 0), p(200, 0)]), (2, [p(100, -100), p(100, 0), p(100, 100)])], f"id long, {LINE}")
    to_degrees = lambda x, y: projection.from_grid(x, y, "EPSG:2157")
    ways = flat.select("id", F.transform("line", lambda q: F.struct(to_degrees(q["x"], q["y"])[0].alias("x"), to_degrees(q["x"], q["y"])[1].alias("y"))).alias("line"))
    rows = [(0, 20.0, 3.0), (1, 60.0, -3.0), (2, 101.0, 6.0), (3, 140.0, 2.0), (4, 140.0, 900.0)]
    lon, lat = to_degrees(F.col("x") + east, F.col("y") + north)
    df = spark.createDataFrame(rows, "id long, x double, y double").select("id", F.lit("a").alias("car"), F.timestamp_seconds(1704067200 + F.col("id") * 5).alias("gps_timestamp"), lon.alias("longitude"), lat.alias("latitude"))

    def at(**settings):
        got = matching.match_days(df, ["car"], "id", None, replace(PRESETS["base"], **settings), ways)
        x, y = projection.to_grid(F.col("matched_lon"), F.col("matched_lat"), "EPSG:2157")
        assert got.columns == [*df.columns, "matched_lon", "matched_lat"]
        return {r.id: (round(r.x - east, 2), round(r.y - north, 2)) for r in got.select("id", x.alias("x"), y.alias("y")).collect()}

    assert at() == {0: (20, 0), 1: (60, 0), 2: (101, 0), 3: (140, 0), 4: (140, 900)}
    assert at(match_by="snap") == {0: (20, 0), 1: (60, 0), 2: (100, 6), 3: (140, 0), 4: (140, 900)}
    assert at(match_by="none") == {i: (x, y) for i, x, y in rows}


def test_repeated_segments_are_one_way(spark):
    """With copies as roads of their own, a change to a copy at the road's end comes nearer to the straight line than going on."""
    there, back = [(0.0, 0.0), (100.0, 0.0)], [(100.0, 0.0), (0.0, 0.0)]
    roads = spark.createDataFrame([(k, there if k % 2 else back) for k in range(1, 40)], f"id long, {LINE}")
    points = spark.createDataFrame([(0, "c", 10.0, 5**0.5), (1, "c", 0.5, -(5**0.5))], "i long, chunk string, x double, y double")
    got = sorted((r.i, r.road, r.matched_x, r.matched_y) for r in network.match_to_roads(points, roads, "chunk", ["i"], "id", "line").collect())
    assert got == [(0, 1, 10.0, 0.0), (1, 1, 0.5, 0.0)]
