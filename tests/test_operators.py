import http.server
import json
import math
import sqlite3
import struct
import threading
import zlib
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from plumeworks.functions import geometry as G
from plumeworks.functions import planar, projection
from plumeworks.functions import strings as S
from plumeworks.config import PRESETS
from plumeworks.operators import covariates, figures, graphs, matching, nodes, outliers, quantiles, roads, spatial, stats, traffic, units
from plumeworks.operators import timeseries as T
from plumeworks.plans import pipelines
from plumeworks.sources import files
from plumeworks.streaming import windows


def at(s):
    return F.timestamp_seconds(F.lit(s))


def series(spark, rows):
    return spark.createDataFrame(rows, "id long, t long, v double").select("id", F.timestamp_seconds("t").alias("ts"), "v", F.lit("a").alias("car"))


def test_gap_split(spark):
    df = series(spark, [(i, t, 1.0) for i, t in enumerate((0, 60, 180, 301, 421))])
    assert [r.traj for r in T.split_by_gaps(df, "ts", 120, ["car"], "id").orderBy("id").collect()] == ["0", "0", "0", "1", "1"]


def test_hampel(spark):
    df = series(spark, [(i, i, float(v)) for i, v in enumerate((1, 2, 3, 100, 4, 5, 6))])
    assert [r.hampel for r in T.hampel(df, "v", ["car"], ["ts"], 5).orderBy("id").collect()] == [k == 3 for k in range(7)]
    holed = series(spark, [(0, 0, 1.0), (1, 1, 2.0), (2, 2, None), (3, 3, 100.0), (4, 4, 4.0)])
    assert not any(r.hampel for r in T.hampel(holed, "v", ["car"], ["ts"], 5).collect())


def test_rate_of_change(spark):
    df = series(spark, [(0, 0, 1.0), (1, 10, 2.0), (2, 20, 2.0), (3, 30, 12.0)])
    assert [r.roc for r in T.rate_of_change(df, "ts", "v", ["car"], "id").orderBy("id").collect()] == [False, False, False, True]


def test_chunk_sizes():
    assert [T.chunk_sizes(n) for n in (5000, 10667, 16005, 20000, 32000)] == [[5000], [5333, 5334], [8000, 4002, 4003], [8000, 8000, 4000], [8000] * 4]


def test_chunks_are_where_the_sizes_say(spark):
    for most, least in ((12, 3), (10, 4), (9, 1)):
        sizes = [n for n in range(1, 60)]
        df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long")
        got = {}
        for r in T.chunk_ids(df, ["n"], ["i"], most, least).collect():
            got.setdefault(r.n, {}).setdefault(int(r.chunk.split("_")[1]), 0)
            got[r.n][int(r.chunk.split("_")[1])] += 1
        assert {n: [c for _, c in sorted(got[n].items())] for n in sizes} == {n: [s for s in T.chunk_sizes(n, most, least) if s] for n in sizes}
    try:
        T.hampel(df.withColumn("v", F.lit(1.0)), "v", ["n"], ["i"], 4)
        raise AssertionError
    except ValueError:
        pass


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "a long, b long").repartition(7)
    assert [(r.a, r.obsID) for r in T.dense_ids(df, ["a", "b"]).orderBy("a").collect()] == [(i, i) for i in range(1000)]


def test_nearest_segment_nulls_and_no_segments(spark):
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, 5e6, -3e6)], "p long, x double, y double")
    s = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 0.0), (8, 0.0, 5.0, 10.0, 5.0)], "k long, x1 double, y1 double, x2 double, y2 double")
    got = {r.p: (r.k, r.dist) for r in spatial.nearest_segment(p, s, "p", "k", "x", "y", 1.0).collect()}
    assert got[1] == (7, 1.0) and got[2] == (None, None) and got[3][0] == 7
    assert [(r.k, r.dist) for r in spatial.nearest_segment(p, s.limit(0), "p", "k", "x", "y", 1.0).collect()] == [(None, None)] * 3


def test_nearest_segment_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_SEGMENTS", 30)
    monkeypatch.setattr(spatial, "SLICE", 40)
    monkeypatch.setattr(planar, "PAIRS", 64)
    rng = np.random.default_rng(6)
    s = np.round(rng.uniform(0, 1000, (300, 4)), 0)
    s[:250, 2:] = s[:250, :2] + np.round(rng.normal(size=(250, 2)) * 9)
    xy = np.vstack([rng.uniform(0, 1000, (400, 2)), np.round(rng.normal(size=(300, 2))) + 500, rng.normal(size=(20, 2)) * 9e4, [[math.nan, 1.0]]])
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xy)], "p long, x double, y double")
    segs = spark.createDataFrame([(f"s{i:03}", *map(float, r)) for i, r in enumerate(s)], "k string, x1 double, y1 double, x2 double, y2 double").repartition(5)
    got = {r.p: (r.k, r.dist) for r in spatial.nearest_segment(p, segs, "p", "k", "x", "y", 5.0).collect()}
    d = planar.to_segments(xy[:, :1], xy[:, 1:], s[None])
    assert len(got) == 721 and got[720] == (None, None)
    assert all(got[i] == (f"s{d[i].argmin():03}", d[i].min()) for i in range(720))


def test_names_of_presets_and_types(spark):
    h = PRESETS["hamburg"]
    of = spark.createDataFrame([(1, "Obere Königsstraße"), (2, "Obere Haupt Straße.")], "k long, name string")
    got = {r.k: r.n for r in of.select("k", S.road_names(F.array("name"), list(h.directions), dict(h.abbreviations), list(h.road_words)).alias("n")).collect()}
    assert got == {1: ["königsstraße"], 2: ["haupt"]}
    typed = S.correct_types(spark.createDataFrame([("1", "2.5", "x"), ("none", "3", "4")], "a string, b string, c string"), ["a", "b", "c"])
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string"] and sorted((r.a or 0, r.b) for r in typed.collect()) == [(0, 3.0), (1, 2.5)]
    assert S.short_names(spark.createDataFrame([(1,)], "road_length_m long")).columns == ["road_len"]
    assert {(r.kind, r.n) for r in S.kinds_of(spark.createDataFrame([("1",), ("a",), ("b",)], "v string"), "v").collect()} == {("integer", 1), ("string", 2)}


def test_units_connected_and_aggregated(spark, tmp_path):
    box = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    u = spark.createDataFrame([(k, box(x)) for k, x in ((1, 0.0), (2, 1.0), (3, 5.0))], "unit long, ring array<struct<x:double,y:double>>")
    assert {r.unit for r in nodes.connected_units(u, "unit", "ring").collect()} == {1, 2}
    assert {r.unit for r in nodes.connected_units(u, "unit", "ring", 1.5).collect()} == {1, 2, 3}
    p = spark.createDataFrame([(i, i * 3600, x, 0.5, float(i)) for i, x in enumerate((0.5, 0.6, 1.5))], "id long, t long, x double, y double, v double").withColumn("ts", F.timestamp_seconds("t"))
    assert {(r.unit, r.v) for r in nodes.aggregate_to_units(p, "district", "ts", "v", size=1.0, shapes=u).collect()} == {(1, 0.5), (2, 2.0)}
    road = spark.createDataFrame([(9, [(0.0, 0.0), (9.0, 0.0)])], "unit long, line array<struct<x:double,y:double>>")
    assert [(r.unit, r.v) for r in nodes.aggregate_to_units(p, "road", "ts", "v", size=1.0, shapes=road, shape="line").collect()] == [(9, 1.0)]
    assert nodes.aggregate_to_units(p, "hexagon", "ts", "v", size=100.0).count() == 1
    T.split_by_date(p, "ts", str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 3


def test_outlier_node(spark):
    rows = [(i, i * 10, float(i % 3), 0.0 if i != 20 else 90.0) for i in range(40)]
    p = spark.createDataFrame(rows, "k long, t long, x double, v double").select("k", F.timestamp_seconds("t").alias("ts"), "x", "v", F.lit("a").alias("car"))
    clean, out = nodes.outlier_detection(p, "k", "ts", "v", ["car"], ["x", "v"], choices=(5,), window=5)
    flags = {r.k: (r.is_temporal_outlier, r.is_spatial_outlier) for r in out.collect()}
    assert flags[20][1] and clean.count() == 40 - sum(a and b for a, b in flags.values())


def test_roads_closed_same_and_proximity(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring, "circular"), (2, ring[::-1], None), (3, ring[:2], "x")], "k long, line array<struct<x:double,y:double>>, junction string")
    assert [r.c for r in df.select(roads.is_closed(F.col("line")).alias("c")).collect()] == [True, True, False]
    assert [(r.a, r.b) for r in roads.same_lines(df, "k", "line").collect()] == [(1, 2)]
    assert tuple(x.count() for x in roads.split_junctions(df)) == (1, 2)
    segs = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 1.00005, 0.0, 2.0, 0.0), (3, 2.1, 0.0, 3.0, 0.0)], "k long, x1 double, y1 double, x2 double, y2 double")
    assert {r.node: r.component for r in roads.proximity_merge(segs, "k").collect()} == {1: 1, 2: 1, 3: 3}


def test_figure_data(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(12)], "k long, v double, w double")
    assert {r["class"] for r in figures.covariate_map(df, "k", "v", 3).collect()} == {0, 1, 2}
    local = df.select("k", (F.col("v") - 5.5).alias("z"), (F.col("v") - 5.5).alias("lag_z"), F.col("v").alias("moran"), F.lit(1).alias("quadrant"))
    m = figures.local_moran_map(local, df.select("k", F.lit(0.01).alias("p")), "k").collect()
    assert {r.cluster for r in m} == {"HH"} and {r["class"] for r in m} == {0, 1, 2, 3, 4}
    fit = stats.GWR(df.withColumns({"x": F.col("v"), "y": F.lit(0.0)}), "k", "x", "y", "v", ["w"], "gaussian").fit(10)
    of = stats.GWR(df.withColumns({"x": F.col("v"), "y": F.lit(0.0)}), "k", "x", "y", "v", ["w"], "gaussian").local(10)
    c = figures.coefficient_map(of, "k", 1, fit["rss"], 12, fit["trace"], 2).collect()
    assert len(c) == 12 and all(r.masked <= r.masked_corrected for r in c)
    assert abs(sum(r.residual**2 for r in figures.residuals(of, df, "k", "v").collect()) - fit["rss"]) < 1e-6
    assert abs(stats.t_limit(0.05, 10) - 2.228139) < 1e-5
    assert figures.bandwidths({"global_bandwidth": 9, "gwr_bandwidth": 4, "bandwidths": {"intercept": 3, "w": 5}}, ["w"]) == [("intercept", 9, 4, 3), ("w", 9, 4, 5)]
    k, found = stats.search_k(df.withColumn("y", F.lit(0.0)), "k", "v", "y", "v", range(2, 4), 99)
    assert k in found and set(found) == {2, 3}


def test_typical_day_and_sampling(spark):
    df = spark.createDataFrame([("u", 0, 1.0), ("u", 1, 3.0), ("u", 86400, 10.0)], "u string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    assert units.typical_day_mean(df, "u", "ts", "v").first().v == 6.0
    many = spark.createDataFrame([(k, 1.0) for k in (1, 2, 3, 4) for _ in range(k)], "u long, v double")
    assert {r.u for r in units.well_sampled(many, "u", "v", 0.25).collect()} == {2, 3, 4}
    assert units.well_sampled(many, "u", "v", None).count() == 10


def test_idw(spark):
    known = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 3.0, 4.0, 20.0)], "k long, x double, y double, v double")
    assert abs(spatial.idw(known, spark.createDataFrame([(3, 0.0, 1.0)], "k long, x double, y double"), "k", "x", "y", "v").first().v - 10.5263157895) < 1e-9


def test_measures(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])
    r = spark.range(1).select(G.area(ring).alias("a"), G.length(ring).alias("p"), G.contains(ring, F.lit(5.0), F.lit(5.0)).alias("i"), G.contains(ring, F.lit(15.0), F.lit(5.0)).alias("o"), G.compactness(F.lit(40.0), F.lit(100.0), F.lit(10.0)).alias("c"), G.fractal_dimension(F.lit(40.0), F.lit(100.0)).alias("f")).first()
    assert (r.a, r.p, r.i, r.o, round(r.c, 6), round(r.f, 6)) == (100.0, 40.0, True, False, 5.0, 1.0)


def test_names_and_classes(spark):
    one = spark.range(1).select(S.remove_words(S.standardize_name(F.lit("Upper St. Patrick's Ave."))).alias("n"), S.road_class(F.array(F.lit("primary_link"), F.lit("residential"))).alias("m"), S.road_class(F.array(F.lit("residential"))).alias("l"), S.class_name(F.lit("Discontinuous dense urban fabric (S.L. : 50% -  80%)")).alias("c")).first()
    assert (one.n, one.m, one.l, one.c) == ("patricks", "major_road", "low_access", "discontinuous_dense_urban_fabric_sl_50_80")
    assert S.column_name("Discontinuous dense urban fabric (S.L. : 50% -  80%)") == one.c


def test_street_graph_and_components(spark):
    e = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 1, 3), ("o", 1, 2), ("s", 1, 1)], "u string, a long, b long")
    got = {r.u: (r.connectivity, r.meshedness) for r in graphs.street_measures(e, "u").collect()}
    assert got["t"] == (2.0, 1.0) and got["o"][0] == 1.0 and abs(got["o"][1]) == 0.0 and got["s"][0] == 2.0 and abs(got["s"][1] + 1 / 3) < 1e-12
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.component) for r in graphs.connected_components(path).collect()} == {0, 100}
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"])], "k long, i array<string>")
    assert sorted(tuple(r["items"]) for r in graphs.merge_lists(lists, "k", "i").collect()) == [("a", "b", "c"), ("d",)]


def test_bearing_split_and_cut():
    assert [roads.bearing((0, 0), p) for p in ((0, 1), (1, 0), (-1, 0))] == [0, 90, 270]
    assert roads.split_by_bearing([(0, 0), (0, 10), (10, 10)]) == [[(0, 0), (0, 10)], [(0, 10), (10, 10)]]
    near_north = [(0, 0), (math.sin(math.radians(350)), math.cos(math.radians(350)))]
    near_north.append((near_north[1][0] + math.sin(math.radians(10)), near_north[1][1] + math.cos(math.radians(10))))
    assert len(roads.split_by_bearing(near_north)) == 1
    parts = roads.split_by_length([(0.0, 0.0), (400.0, 0.0)])
    assert [round(roads.length(p)) for p in parts] == [150, 150, 100]
    assert roads.cut_road([(0, 0), (5, 0)]) == []


def test_clipping():
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert sum(map(roads.length, roads.clip_line([(-1, 1), (3, 1)], square))) == 2
    assert roads.clip_polygon([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], square)[:-1] and roads.clip_polygon([(5, 5), (6, 5), (6, 6), (5, 5)], square) == []


def test_profile_raster_adjacency(spark):
    streets = spark.createDataFrame([("u", 0.0, 0.0, 100.0, 0.0)], "u string, x1 double, y1 double, x2 double, y2 double")
    walls = spark.createDataFrame([(-5.0, 10.0, 105.0, 10.0, 12.0), (-5.0, -8.0, 105.0, -8.0, 12.0)], "x1 double, y1 double, x2 double, y2 double, height double")
    p = roads.street_profile(streets, walls, "u").first()
    assert round(p.width, 6) == 18 and p.openness == 0 and p.height == 12
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (0, 2, 2.0), (2, 0, None)], "row int, col int, value double")
    assert sorted(r["count"] for r in roads.raster_regions(px).groupBy("region").count().collect()) == [1, 3]
    edges = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 0.0), (3, 9.0, 9.0, 9.0, 8.0)], "k long, x1 double, y1 double, x2 double, y2 double")
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 10.0, 0.0)], "k long, x double, y double")
    assert all(abs(r.adjacency - 2 / 3) < 1e-12 for r in roads.building_adjacency(edges, c, "k").collect())


def test_moran_and_vif(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 3.0, 6.0), (3, 7.0, 7.0)], "k long, x double, v double").withColumn("y", F.lit(0.0))
    got = stats.local_moran(df, "k", "v", spatial.knn(df, "k", "x", "y", 1)).orderBy("k").collect()
    assert [round(r.moran, 6) for r in got] == [0.692308, 0.692308, -0.461538, 0.692308] and [r.quadrant for r in got] == [3, 3, 4, 1]
    a = np.array([1.0, -1, 1, -1, 1, -1, 1, -1])
    b = np.array([1.0, 1, 1, -1, 1, -1, -1, -1])
    assert round(np.corrcoef(a, b)[0, 1], 6) == 0.5
    pair = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    assert all(abs(v - 4 / 3) < 1e-9 for v in covariates.variance_inflation(pair, ["a", "b"]).values())
    assert abs(stats.pearson_p_value(0.5, 20) - 0.02476929) < 1e-6
    assert stats.jenks_breaks([1, 1, 2, 10, 11, 30], 3) == [2, 11, 30] and stats.optimal_k({2: 5, 3: 7, 4: 6}) == 3


def test_permuted_values_are_of_different_other_rows(monkeypatch):
    zs = np.arange(2000.0)
    drawn = stats._others(zs, 700, 6, 20000, np.random.default_rng(1))
    assert drawn.shape == (20000, 6) and (np.diff(np.sort(drawn, 1), axis=1) > 0).all() and not (drawn == 700).any()
    counts = np.bincount(drawn.astype(int).ravel(), minlength=2000)[np.arange(2000) != 700]
    assert counts.min() > 20 and counts.max() < 110 and abs(counts.mean() - 120000 / 1999) < 1e-9
    monkeypatch.setattr(np, "delete", None)  # no work for each row of the table
    assert stats._others(np.arange(1e6), 0, 3, 9, np.random.default_rng(1)).min() >= 1


def test_moran_p_values_are_those_of_all_permutations(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"u{i:04}", float(v)) for i, v in enumerate(rng.normal(size=1200))], "k string, z double")
    z = {r.k: r.z for r in df.collect()}
    w = spark.createDataFrame([(f"u{i:04}", f"u{(i + j) % 1200:04}") for i in range(0, 1200, 60) for j in (1, 2)], "focal string, neighbor string")
    got = {r.k: r.p for r in stats.moran_p_values(df, "k", "z", w, 1999).collect()}
    assert len(got) == 20
    for k, p in got.items():
        i = int(k[1:])
        rest = np.array([v for o, v in z.items() if o != k])
        a, b = np.triu_indices(1199, 1)
        share = (z[k] * (rest[a] + rest[b]) / 2 >= z[k] * (z[f"u{(i + 1) % 1200:04}"] + z[f"u{(i + 2) % 1200:04}"]) / 2).mean()
        assert abs(p - min(share, 1 - share)) < 0.05


def test_gwr_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(40)]
    df = spark.createDataFrame([(i, x, y, w, 2 * w + 1) for i, x, y, w in rows], "k long, x double, y double, w double, v double")
    fit = stats.GWR(df, "k", "x", "y", "v", ["w"], "gaussian").fit(30)
    assert np.allclose(np.stack(fit["local"].beta.to_list()), [1, 2]) and fit["rss"] < 1e-9


def test_lof_against_numpy(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(size=(30, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k long, x double, y double")
    got = {r.node: r.lof for r in outliers.lof(outliers.knn_features(df, "k", ["x", "y"], 5, 8), 5).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :5]
    kd = np.sort(d, 1)[:, 4]
    lrd = np.array([1 / (np.maximum(d[i, near[i]], kd[near[i]]).mean() + 1e-10) for i in range(31)])
    assert all(abs(got[i] - lrd[near[i]].mean() / lrd[i]) < 1e-9 for i in range(31)) and max(got, key=got.get) == 30


def test_road_merging(spark):
    segs = spark.createDataFrame([(1, ["a"], 0.0, 0.0, 10.0, 0.0), (2, ["a", "b"], 15.0, 0.0, 30.0, 0.0), (3, ["b"], 40.0, 0.0, 50.0, 0.0), (4, ["a"], 500.0, 0.0, 510.0, 0.0)], "k long, names array<string>, x1 double, y1 double, x2 double, y2 double")
    assert {r.k: r.road for r in roads.merge_roads(segs, "k", "names", 20.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_linked_segments_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for k in range(60):
        monkeypatch.setattr(planar, "PAIRS", (4, 64, 1 << 14)[k % 3])
        m, near = int(rng.integers(1, 120)), (0.0, 1e-4, 1.0, 5.0)[k % 4]
        c = rng.uniform(0, 100, (m, 2))
        s = np.hstack([c, c + rng.normal(size=(m, 2)) * (0.5, 5, 60)[k // 3 % 3]])
        s = np.round(s / 5) * 5 if k % 5 == 0 else s
        node = np.unique(rng.integers(0, m, m), return_inverse=True)[1]
        a, b = np.triu_indices(m, 1)
        hit = planar._close(s[a], s[b], near)
        assert (planar.linked(node, s, near) == planar.unite(np.arange(node.max() + 1), node[a[hit]], node[b[hit]])).all()


def test_links_of_crossing_roads_do_not_grow_with_their_square(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"n{i % 3}" if i % 50 else None, *map(float, rng.uniform(0, 1000, 4))) for i in range(900)]
    rows += [(2000 + i, "n0", 9000.0 + 40 * i, 0.0, 9000.0 + 40 * i, 25.0) for i in range(30)]
    segs = spark.createDataFrame(rows, "k long, n string, x1 double, y1 double, x2 double, y2 double")
    of = lambda pairs: {(r.node, r.component) for r in graphs.connected_components(pairs, segs.select("k")).collect()}
    links = graphs.cut_lineage(roads.near_links(segs, "k", 20.0, ["n"]))
    assert of(links) == of(roads.near_pairs(segs, "k", 20.0, ["n"]))
    assert links.count() < 5 * len(rows) and roads.near_pairs(segs, "k", 20.0, ["n"]).count() > 20 * len(rows)
    assert roads.near_links(segs.limit(0), "k", 20.0, ["n"]).count() == 0


def test_lines_that_meet_are_united_without_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.uniform(0, 1000, 4))) for i in range(400)] + [(500 + i, 3000.0 + 9 * i, 0.0, 3009.0 + 9 * i, float(i % 3)) for i in range(40)]
    segs = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double")
    every = graphs.connected_components(roads.near_pairs(segs, "k", 1e-4, [], 500.0), segs.select("k"))
    expected = {(r.node, r.component) for r in every.collect()}
    monkeypatch.setattr(roads, "near_pairs", None)
    assert {(r.node, r.component) for r in roads.proximity_merge(segs, "k").collect()} == expected


def test_road_merging_goes_on_until_it_settles(spark):
    """Side streets along a road, each of which shares a name only with the one before: a round adds one, as the road takes on its names."""
    rows = [(0, ["n0"], 0.0, 0.0, 1000.0, 0.0)] + [(k, [f"n{k - 1}", f"n{k}"], 100.0 * k, 10.0, 100.0 * k, 15.0) for k in (1, 2, 3)] + [(9, ["n3"], 900.0, 500.0, 950.0, 500.0)]
    segs = spark.createDataFrame(rows, "k long, names array<string>, x1 double, y1 double, x2 double, y2 double")
    assert {r.k: r.road for r in roads.merge_roads(segs, "k", "names", 20.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_filters_and_matching(spark):
    try:
        traffic.time_filters(spark.range(1), "id", weekday=True, weekend=True)
        raise AssertionError
    except ValueError:
        pass
    df = spark.createDataFrame([("c", 0, 1.0, 2.0), ("c", 1, 3.0, 4.0)], "chunk string, i long, x double, y double")
    assert [(r.matched_lon, r.matched_lat) for r in matching.match(df, "chunk", "i", "x", "y", lambda t: [(9.0, 9.0), None]).orderBy("i").collect()] == [(9.0, 9.0), (3.0, 4.0)]
    assert matching.match(df, "chunk", "i", "x", "y", lambda t: None).where("matched_lon = x").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"SiteID": "7"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}))
    g = files.read_geojson(spark, str(tmp_path / "a.geojson"), "SiteID:string").select("SiteID", files.point("coordinates").alias("p")).first()
    assert (g.SiteID, g.p.x, g.p.y) == ("7", 1.5, 2.5)
    files.register(spark)
    wkb = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    with sqlite3.connect(tmp_path / "t.gpkg") as db:
        db.execute("CREATE TABLE trees (fid INTEGER PRIMARY KEY, geom BLOB, area REAL)")
        db.execute("INSERT INTO trees VALUES (1, ?, 2.5)", (b"GP\0\1" + b"\0" * 4 + wkb,))
    row = spark.read.format("geopackage").options(path=str(tmp_path / "t.gpkg"), layer="trees").load().first()
    assert files.wkb_points(bytes(row.geom)) == [[(3.0, 4.0)]] and row.area == "2.5"
    data = zlib.compress(struct.pack("<4f", 1, 2, float("nan"), 4))
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 8), (273, 4, 1, 8), (278, 3, 1, 2), (279, 4, 1, len(data)), (339, 3, 1, 3)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    (tmp_path / "h.tif").write_bytes(struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + ifd)
    assert [(r.row, r.col, r.value) for r in spark.read.format("geotiff").load(str(tmp_path / "h.tif")).collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)]
    files.write_version(spark.range(1), str(tmp_path / "v"), "a")
    files.write_version(spark.range(3), str(tmp_path / "v"), "b")
    assert files.read_latest(spark, str(tmp_path / "v")).count() == 3
    pages = {"u": '{"value": [{"a": 1}], "@iot.nextLink": "w"}', "w": '{"value": [{"a": 2}]}'}
    assert [x["a"] for x in files.paged("u", pages.get)] == [1, 2]


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1.0), (10, "a", 2.0), (4000, "a", 5.0), (90000, "b", 1.0)], "t long, site string, v double").select(F.timestamp_seconds("t").alias("ts"), "site", "v")
    df.write.parquet(str(tmp_path / "in"))
    q = windows.hourly_sums(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "site", "v").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.hour, r.site, r.v) for r in spark.table("hours").collect()} == {(r.hour, r.site, r.v) for r in traffic.hourly_sums(df, "ts", "site", "v").collect()}


def test_oracles_cover_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_streaming_medians_and_rates(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 10, 2.0), ("a", 20, 2.0), ("a", 100, 9.0), ("b", 5, 1.0), ("b", 5, 3.0), ("b", None, 1.0)]
    schema = "car string, t long, v double"
    for part in (rows[:2], rows[2:]):  # two batches: a vehicle's last row is kept between them
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("t") + 720_000))  # past the first watermark, which is 1970
    got = {(r.vehicle, int(r.ts.timestamp()) - 720_000, r.rate) for r in run(windows.rates(stream, "ts", "car", "v"), "rates", "append")}
    assert got == {("a", 0, None), ("a", 10, 0.1), ("a", 20, 0.0), ("a", 100, None), ("b", 5, None), ("b", 5, math.inf)}
    medians = run(windows.hourly_medians(stream.where("t is not null"), "ts", "v"), "medians", "complete")
    assert [r.v for r in medians] == [2.0]


def test_projection(spark, monkeypatch):
    lon, lat = -(6 + 20 / 60 + 52.9181 / 3600), 53 + 21 / 60 + 50.5441 / 3600
    df = spark.createDataFrame([(lon, lat), (-8.0, 53.5), (9.0, 0.0), (None, 53.0), (200.0, 53.0)], "lon double, lat double")
    rows = df.select(*[c.alias(n) for n, c in zip(("x", "y"), projection.to_grid(F.col("lon"), F.col("lat"), "EPSG:2157"))]).collect()
    assert math.dist(rows[1], (600000, 750000)) < 1e-6
    assert rows[3].x is None and rows[4].x is None
    for crs in ("EPSG:2157", "EPSG:25832", "EPSG:3857"):
        x, y = projection.to_grid(F.col("lon"), F.col("lat"), crs)
        back = projection.from_grid(F.col("x"), F.col("y"), crs)
        there = df.where("lon < 100").limit(3).withColumns({"x": x, "y": y}).select("lon", "lat", back[0].alias("u"), back[1].alias("v")).collect()
        assert all(abs(r.lon - r.u) < 1e-8 and abs(r.lat - r.v) < 1e-8 for r in there if abs(r.lon + 7) < 3)
    monkeypatch.setitem(projection.GRIDS, "old", projection.Meridian(53.5, -8.0, 1.000035, 200_000.0, 250_000.0, 6377340.189, 1 / 299.3249646))
    x, y = projection.to_grid(F.col("lon"), F.col("lat"), "old")
    assert math.dist(df.limit(1).select(x, y).first(), (309958.26, 236141.93)) < 0.05  # a published pair of the older Irish grid
    line = spark.createDataFrame([([(-8.0, 53.5)],)], "line array<struct<x:double,y:double>>").select(projection.projected_line(F.col("line"), "EPSG:2157").alias("l")).first()
    assert math.dist(line.l[0], (600000, 750000)) < 1e-6


def test_exact_quantiles_narrow_to_the_exact_values(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=30_000), np.full(15_000, 0.25), rng.integers(0, 5, 10_000)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.6, 0.99, 1.0]
    for most in (10**6, 50):
        assert np.allclose(quantiles.exact_quantiles(df, "v", at, most), np.quantile(v, at), rtol=0, atol=1e-12)
    assert quantiles.exact_quantiles(df.where("v IS NULL"), "v", [0.5]) == [None]
    assert traffic.quantile_trim(df.where("v IS NULL"), "v").count() == 0


def test_knn_by_cells_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(60, 2)) * 1e-3 + 5, np.zeros((12, 2)), [[400.0, -300.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, 1.0)], "id int, x double, y double")
    order = lambda of: sorted(map(tuple, of.select("focal", "rank", "neighbor").collect()))
    every = order(spatial.knn(df, "id", "x", "y", 5))
    monkeypatch.setattr(spatial, "FEW", 10)
    assert order(spatial.knn(df, "id", "x", "y", 5)) == every and len(every) == 5 * len(xy)
    few = df.where("id < 15")
    assert spatial.knn(few, "id", "x", "y", 20).count() == 15 * 14


def test_lines_are_joined_where_two_ends_meet(spark):
    a, b, c, d = [(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (2, 1)], [(2, 0), (3, 0)]
    assert roads.line_merge([b, a]) == [[(0, 0), (1, 0), (2, 0)]]
    assert sorted(map(len, roads.line_merge([a, b, c, d, a[::-1]]))) == [2, 2, 3]  # three ends meet at (2, 0)
    ring = roads.line_merge([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)]])
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) == 4
    assert roads.line_merge([]) == [] and roads.line_merge([[(1, 1)]]) == []


def test_road_network_with_roundabout(spark):
    p = lambda *xy: [(float(x), float(y)) for x, y in xy]
    rows = [
        (1, p((0, 0), (60, 0)), None, False, ["Main St"], ["primary"], ["2"], ["50"], None, None),
        (2, p((60, 0), (200, 0)), None, True, ["Main Street"], ["primary"], ["3"], ["30"], None, ["yes"]),
        (3, p((900, 900), (990, 900)), None, True, None, ["service"], None, None, None, None),
        (4, p((500, 0), (520, 0), (520, 20)), "roundabout", True, None, ["primary"], ["1"], None, None, None),
        (5, p((520, 20), (500, 20), (500, 0)), "circular", True, None, ["primary"], ["2"], None, None, None),
    ]
    schema = "id long, line array<struct<x:double,y:double>>, junction string, oneway boolean, name array<string>, highway array<string>, lanes array<string>, maxspeed array<string>, tunnel array<string>, bridge array<string>"
    of, pieces = roads.road_network(spark.createDataFrame(rows, schema), "id", "line", near=5.0)
    got = {r.road: r for r in of.collect()}
    assert sorted(got) == [1, 3, 4] and got[1].length == 200 and got[4].is_roundabout and not got[1].is_roundabout
    assert (got[1].max_lanes, got[1].min_speed, got[1].bridge, got[1].oneway) == (3, 30, True, False)
    assert len(got[4].lines) == 1 and got[4].lines[0][0] == got[4].lines[0][-1] and got[4].length == 80
    assert round(sum(r.length for r in pieces.where("road = 1").collect()), 6) == 200


def test_area_inside_a_bent_unit(spark):
    bent = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    assert sum(abs(roads._twice_area(t)) / 2 for t in roads.triangles(bent)) == 7
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert roads.common_area(square, bent) == roads.common_area(square, bent[::-1]) == 3
    rng = np.random.default_rng(5)
    star = [(math.cos(t) * r, math.sin(t) * r) for t, r in zip(np.linspace(0, 2 * math.pi, 24, endpoint=False), rng.uniform(0.2, 2, 24))]
    star.append(star[0])
    assert math.isclose(roads.common_area([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], star), abs(roads._twice_area(star)) / 2)
    df = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (2, [(8.0, 8.0), (9.0, 8.0), (9.0, 9.0), (8.0, 8.0)])], "unit int, ring array<struct<x:double,y:double>>")
    cut = roads.clip_to_box(df, "ring", (1.0, 1.0, 5.0, 5.0)).select("unit", G.area(F.col("ring")).alias("a")).collect()
    assert [tuple(r) for r in cut] == [(1, 1.0)]


class _Answers(http.server.BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def send(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        more = {"@iot.nextLink": f"http://localhost:{self.server.server_port}/next"} if "next" not in self.path else {}
        self.send(200, {"value": [{"path": self.path}], **more})

    def do_POST(self):
        shape = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["shape"]
        self.send(400 if len(shape) == 1 else 200, {"tracepoints": [{"location": [p["lon"] + 1, p["lat"]]} if k else None for k, p in enumerate(shape)]})


def test_services_over_http(spark):
    server = http.server.ThreadingHTTPServer(("localhost", 0), _Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://localhost:{server.server_port}"
    matcher = matching.HttpMatcher(f"{url}/match")
    assert matcher([(1.0, 2.0), (3.0, 4.0)]) == [None, (4.0, 4.0)] and matcher([(1.0, 2.0)]) is None
    files.register(spark)
    urls = files.time_spans(f"{url}/obs", "phenomenonTime", ["2024-01-01", "2024-01-02", "2024-01-03"])
    got = spark.read.format("pagedjson").option("urls", json.dumps(urls)).load()
    assert got.count() == 4 and got.select("url").distinct().count() == 2 and "%24top=1000" in urls[0]
    rows = [(i, "a", f"2024-01-0{1 + i // 3} 10:00:{10 * (i % 3):02d}", float(i), 50.0) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, car string, gps_timestamp string, longitude double, latitude double").withColumn("gps_timestamp", F.to_timestamp("gps_timestamp"))
    found = {r.id: r.matched_lon for r in matching.match_days(df, ["car"], "id", matcher).collect()}
    assert found == {0: 0.0, 1: 2.0, 2: 3.0, 3: 3.0, 4: 5.0, 5: 6.0, 6: 6.0}  # first points and refused chunks keep their place
    assert all(r.matched_lon == r.longitude for r in matching.match_days(df, ["car"], "id", None).collect())
    server.shutdown()


def test_landed_ways_and_models(spark, tmp_path):
    answer = {"elements": [{"type": "way", "id": 7, "geometry": [{"lat": 53.0, "lon": -6.0}, {"lat": 53.1, "lon": -6.0}], "tags": {"name": "A St;B St", "highway": "primary", "oneway": "yes"}}, {"type": "node", "id": 8}]}
    files.land(spark, "none", ["q1"], str(tmp_path / "ways"), lambda u, b: json.dumps(answer))
    (w,) = files.read_ways(spark, str(tmp_path / "ways" / "part-*")).collect()
    assert (w.id, w.name, w.highway, w.oneway, w.junction, w.lanes) == (7, ["A St", "B St"], ["primary"], True, None, None)
    assert w.line[1].x == -6.0 and w.line[1].y == 53.1
    files.write_model(spark, {"bandwidths": {"intercept": 40}, "beta": np.zeros((2, 2)), "aicc": 1.5}, str(tmp_path / "m"))
    assert files.read_model(spark, str(tmp_path / "m")) == {"bandwidths": {"intercept": 40}, "beta": [[0.0, 0.0], [0.0, 0.0]], "aicc": 1.5}


def test_pipelines(spark, tmp_path):
    square = lambda k, x, y, w=900.0: (k, [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)], w * w)
    ring = "ring array<struct<x:double,y:double>>"
    east, north = 709000.0, 736000.0
    tables = {
        "shapes": spark.createDataFrame([square(i, east + 900.0 * (i % 3), north + 900.0 * (i // 3)) for i in range(9)], f"unit long, {ring}, area double"),
        "traffic_raw": spark.createDataFrame([(f"202401{d:02d}{h:02d}0000", f"s{s}", float(10 * s + h)) for s in range(3) for d in (1, 2) for h in range(24)], files.TRAFFIC),
        "traffic_places": spark.createDataFrame([(f"s{s}", east + 100 + 900.0 * s, north + 100) for s in range(3)], "Site string, x double, y double"),
        "trees": spark.createDataFrame([(i, east + 50.0 * i, north + 40.0 * i, 5.0) for i in range(30)], "id long, x double, y double, crown_area double"),
        "landuse": spark.createDataFrame([(1, square(1, east, north)[1], "park"), (2, square(2, east + 450, north)[1], "housing")], f"id long, {ring}, kind string"),
        "buildings": spark.createDataFrame([(i, east + 10 + 100.0 * i, north + 5, 40.0, 100.0, 12.0) for i in range(8)], "id long, x double, y double, perimeter double, area double, height double"),
    }
    for n, df in tables.items():
        df.write.parquet(str(tmp_path / f"{n}.parquet"))
    read = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    for name in ("traffic", "urban_trees", "urban_landuse", "buildings"):
        assert pipelines.main([str(tmp_path), "--pipeline", name], spark) == [o for s in pipelines.PIPELINES[name] for o in s.outputs]
    idw = read("unit_traffic")
    assert idw.count() == 9 and idw.where("avg_traffic_idw IS NULL").count() == 0 and idw.where("avg_traffic IS NULL").count() == 6
    land = {r.unit: (r.park, r.housing) for r in read("unit_landuse").collect()}
    assert land[0] == (100.0, 50.0) and land[1] == (0.0, 50.0)
    assert read("unit_trees").agg(F.sum("total_trees_area")).first()[0] == 150.0
    assert read("unit_buildings").where("build_cover_area > 0").agg(F.sum("build_cover_area")).first()[0] == 800.0
    assert set(pipelines.PIPELINES) >= {"data_preparation", "hotspot_analysis", "temporal_pattern", "traffic", "buildings", "streets", "morphology_profile", "urban_trees", "urban_landuse", "covariates", "modelling", "all_covariates", "default"}


def test_data_preparation_to_hotspots(spark, tmp_path):
    rng = np.random.default_rng(2)
    east, north = 709000.0, 736000.0
    n = 1800
    xy = np.stack([east + rng.uniform(0, 2700, n), north + rng.uniform(0, 2700, n)], 1)
    place = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(xy)], "i long, x double, y double")
    lon, lat = projection.from_grid(F.col("x"), F.col("y"), "EPSG:2157")
    air = place.select(F.date_format(F.timestamp_seconds(1704067200 + F.col("i") * 40), "yyyy-MM-dd HH:mm:ss").alias("gps_timestamp"), lat.alias("latitude"), lon.alias("longitude"), F.when(F.col("i") == 500, 5000.0).otherwise(F.col("x") / 500 - 1380 + F.col("i") % 7).alias("NO2_ugm3"))
    square = lambda x, y: [(x, y), (x + 900.0, y), (x + 900.0, y + 900.0), (x, y + 900.0), (x, y)]
    shapes = spark.createDataFrame([(i, square(east + 900.0 * (i % 3), north + 900.0 * (i // 3)), 810000.0) for i in range(9)], "unit long, ring array<struct<x:double,y:double>>, area double")
    settings = replace(PRESETS["base"], lof_neighbours=(10,), moran_neighbours=3)
    ends = lambda y: [F.struct(a.alias("x"), b.alias("y")) for a, b in (projection.from_grid(F.lit(east + x), F.lit(north) + y, "EPSG:2157") for x in (0.0, 2700.0))]
    ways = spark.range(10).select("id", F.array(*ends(F.col("id") * 300.0)).alias("line"))
    tables, made = {"air_raw": air, "shapes": shapes, "ways": ways}, {}
    prepared = [s for s in pipelines.PIPELINES["data_preparation"] if s.name != "roads"]
    steps = [*prepared, *pipelines.PIPELINES["temporal_pattern"], *pipelines.PIPELINES["hotspot_analysis"]]

    def write(name, df):
        df.write.parquet(str(tmp_path / name))
        made[name] = spark.read.parquet(str(tmp_path / name))
        return made[name]

    pipelines.PIPELINES["test"] = steps
    try:
        pipelines.run(spark, "test", tables.__getitem__, write, settings)
    finally:
        del pipelines.PIPELINES["test"]
    assert made["air"].count() == n == made["air_matched"].count()
    off = made["air_matched"].join(made["air"].select("id", F.col("y").alias("own")), "id").select(F.abs(F.col("y") - F.col("own")).alias("off"), ((F.col("y") - north) / 300).alias("way"))
    assert off.where("off > 50.01").count() == 0 and off.where("off > 1 AND abs(way - round(way)) > 1e-3").count() == 0 and off.where("off > 1").count() > n / 5
    assert made["air_clean"].count() < n and made["air_clean"].count() > 0.8 * n
    assert made["values"].count() == 9 == made["hotspots"].count() and made["hours"].count() == 20
    assert {r["class"] for r in made["hotspots"].collect()} <= {0, 1, 2, 3, 4}


def test_streets_to_covariates(spark, tmp_path):
    east, north = 709000.0, 736000.0
    square = lambda x, y: [(x, y), (x + 900.0, y), (x + 900.0, y + 900.0), (x, y + 900.0), (x, y)]
    shapes = [(i, square(east + 900.0 * (i % 2), north + 900.0 * (i // 2)), 810000.0) for i in range(4)]
    lon, lat = projection.from_grid(F.col("p.x"), F.col("p.y"), "EPSG:2157")
    ends = [(1, east + 100, north + 100, east + 1700, north + 100), (2, east + 100, north + 100, east + 100, north + 700), (3, east + 1700, north + 100, east + 1700, north + 1700)]
    flat = spark.createDataFrame(ends, "id long, x1 double, y1 double, x2 double, y2 double")
    points = flat.select("id", F.posexplode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("n", "p"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("n", lon.alias("x"), lat.alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    ways = points.groupBy("id").agg(line.alias("line")).withColumn("highway", F.array(F.when(F.col("id") == 1, "primary").otherwise("residential")))
    unit_value = lambda name, k: spark.createDataFrame([(i, float(k * i)) for i in range(4)], f"unit long, {name} double")
    tables = {
        "shapes": spark.createDataFrame(shapes, "unit long, ring array<struct<x:double,y:double>>, area double"),
        "ways": ways,
        "unit_lines": flat.select((F.col("id") - 1).alias("unit"), "x1", "y1", "x2", "y2"),
        "walls": spark.createDataFrame([(east, north + 110, east + 1800, north + 110, 12.0)], "x1 double, y1 double, x2 double, y2 double, height double"),
        "values": unit_value("NO2_ugm3", 2), "unit_traffic": unit_value("avg_traffic_idw", 3), "unit_buildings": unit_value("build_height", 4),
        "unit_trees": unit_value("canopy_cover", 5), "unit_landuse": unit_value("park", -1),
    }
    for n, df in tables.items():
        df.write.parquet(str(tmp_path / f"{n}.parquet"))
    read = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    for name in ("streets", "morphology_profile", "covariates"):
        pipelines.main([str(tmp_path), "--pipeline", name], spark)
    streets = {r.unit: r for r in read("unit_streets").collect()}
    assert round(streets[0].road_length_m, 2) == 800 + 600 and round(streets[1].road_length_m, 2) == 800 + 800 and streets[2].road_length_m == 0
    assert round(streets[0].major_road, 2) == 800 and round(streets[0].low_access, 2) == 600
    assert read("unit_profiles").where("unit = 0").first().height == 12.0
    every = read("covariates")
    assert [r.unit for r in every.collect()] == [0]  # the others lack a profile, and units with a null are left out
    assert {"NO2_ugm3", "height", "build_height", "road_length_m", "park"} <= set(every.columns)
    assert read("correlations").count() > 0


def test_raster_polygons(spark):
    """Areas and outlines by counting pixels and steps; a hole, a corner where a region touches itself, a null."""
    import random

    rnd = random.Random(7)
    plain = ["11112", "1.212", "11.12", "11112"]  # the hole has its own corner contact with the 1 in its middle
    grids = [["1111", "1..1", "1.11", "11.1", "1111"], plain, ["".join(rnd.choice("112.") for _ in range(9)) for _ in range(9)], ["1"]]
    for grid in grids:
        at = {(r, c): float(v) for r, line in enumerate(grid) for c, v in enumerate(line) if v != "."}
        px = spark.createDataFrame([(r, c, at.get((r, c))) for r, line in enumerate(grid) for c in range(len(line))], "row int, col int, value double")
        regions = roads.raster_regions(px)
        of = {(r.row, r.col): r.region for r in regions.collect()}
        rings = roads.raster_polygons(regions, 10.0, 50.0, 2.0, -3.0).collect()
        assert {r.region for r in rings} == set(of.values())
        for region in set(of.values()):
            mine = [r for r in rings if r.region == region]
            cells = {p for p, g in of.items() if g == region}
            assert sum(not r.hole for r in mine) == 1  # 4-connected: one ring outside
            assert sum(-r.area if r.hole else r.area for r in mine) == 6.0 * len(cells)
            assert all(r.ring[0] == r.ring[-1] and len(set(r.ring)) == len(r.ring) - 1 or r.hole for r in mine)
            sides = sum(abs(a.x - b.x) / 2 + abs(a.y - b.y) / 3 for r in mine for a, b in zip(r.ring, r.ring[1:]))
            assert sides == sum((r + dr, c + dc) not in cells for r, c in cells for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))
            assert {at[p] for p in cells} == {r.value for r in mine}
    none = roads.raster_polygons(roads.raster_regions(px.where("row < 0")))
    assert none.count() == 0
