import random

import pytest
from pyspark.sql import functions as F

from plumeworks.operators import spatial, stats
from plumeworks.operators import timeseries as T


@pytest.fixture(scope="module")
def trips(spark):
    """A vehicle with most rows, ties in time, gaps, nulls, a vehicle without a name, and columns with names of our own."""
    rnd = random.Random(3)
    rows, t = [], 1704067200
    for i in range(400):
        t += rnd.choice([0, 1, 1, 5, 30, 200])
        rows.append((i, "hot" if rnd.random() < 0.8 else rnd.choice(["a", "b", None]), t, None if rnd.random() < 0.05 else float(rnd.choice([1, 2, 3, 50])), "m", 7))
    df = spark.createDataFrame(rows, "id long, car string, s long, v double, __m string, __median int")
    return df.withColumn("ts", F.timestamp_seconds("s")).repartition(5)


def by_id(df, *names):
    return {r.id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("rows", [7, 399])
def test_parts_give_what_whole_windows_give(spark, trips, rows):
    whole = T.split_by_gaps(trips, "ts", 60, ["car"], "id")
    parts = T.split_by_gaps(trips, "ts", 60, ["car"], "id", rows=rows)
    assert sorted(parts.columns) == sorted(whole.columns) and by_id(parts, "traj") == by_id(whole, "traj")
    args = (trips, "v", ["car"], ["ts", "id"], 5, 1.0)
    assert by_id(T.hampel(*args, rows=rows), "hampel", "__m") == by_id(T.hampel(*args), "hampel", "__m")
    assert any(f for f, *_ in by_id(T.hampel(*args), "hampel").values())
    args = (trips, "ts", "v", ["car"], "id", 0.8, 40)
    assert by_id(T.rate_of_change(*args, rows=rows), "roc") == by_id(T.rate_of_change(*args), "roc")
    both = [T.temporal_outliers(trips, "ts", "v", ["car"], "id", 60, 5, 1.0, 0.8, 40, **more) for more in ({}, {"rows": rows})]
    assert by_id(both[0], "traj", "hampel", "roc", "is_temporal_outlier") == by_id(both[1], "traj", "hampel", "roc", "is_temporal_outlier")
    assert T.split_by_gaps(trips.limit(0), "ts", 60, ["car"], "id", rows=rows).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.77, 0.99, 1.0])
def test_quantiles_of_large_groups(spark, q):
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7.0).alias("v"))
    df = df.union(spark.createDataFrame([(9, None), (8, 1.0), (8, 3.0), (None, 4.0)], "g long, v double"))
    whole = {r.g: r.q for r in T.group_quantile(df, ["g"], "v", q, "q").collect()}
    parts = {r.g: r.q for r in T.group_quantile(df, ["g"], "v", q, "q", rows=100).collect()}
    assert parts == {g: pytest.approx(x, rel=1e-12) for g, x in whole.items() if x is not None}


def test_inverse_distances_by_cells_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    known = [(i, rnd.choice([rnd.uniform(0, 9), 3.0]), rnd.uniform(0, 9), rnd.uniform(0, 5)) for i in range(200)] + [(998, None, 1.0, 9.0)]
    unknown = [(1000 + i, rnd.uniform(-20, 30), rnd.uniform(0, 9), None) for i in range(60)] + [(7, known[7][1], known[7][2], None), (999, 1.0, None, None)]
    a, b = (spark.createDataFrame(r, "k long, x double, y double, v double") for r in (known, unknown))
    whole = {r.k: r.v for r in spatial.idw(a, b, "k", "x", "y", "v", 4).collect()}
    cells = {r.k: r.v for r in spatial.idw(a, b, "k", "x", "y", "v", 4, few=10).collect()}
    assert len(whole) == 61 and cells == {k: pytest.approx(v, rel=1e-9) for k, v in whole.items()} and whole[7] == pytest.approx(known[7][3])
    assert spatial.idw(a.limit(0), b, "k", "x", "y", "v", few=0).count() == 0 == spatial.idw(a, b.limit(0), "k", "x", "y", "v", few=1).count()


def test_points_and_polygons_keep_columns_with_names_of_ours(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5, 7, 8)], "id long, x double, y double, __cx int, __PX int")
    rings = spark.createDataFrame([(2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], 9)], "unit long, ring array<struct<x:double,y:double>>, __cy int")
    (r,) = spatial.within(points, rings, "x", "y", "ring", 1.0).collect()
    assert (r.id, r.unit, r["__cx"], r["__PX"], r["__cy"]) == (1, 2, 7, 8, 9)


def test_boxes_of_full_hours(spark, trips):
    df = trips.withColumn("v", F.col("v") + F.col("id") % 13)
    of = [T.hourly_boxes(df, "ts", "v", **more) for more in ({}, {"rows": 20})]
    assert sorted(map(tuple, of[0].collect())) == sorted(map(tuple, of[1].collect())) and of[0].count() > 1


@pytest.mark.parametrize(("n", "k", "block", "slices"), [(60, 3, 7, 2), (300, 2, 50, 3), (60, 3, 1000, 1)])
def test_p_values_in_blocks_are_those_of_the_whole_table(spark, n, k, block, slices):
    rnd = random.Random(n)
    z = [rnd.choice([rnd.gauss(0, 1), 1.0]) for _ in range(n)]
    df = spark.createDataFrame([(f"u{i:04}", z[i], 0) for i in range(n)], "id string, z double, k int")
    near = spark.createDataFrame([(f"u{i:04}", f"u{(i + d) % n:04}") for i in range(n - 1) for d in range(1, k + 1 + i % 2)], "focal string, neighbor string")
    whole = {r.id: r.p for r in stats.moran_p_values(df, "id", "z", near, 99).collect()}
    parts = {r.id: r.p for r in stats.p_values_in_blocks(df, "id", "z", near, 99, block=block, slices=slices).collect()}
    assert parts == whole and len(whole) == n - 1 and len(set(whole.values())) > 5
    if block == 7:
        assert {r.id: r.p for r in stats.moran_p_values(df, "id", "z", near, 99, most=10).collect()} == whole
        with pytest.raises(Exception, match="without z"):
            stats.p_values_in_blocks(df.where("id <> 'u0003'"), "id", "z", near, 9, block=7, slices=2).collect()
