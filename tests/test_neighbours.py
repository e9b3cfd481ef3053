import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeworks.functions.space import Splits, nearest_k
from plumeworks.operators import outliers


def far(x, y):
    total = 0.0  # one after another: sum() would round less
    for a, b in zip(x, y):
        total += (a - b) * (a - b)
    return float(np.sqrt(total))


def brute(rows, k):
    out = []
    for i, x in rows:
        d = sorted((far(x, y), j) for j, y in rows if j != i)[:k]
        out += [(i, j, round(v, 9), r + 1) for r, (v, j) in enumerate(d)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_nearest_k_and_splits(seed):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(0, 1, (300, 1 + seed % 4)), 1)
    k = int(rnd.integers(1, 20))
    place, dist = nearest_k(x, x, k)
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert np.allclose(np.sort(d)[:k], dist[i]) and (np.lexsort((np.arange(len(x)), d))[:k] == place[i]).all()
    tree = Splits.of(x, 9)
    row, leaf = tree.reached(x, np.zeros(len(x)))
    assert (row[np.argsort(row)] == np.arange(len(x))).all() and 1 < tree.leaves <= 9 and set(leaf) == set(range(tree.leaves))
    own = leaf[np.argsort(row)]
    r = rnd.uniform(0, 1, len(x))
    seen = set(zip(*(a.tolist() for a in tree.reached(x, r))))
    for i in range(len(x)):
        near = np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(1)) <= r[i])
        assert {(i, int(own[j])) for j in near} <= seen
    assert Splits.of(np.ones((50, 2)), 8).leaves == 1 and nearest_k(x[:0], x, 3)[0].shape == (0, 3)


@pytest.mark.parametrize(("shard", "k"), [(10_000, 6), (20, 6), (8, 3), (20, 70)])
def test_neighbours_of_shards_are_those_of_all_pairs(spark, shard, k):
    """Clusters, a far point, a place with many rows, ties on a lattice, nulls and NaN."""
    rnd = np.random.default_rng(4)
    points = [*np.round(rnd.normal(0, 1, (60, 3)), 1).tolist(), [900.0, 0.0, -0.0], *[[0.5, 0.5, 0.5]] * 30, *[[float(i % 4), float(i // 4), 0.0] for i in range(16)]]
    rows = [(int(i), p) for i, p in zip(rnd.permutation(len(points)), points)]
    df = spark.createDataFrame([(i, *p, "x") for i, p in rows] + [(1000, None, 0.0, 0.0, "x"), (1001, float("nan"), 0.0, 0.0, "x")], "id long, a double, b double, c double, v string").repartition(3)
    got = outliers.knn_features(df, "id", ["a", "b", "c"], k, shard)
    assert sorted((r.focal, r.neighbor, round(r.dist, 9), r["rank"]) for r in got.collect()) == brute(rows, k)
    if shard == 8:
        assert outliers.knn_features(df.limit(0), "id", ["a", "b", "c"], k).count() == 0 == outliers.knn_features(df.where("id = 3"), "id", ["a", "b", "c"], k).count()


def test_the_factor_tells_a_far_point(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.normal(0, 1, (120, 2)))] + [(500, 12.0, 12.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    of, k = outliers.best_lof(df, "id", ["x", "y"], (10, 20))
    assert k in (10, 20) and of.orderBy(F.desc("lof")).first().node == 500 and of.count() == 121
