import itertools
import random

import numpy as np
import pytest

from plumeworks.operators import overlaps, stats

LINES = "id long, line array<struct<x:double,y:double>>, a int, n int, cell int"


def on_grid(line):
    """A line of lattice steps as the set of its unit parts."""
    parts = set()
    for (x, y), (u, v) in zip(line, line[1:]):
        n = max(abs(u - x), abs(v - y))
        steps = [(x + (u - x) * k / n, y + (v - y) * k / n) for k in range(int(n) + 1)]
        parts |= {tuple(sorted(p)) for p in zip(steps, steps[1:])}
    return parts


def size(parts):
    return sum(np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in parts)


@pytest.mark.parametrize("seed", range(4))
def test_lines_that_run_along_one_another(spark, seed):
    rnd = random.Random(seed)
    lines = []
    for i in range(60):
        x, y = rnd.randint(-4, 4) * 1.0, rnd.randint(-4, 4) * 1.0
        line, way = [(x, y)], rnd.choice([(1, 0), (0, 1), (1, 1), (1, -1)])
        for _ in range(rnd.randint(1, 3)):  # ever onwards, so that the line is simple
            n = rnd.randint(1, 4)
            x, y = x + way[0] * n, y + way[1] * n
            line.append((x, y))
            way = rnd.choice([way, (1, 0)]) if way[0] else way
        lines.append((i, line if rnd.random() < 0.5 else line[::-1]))
    lines += [(100, lines[0][1]), (101, lines[0][1][::-1])]
    df = spark.createDataFrame([(i, [(7e5 + px, 5e6 + py) for px, py in p], 0, 0, 0) for i, p in lines] + [(200, None, 0, 0, 0), (201, [], 0, 0, 0), (202, [(1.0, 1.0)], 0, 0, 0), (203, [(1.0, 1.0)] * 2, 0, 0, 0)], LINES)
    pairs, members = overlaps.overlapping_lines(df, "id", "line")
    of = {r.id: r.representative for r in members.collect()}
    want_of = {i: min(j for j, q in lines if q in (p, p[::-1])) for i, p in lines}
    assert {i: of[i] for i in want_of} == want_of and set(of) - set(want_of) == {201, 202, 203}
    want = {}
    for (i, p), (j, q) in itertools.combinations([(i, p) for i, p in lines if want_of[i] == i], 2):
        a, b = on_grid(p), on_grid(q)
        if a & b:
            want[i, j] = (round(size(a & b), 4), "equal" if a == b else "within" if a <= b else "contains" if b <= a else "overlaps")
    assert {(r.a, r.b): (round(r.shared, 4), r.relation) for r in pairs.collect()} == want and len({w[1] for w in want.values()}) >= 3
    assert overlaps.overlapping_lines(df.limit(0), "id", "line")[0].count() == 0


def test_copies_do_not_make_all_pairs(spark):
    df = spark.range(2000).selectExpr("id", "array(struct(0D AS x, 0D AS y), struct(9D AS x, 5D AS y)) AS line")
    pairs, members = overlaps.overlapping_lines(df, "id", "line")
    assert pairs.count() == 0 and members.where("representative = 0").count() == 2000


def test_points_on_a_straight_way_make_no_other_line(spark):
    at = lambda *ts: [(7e5 + t, 5e6 - t) for t in ts]
    bent = [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    lines = [(1, at(0.0, 9.0)), (2, at(0.0, 4.0, 4.0, 7.0, 9.0)), (3, at(9.0, 7.0, 0.0)), (4, at(0.0, 7.0)), (5, bent), (6, [*bent[::-1][:2], (1.0, 0.0), bent[0]]), (7, [(0.0, 0.0), (2.0, 3.0)]), (8, [(0.0, 0.0)]), (9, []), (10, None)]
    df = spark.createDataFrame([(i, p, 0, 0, 0) for i, p in lines], LINES)
    pairs, members = overlaps.overlapping_lines(df, "id", "line", drawn=False)
    assert {r.id: r.representative for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    assert [(r.a, r.b, round(r.shared, 6), r.relation) for r in pairs.collect()] == [(1, 4, round(7 * 2**0.5, 6), "contains")]


@pytest.mark.parametrize("seed", range(6))
def test_natural_breaks_have_the_least_deviation(seed):
    rnd = random.Random(seed)
    values = [round(rnd.gauss(0, 3), 1) + 1e6 * (seed == 5) for _ in range(13)]
    cost = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v)
    for k in (1, 2, 3, 4):
        v = sorted(values)
        best = min(sum(cost(v[a:b]) for a, b in zip((0, *cut), (*cut, len(v)))) for cut in itertools.combinations(range(1, len(v)), k - 1))
        kinds = list(set(values))
        for breaks in (stats.jenks_breaks(values, k), stats.jenks_breaks(kinds, k, [values.count(x) for x in kinds])):
            edges = [-np.inf, *breaks]
            groups = [[x for x in v if a < x <= b] for a, b in zip(edges, edges[1:])]
            assert len(breaks) == k and breaks[-1] == max(v) and sum(map(cost, filter(None, groups))) == pytest.approx(best, abs=1e-6)
    assert stats.jenks_breaks([], 3) == [] and stats.jenks_breaks([5.0], 3) == [5.0]
    rising = stats.jenks_breaks(np.arange(20_000).tolist(), 4)
    assert rising == [4999.0, 9999.0, 14999.0, 19999.0]
