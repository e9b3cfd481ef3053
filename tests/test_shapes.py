import math

import pytest
from pyspark.sql import functions as F

from plumeworks.functions import geometry as G
from plumeworks.operators import graphs, nodes, roads, shapes, spatial

P = "struct<x:double,y:double>"


def square(x, y, w):
    return [(float(x), float(y)), (x + w, float(y)), (x + w, y + w), (float(x), y + w), (float(x), float(y))]


def test_clipped_polygons(spark):
    features = [(1, [square(0, 0, 6.0), square(2, 2, 2.0)], "a"), (2, [square(4, 4, 1.0)], "b"), (3, None, "c"), (4, [], "d"), (5, [[]], "e"), (6, [square(10, 0, 5.0)], "f")]
    f = spark.createDataFrame([(*r, "k", 0) for r in features], f"id long, shape array<array<{P}>>, kind string, area string, parts int")
    u = spark.createDataFrame([(7, square(-1, 2, 8.0)), (8, square(2, 2, 2.0)), (9, square(6, 0, 4.0)), (10, None)], f"unit long, ring array<{P}>")
    got = {(r.unit, r.id): r for r in shapes.clip_polygons(f.drop("area", "parts"), u, "id", "shape", "unit", "ring", 3.0, ["kind"]).collect()}
    assert {k: (r.area, r.kind) for k, r in got.items()} == {(7, 1): (20.0, "a"), (7, 2): (1.0, "b")}  # units that only touch give nothing
    (part,) = got[7, 1].parts
    assert sum(G_area(r) for r in part) == 20.0 and all(r[0] == r[-1] for r in part)
    assert shapes.clip_polygons(f.limit(0), u, "id", "shape", "unit", "ring", 3.0).count() == 0 == shapes.clip_polygons(f, u.limit(0), "id", "shape", "unit", "ring", 3.0).count()


def test_areas_of_clipped_polygons_without_their_parts(spark, monkeypatch):
    """The same pairs and areas as with parts: boxes with holes, slanted and many-sided shapes, and cells cut into slices."""
    around = lambda n, x, y, r: [(x + r * math.cos(2 * math.pi * k / n + 0.3), y + r * math.sin(2 * math.pi * k / n + 0.3)) for k in (*range(n), 0)]
    boxes = [(k, [square(2 * k, k, 6.0), square(2 * k + 2, k + 2, 2.0)][:: (-1) ** k], f"k{k}") for k in range(8)] + [(50, None, "n"), (51, [], "e"), (52, [[]], "r")]
    bent = [(20 + k, [around(3 + 2 * k, 1.5 * k, k, 4.0), around(3, 1.5 * k, k, 1.0)[::-1]], "s") for k in range(8)]
    masks = [(7, [square(-1, 2, 8.0)]), (8, [square(6, 0, 4.0), square(7, 1, 1.0)]), (9, [square(20, 7, 3.0)]), (10, None)]
    monkeypatch.setattr(spatial, "SIDE", 2)
    for features, units in ((boxes, masks), (boxes + bent, [*masks, (11, [around(12, 5.0, 5.0, 6.0), around(5, 5.0, 5.0, 2.0)])])):
        f, u = spark.createDataFrame(features, f"id long, shape array<array<{P}>>, kind string"), spark.createDataFrame(units, f"unit long, ring array<array<{P}>>")
        drawn, plain = (shapes.clip_polygons(f, u, "id", "shape", "unit", "ring", 3.0, ["kind"], d) for d in (True, False))
        got = plain.collect()
        assert plain.columns == ["unit", "id", "kind", "area"] and len(got) == len({(r.unit, r.id) for r in got}) > 5
        assert {(r.unit, r.id, r.kind): r.area for r in got} == pytest.approx({(r.unit, r.id, r.kind): r.area for r in drawn.collect()}, abs=1e-9)
    assert shapes.clip_polygons(f.limit(0), u, "id", "shape", "unit", "ring", 3.0, drawn=False).count() == 0


def G_area(ring):
    return abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:]))) / 2


def test_buffers_and_their_union(spark):
    rows = [(1, 1, [(0.0, 0.0), (100.0, 0.0)]), (2, 1, [(50.0, -50.0), (50.0, 50.0)]), (3, 2, [(5.0, 5.0)]), (4, 2, None), (5, 2, [])]
    df = spark.createDataFrame(rows, f"id long, road long, line array<{P}>")
    round_ = 32 * 100 * math.sin(math.pi / 32)
    wide = shapes.buffers(df, "id", "line", 10.0)
    assert {r.id: r.area for r in wide.collect()} == pytest.approx({1: 2000 + round_, 2: 2000 + round_, 3: round_})
    one = shapes.merged(wide.join(df.select("id", "road"), "id"), "road", "parts")
    assert {r.road: (r.area, len(r.parts)) for r in one.collect()} == {1: (pytest.approx(3600 + 2 * round_), 1), 2: (pytest.approx(round_), 1)}


def test_roads_as_units_of_the_plane(spark):
    points = spark.createDataFrame([(i, f"2024-01-0{1 + i % 2} 10:00:00", float(i), 10.0 * i, 1.0) for i in range(20)], "id long, ts string, v double, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (95.0, 0.0)]), (2, [(95.0, 0.0), (200.0, 0.0)]), (3, [(0.0, 900.0), (9.0, 900.0)])], f"unit long, line array<{P}>")
    of = nodes.aggregate_to_units(points, "road", "ts", "v", shapes=lines, shape="line", buffer=100.0, quantile=0.0)
    plain = nodes.aggregate_to_units(points, "road", "ts", "v", shapes=lines, shape="line", quantile=0.0)
    got = {r.unit: r for r in of.collect()}
    assert {u: r.v for u, r in got.items()} == {r.unit: r.v for r in plain.collect()} and set(got) <= {1, 2} and got
    for r in got.values():
        long = r.original_road_geom[1].x - r.original_road_geom[0].x
        assert r.area == pytest.approx(200 * long + 32 * 10_000 * math.sin(math.pi / 32)) and len(r.parts) == 1


def test_centroids(spark):
    bent = [(0.0, 0.0), (9.0, 0.0), (9.0, 2.0), (2.0, 2.0), (2.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    far = [(7e5 + x, 5e6 + y) for x, y in bent]
    rows = [(1, bent), (2, bent[::-1]), (3, far), (4, [(0.0, 0.0), (2.0, 0.0), (0.0, 0.0)]), (5, [(3.0, 4.0)]), (6, []), (7, None)]
    df = spark.createDataFrame(rows, f"id long, ring array<{P}>")
    x, y = G.centroid(F.col("ring"))
    got = {r.id: (r.x, r.y) for r in df.select("id", x.alias("x"), y.alias("y")).collect()}
    middle = (18 * 4.5 + 14 * 1.0) / 32
    assert got[1] == pytest.approx((middle, middle)) == got[2] and got[3] == pytest.approx((7e5 + middle, 5e6 + middle), abs=1e-6)
    assert got[4] == (1.0, 0.0) and got[5] == got[6] == got[7] == (None, None)


def test_units_that_only_touch_a_box_are_left_out(spark):
    rings = [(1, square(10, 8, 4.0)), (2, square(8, 8, 4.0)), (3, square(10, 10, 4.0)), (4, square(-4, -2, 4.0)), (5, square(2, 2, 1.0))]
    got = roads.clip_to_box(spark.createDataFrame(rings, f"id long, ring array<{P}>"), "ring", (0.0, 0.0, 10.0, 10.0))
    assert {r.id: r.a for r in got.select("id", G.area(F.col("ring")).alias("a")).collect()} == {2: 4.0, 5: 1.0}


def test_units_inside_others_are_connected(spark):
    rings = [(1, square(0, 0, 10.0)), (2, square(2, 2, 2.0)), (3, square(20, 0, 5.0)), (4, square(25, 5, 5.0)), (5, square(41, 0, 1.0))]
    u = spark.createDataFrame(rings, f"id long, ring array<{P}>")
    pairs = lambda b: {tuple(r) for r in roads.unit_graph(u, "id", "ring", b).collect()}
    assert pairs(0.0) == {(1, 2), (3, 4)} and pairs(5.0) == {(1, 2), (3, 4), (1, 3)} and pairs(6.0) == pairs(5.0) | {(4, 5)}
    assert {r.node for r in graphs.largest_component(roads.unit_graph(u, "id", "ring", 5.0), u.select("id")).collect()} == {1, 2, 3, 4}


def test_units_that_touch_by_a_part_of_a_side_are_connected(spark):
    """A foot that is computed on an outline may lie beside it; sides that share a part touch all the same."""
    sides = [(1, square(1800, 13, 187.0)), (2, square(1987, 64, 60.0)), (3, square(1041, 2, 98.0)), (4, square(1139, 29, 161.0)), (5, square(1048, 0, 2.0))]
    got = roads.unit_graph(spark.createDataFrame(sides, f"id long, ring array<{P}>"), "id", "ring").collect()
    assert {tuple(r) for r in got} == {(1, 2), (3, 4), (3, 5)} and len(got) == 3
    rows = spark.createDataFrame([("b", square(0, 0, 2.0)), ("b", square(50, 0, 2.0)), ("a", square(1, 1, 2.0)), ("a", square(51, 1, 2.0)), (None, square(0, 0, 2.0)), ("c", [])], f"id string, ring array<{P}>")
    assert [tuple(r) for r in roads.unit_graph(rows, "id", "ring").collect()] == [("a", "b")]  # keys of several rows


def test_work_on_few_rows_is_dealt_to_tasks(spark):
    """A table in one partition makes its pairs and polygons in many."""
    rings = spark.range(40).coalesce(1).select("id", F.array(*[F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 0), (3, 3), (0, 3), (0, 0))]).alias("ring"))
    assert shapes.buffers(rings, "id", "ring", 1.0).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert "RoundRobinPartitioning" in roads.unit_graph(rings, "id", "ring")._jdf.queryExecution().executedPlan().toString()
    assert roads.unit_graph(rings, "id", "ring").count() == 39 + 38 + 37


def test_street_measures_merge_parts_and_round_ends(spark):
    tiny = 1e-9
    streets = [
        ("u", 1, [(0.0, 0.0), (3.0, 0.0)]), ("u", 1, [(3.0, 4.0), (3.0, 0.0)]),  # parts of one line: extension 5
        ("u", 2, [(0.0, 0.0 + tiny), (1.0, 0.0)]), ("u", 2, [(9.0, 0.0), (10.0, 0.0)]),  # parts that do not join: 10
        ("u", 3, [(3.0, 4.0 - tiny), (10.0, tiny)]), ("u", 3, [(1.0, 1.0)]), ("u", 4, None), ("v", 1, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]),
        ("w", 1, [(0.0, 0.0), (2.0, 0.0)]), ("w", 1, [(1.0, 1.0), (1.0, 0.0)]), ("w", 1, [(2.0, 0.0), (2.0, 2.0)]),
    ]
    df = spark.createDataFrame(streets, f"unit string, id long, line array<{P}>")
    got = {(r.unit, round(r.length, 6)): (round(r.extension, 6), len(r.edges)) for r in roads.street_measures(df, "unit", "line", "id").collect()}
    assert got == {("u", 7.0): (5.0, 1), ("u", 2.0): (10.0, 2), ("u", round(math.hypot(7, 4), 6)): (round(math.hypot(7, 4), 6), 1), ("v", round(2 * math.sqrt(2), 6)): (0.0, 1), ("w", 5.0): (round(math.sqrt(8), 6), 2)}
    units = spark.createDataFrame([("u", 1e6), ("x", 1e6)], "unit string, area double")
    (u,) = nodes.street_indicators(df, units, "unit", "line", "area", "id").where("unit = 'u'").collect()
    # junctions (0,0), (3,4), (1,0), (9,0), (10,0); edges (0,0)-(3,4), (0,0)-(1,0), (9,0)-(10,0), (3,4)-(10,0)
    assert u.connectivity == pytest.approx(8 / 5) and u.meshedness == pytest.approx(0.0) and u.road_length_m == pytest.approx(9 + math.hypot(7, 4))
    assert roads._farthest([(0, 0), (1, 1), (2, 2), (0, 0)]) == pytest.approx(math.sqrt(8)) and roads._farthest([]) == 0.0 == roads._farthest([(1, 1)])
    assert roads.street_measures(df.limit(0), "unit", "line", "id").count() == 0


def test_short_pieces_go_to_the_next_line_of_a_road(spark):
    # the first line turns after 100 m and ends 10 m on, where the second begins; the last short piece has no next one
    lines = [[(0.0, 0.0), (100.0, 0.0), (100.0, 10.0)], [(100.0, 10.0), (160.0, 10.0)], [(500.0, 0.0), (540.0, 0.0), (540.0, 15.0)]]
    assert [(k, round(roads.length(p))) for k, p in roads.cut_lines(lines)] == [(0, 100), (0, 70), (2, 40)]
    assert [(k, round(roads.length(p))) for k, p in roads.cut_lines(lines[:1] + lines[2:])] == [(0, 100), (1, 40)]
    df = spark.createDataFrame([(1, lines), (2, None), (3, []), (4, [None])], f"road long, lines array<array<{P}>>")
    got = roads.cut_roads(df, "road", "lines").orderBy("piece").collect()
    assert [(r.road, r.part, r.piece, round(roads.length([(p.x, p.y) for p in r.line]))) for r in got] == [(1, 0, 0, 100), (1, 0, 1, 70), (1, 2, 2, 40)]


def test_houses_with_their_adjacency(spark):
    rows = [(k, square(x, 0, 10.0), 8.0) for k, x in enumerate([0, 10, 25, 200])] + [(9, [], 1.0)]
    df = spark.createDataFrame(rows, f"id long, ring array<{P}>, height double").withColumns({"p": G.length(F.col("ring")), "a": G.area(F.col("ring"))})
    got = {r.id: r.building_adj for r in nodes.buildings_morphology(df, "p", "a", "height", "id", "ring").collect()}
    assert got == {0: pytest.approx(2 / 3), 1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: 1.0, 9: None}
    inside = nodes.buildings_by_unit(df.withColumns({"unit": F.lit(1), "footprint_area": F.col("a")}), spark.createDataFrame([(1, 1000.0), (2, 10.0)], "unit int, total double"), "unit", ["height"], unit_area="total")
    assert {r.unit: (r.build_cover_area, r.build_cover_share) for r in inside.collect()} == {1: (400.0, 0.4), 2: (0.0, 0.0)}


def test_lines_clipped_to_polygons(spark):
    lines = spark.createDataFrame([(1, [(-1.0, 3.0), (7.0, 3.0)]), (2, [(5.0, 5.0), (5.0, 5.05)]), (3, None), (4, [(1.0, 1.0)])], f"id long, line array<{P}>")
    units = spark.createDataFrame([("a", [square(0, 0, 6.0), square(2, 2, 2.0)]), ("b", None), ("c", []), ("d", [square(4, 4, 2.0)])], f"unit string, ring array<array<{P}>>")
    got = sorted((r.unit, r.id, r.length, r.line[0].x) for r in roads.clip_lines_to_units(lines, units, "id", "line", "unit", "ring", 2.0).collect())
    assert got == [("a", 1, 2.0, 0.0), ("a", 1, 2.0, 4.0)]  # the second line is a sliver
    assert roads.clip_lines_to_units(lines.limit(0), units, "id", "line", "unit", "ring", 2.0).count() == 0
