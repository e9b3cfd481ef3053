"""Roads: tags, merging of segments, and splitting by bearing and length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..config import DUBLIN, Settings
from ..functions import geometry as G
from ..functions import pairs as pair_kernels
from ..functions import planar, polygons
from ..functions import strings as S
from .graphs import connected_components, cut_lineage
from .rows import dealt, map_rows, with_fields
from .shapes import flat
from .spatial import cover, in_cells, segments

#: Pieces of this length and less are dropped when a line is cut.
SLIVER = 0.1
#: Rows of the cells that near_links does in one task, as a mean; a cell is not divided.
LINK_ROWS = 20000
Line = list[tuple[float, float]]


def tag_columns(df: DataFrame, settings: Settings = DUBLIN) -> DataFrame:
    """Names as a study area's settings have them, lanes and speeds as least and greatest integers, tunnel and bridge as booleans, highway without 'unclassified'; tags are string lists."""
    numbers = lambda c: F.flatten(F.transform(c, S.integers))
    out = df.withColumns({
        "max_lanes": F.array_max(numbers("lanes")), "min_lanes": F.array_min(numbers("lanes")),
        "max_speed": F.array_max(numbers("maxspeed")), "min_speed": F.array_min(numbers("maxspeed")),
        "highway": S.without_unclassified(F.col("highway")), "tunnel": S.any_in(F.col("tunnel"), S.TUNNEL), "bridge": S.any_in(F.col("bridge"), S.BRIDGE),
        "names": S.road_names(F.col("name"), list(settings.directions), dict(settings.abbreviations), list(settings.road_words)),
    })
    return out.drop("lanes", "maxspeed")


def is_roundabout(junction: Column) -> Column:
    return F.coalesce(junction.isin("roundabout", "circular"), F.lit(False))


def split_junctions(df: DataFrame, junction: str = "junction") -> tuple[DataFrame, DataFrame]:
    """(roundabouts, other roads); a null tag is no roundabout."""
    return df.where(is_roundabout(F.col(junction))), df.where(~is_roundabout(F.col(junction)))


def is_closed(line: Column) -> Column:
    """Whether a line of four points at least ends where it begins."""
    return (F.size(line) > 3) & (F.element_at(line, 1) == F.element_at(line, -1))


def named(df: DataFrame, names: str = "names") -> DataFrame:
    """Roads that have a name."""
    return df.where(F.col(names).isNotNull() & (F.size(names) > 0))


def classified(streets: DataFrame, highway: str = "highway") -> DataFrame:
    """Streets that have a highway tag, with ``road_class``; tags are lists."""
    return streets.where(F.col(highway).isNotNull()).withColumn("road_class", S.road_class(F.col(highway)))


def same_lines(lines: DataFrame, key: str, line: str) -> DataFrame:
    """``a, b`` (a < b): lines with the same points in either direction."""
    one = lines.select(key, F.least(F.col(line), F.reverse(line)).alias("g"))
    l, r = one.alias("l"), one.alias("r")
    return l.join(r, F.col("l.g") == F.col("r.g")).where(F.col(f"l.{key}") < F.col(f"r.{key}")).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def merged_tags(df: DataFrame, component: str) -> DataFrame:
    """Tags of each merged road: extremes of numbers, sorted distinct lists, one-way only if all are, bridge or tunnel if any is."""
    lists = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) for c in ("names", "highway")}
    return df.groupBy(component).agg(
        F.max("max_lanes").alias("max_lanes"), F.min("min_lanes").alias("min_lanes"), F.max("max_speed").alias("max_speed"), F.min("min_speed").alias("min_speed"),
        *[F.when(F.size(x) > 0, x).alias(c) for c, x in lists.items()], F.bool_and("oneway").alias("oneway"), F.bool_or("tunnel").alias("tunnel"), F.bool_or("bridge").alias("bridge"),
    )


def name_sharing_pairs(segs: DataFrame, key: str, names: str, near: float) -> DataFrame:
    """``a, b``: roads (a < b) that share a name and have segment ends within a distance, by name and grid cell.

    segs: ``key, names, x1, y1, x2, y2``. The distance of the segments is that of their
    end points to the other segment, which is exact where segments do not cross.
    """
    return near_pairs(segs.withColumn("__n", F.explode(names)).drop(names), key, near, ["__n"])


def near_pairs(one: DataFrame, key: str, near: float, by: list[str], size: float = 0.0) -> DataFrame:
    """``a, b`` (a < b): keys with segments within a distance and equal columns ``by``; grid cells are ``size`` wide, 50 distances at least."""
    from ..functions.geometry import to_segment

    wide = cover(one, F.least("x1", "x2") - near, F.least("y1", "y2") - near, F.greatest("x1", "x2") + near, F.greatest("y1", "y2") + near, max(size, 50 * near, 1e-9))
    l, r = wide.alias("l"), wide.alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, "__cx", "__cy")]
    c = lambda s, n: F.col(f"{s}.{n}")
    d = F.least(*[to_segment(c(p, f"x{k}"), c(p, f"y{k}"), c(o, "x1"), c(o, "y1"), c(o, "x2"), c(o, "y2")) for p, o in (("l", "r"), ("r", "l")) for k in (1, 2)])
    crossing = _crosses(*[c(s, n) for s in ("l", "r") for n in ("x1", "y1", "x2", "y2")])
    return l.join(r, on).where((F.col(f"l.{key}") < F.col(f"r.{key}")) & ((d <= near) | crossing)).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b")).distinct()


def near_links(one: DataFrame, key: str, near: float, by: list[str], size: float = 0.0) -> DataFrame:
    """``a, b``: some of the pairs' keys of near_pairs, with the same components; at most a row for each key and cell.

    Where many segments cross, the pairs grow with the square of the rows. Here a task
    unites the segments of a cell and gives each key with its class's representative.
    The segments of a cell fit a task.
    """
    ends, of = ["x1", "y1", "x2", "y2"], [*by, "__cx", "__cy"]
    one = one.select(key, *by, *ends).dropna()
    wide = cover(one, F.least("x1", "x2") - near, F.least("y1", "y2") - near, F.greatest("x1", "x2") + near, F.greatest("y1", "y2") + near, max(size, 50 * near, 1e-9))
    tasks = max(1, math.ceil(wide.count() / LINK_ROWS))
    wide = wide.withColumn("__t", F.pmod(F.xxhash64(*of), F.lit(tasks))).repartition(tasks, "__t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, segs, a, b = pdf[key].to_numpy(), pdf[ends].to_numpy(float), [], []
        for some in pdf.groupby(of, sort=False).indices.values():
            node, every = pd.factorize(keys[some])
            if len(every) > 1:
                label = planar.linked(node, segs[some], near)
                moved = np.flatnonzero(label != np.arange(len(every)))
                a.extend(every[label[moved]])
                b.extend(every[moved])
        return pd.DataFrame({"a": a, "b": b})

    kind = dict(one.dtypes)[key]
    return wide.groupBy("__t").applyInPandas(run, f"a {kind}, b {kind}").distinct()


def _crosses(ax, ay, bx, by, cx, cy, dx, dy):
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def merge_roads(segs: DataFrame, key: str, names: str, near: float) -> DataFrame:
    """``key, road``: roads that share names and are near are merged, and their names united, until nothing changes: each round leaves fewer roads, or is the last."""
    segs = cut_lineage(segs.select(key, names, "x1", "y1", "x2", "y2"))
    label = segs.select(key, F.col(key).alias("road")).distinct()
    n = label.count()
    while True:
        of = segs.join(label, key)
        united = of.groupBy("road").agg(F.array_distinct(F.flatten(F.collect_list(names))).alias("__u"))
        now = of.join(united, "road").select(F.col("road").alias("__k"), F.col("__u").alias(names), "x1", "y1", "x2", "y2")
        pairs = near_links(now.withColumn("__n", F.explode(names)).drop(names), "__k", near, ["__n"])
        found = connected_components(pairs, label.select(F.col("road").alias("node")).distinct())
        label = cut_lineage(label.join(found, label["road"] == found["node"]).select(key, F.col("component").alias("road")))
        m = label.select("road").distinct().count()
        if m == n:
            return label
        n = m


def _line(points: list[dict]) -> Line:
    return [(p["x"], p["y"]) for p in points]


def _points(line: Line) -> list[dict]:
    return [{"x": x, "y": y} for x, y in line]


def line_merge(parts: list[Line]) -> list[Line]:
    """Lines joined wherever just two ends meet; the same set of lines gives the same result in any order or direction."""
    one = sorted({min(tuple(p), tuple(p[::-1])) for p in parts if len(p) > 1})
    at: dict[tuple, list[int]] = {}
    for k, p in enumerate(one):
        for e in (p[0], p[-1]):
            at.setdefault(e, []).append(k)
    out, used = [], set()

    def chain(k: int, start: tuple) -> Line:
        line = [start]
        while True:
            used.add(k)
            line += (one[k] if one[k][0] == line[-1] else one[k][::-1])[1:]
            free = [j for j in at[line[-1]] if j not in used]
            if len(at[line[-1]]) != 2 or not free:
                return line
            k = free[0]

    for cycles in (False, True):  # what is left after the open chains are rings
        for k, p in enumerate(one):
            for e in (p[0], p[-1]):
                if k not in used and (cycles or len(at[e]) != 2):
                    out.append(chain(k, e))
    return out


def _farthest(points: list[tuple]) -> float:
    """The distance of the farthest pair, which are corners of the hull."""
    hull = []
    for some in (sorted(set(points)), sorted(set(points), reverse=True)):
        half: list[tuple] = []
        for p in some:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        hull += half[:-1] if len(half) > 1 else half
    return max((math.dist(a, b) for k, a in enumerate(hull) for b in hull[k + 1 :]), default=0.0)


def street_measures(streets: DataFrame, unit: str, line: str, key: str | None = None) -> DataFrame:
    """``unit, length, extension, edges`` of each street; all rows of a unit and ``key`` are parts of one, else each row is a street.

    Parts are joined to lines where just two ends meet. If that gives one line, the
    extension is the distance between its ends, else that of the farthest pair of ends
    of the parts. Edges are the lines' ends ``(a, b)``, rounded to three places, half to
    even, so that ends which differ by rounding are one junction. Lines of fewer than
    two points are left out. A street's parts fit a task.
    """
    end = lambda k: F.struct(*[S.round_half_even(F.element_at(line, k)[c]).alias(c) for c in ("x", "y")])
    flat = [F.least(end(1), end(-1)).alias("a"), F.greatest(end(1), end(-1)).alias("b")]
    lines = streets.where(F.size(line) > 1)
    single = lambda df: df.select(unit, G.length(F.col(line)).alias("length"), G.extension(F.col(line)).alias("extension"), F.array(F.struct(*flat)).alias("edges"))
    if key is None:
        return single(lines)
    by = lines.groupBy(unit, key).agg(F.collect_list(line).alias("__parts"))
    many = by.where(F.size("__parts") > 1).select(unit, "__parts")

    def measure(row: dict):
        parts = [_line(part) for part in row["__parts"]]
        joined = line_merge(parts)
        ext = math.dist(joined[0][0], joined[0][-1]) if len(joined) == 1 else _farthest([p[k] for p in parts for k in (0, -1)])
        yield {unit: row[unit], "length": float(sum(map(length, parts))), "extension": ext, "lines": [_points(ln) for ln in joined]}

    of = map_rows(many, measure, with_fields(many, "length double, extension double, lines array<array<struct<x:double,y:double>>>", ("__parts",)))
    ends = lambda ln: [F.struct(*[S.round_half_even(F.element_at(ln, k)[c]).alias(c) for c in ("x", "y")]) for k in (1, -1)]
    edges = F.transform("lines", lambda ln: F.struct(F.least(*ends(ln)).alias("a"), F.greatest(*ends(ln)).alias("b")))
    return single(by.where(F.size("__parts") == 1).select(unit, F.col("__parts")[0].alias(line))).union(of.select(unit, "length", "extension", edges.alias("edges")))


def merged_lines(lines: DataFrame, label: DataFrame, key: str, line: str, road: str = "road") -> DataFrame:
    """``road, lines, length``: the joined lines of each merged road, from ``key, line`` and ``key, road``. A road's lines fit a task."""
    of = lines.select(key, line).join(label.select(key, road), key).where(F.size(line) > 1).groupBy(road).agg(F.collect_list(line).alias("__l"))

    def join(row: dict):
        joined = line_merge([_line(ln) for ln in row["__l"]])
        yield {road: row[road], "lines": [_points(ln) for ln in joined], "length": float(sum(map(length, joined)))}

    return map_rows(of, join, with_fields(of, "lines array<array<struct<x:double,y:double>>>, length double", ("__l",)))


def roundabouts(df: DataFrame, key: str, line: str, near: float = 1e-4, junction: str = "junction") -> DataFrame:
    """``road, lines, length, closed`` and merged tags of roundabouts: their contiguous parts are one.

    df has the columns of tag_columns. The tags come by the component's id.
    """
    parts, _ = split_junctions(df, junction)
    label = proximity_merge(segments(parts, key, line), key, near).select(F.col("node").alias(key), F.col("component").alias("road"))
    out = merged_lines(parts, label, key, line).join(merged_tags(parts.join(label, key), "road"), "road")
    return out.withColumn("closed", F.forall("lines", is_closed))


def road_network(df: DataFrame, key: str, line: str, settings: Settings = DUBLIN, near: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(roads, pieces) of raw streets ``key, line, junction, oneway`` and tags.

    Roads: ``road, lines, length, is_roundabout`` and merged tags; streets that share
    names and are near are one, streets without a name stay as they are. Pieces:
    ``road, part, piece, line, length``, cut by bearing and length; pieces are numbered
    by road, short ones go to the next of the same road.
    """
    tagged = tag_columns(df, settings)
    rings, others = split_junctions(tagged)
    with_name = named(others)
    joined = merge_roads(segments(with_name, key, line).drop("n").join(with_name.select(key, "names"), key), key, "names", near)
    alone = others.join(with_name.select(key), key, "left_anti").select(key, F.col(key).alias("road"))
    label = joined.unionByName(alone)
    roads = merged_lines(others, label, key, line).join(merged_tags(others.join(label, key), "road"), "road").withColumn("is_roundabout", F.lit(False))
    roads = roads.unionByName(roundabouts(rings, key, line).drop("closed").withColumn("is_roundabout", F.lit(True)))
    pieces = cut_roads(roads, "road", "lines", settings.bearing_split, settings.min_segment_m, settings.max_segment_m)
    return roads, pieces.select("road", "part", "piece", "line", G.length(F.col("line")).alias("length"))


def bearing(a: tuple, b: tuple) -> float:
    return math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 360


def split_by_bearing(line: Line, limit: float = 35.0) -> list[Line]:
    """Cut where consecutive bearings differ by more than the limit; the cut vertex is in both parts."""
    if len(line) < 3:
        return [line]
    out, part = [], [line[0], line[1]]
    for a, b, c in zip(line, line[1:], line[2:]):
        turn = abs(bearing(a, b) - bearing(b, c))
        if min(turn, 360 - turn) > limit:
            out.append(part)
            part = [b]
        part.append(c)
    return [*out, part]


def length(line: Line) -> float:
    return sum(math.dist(a, b) for a, b in zip(line, line[1:]))


def split_by_length(line: Line, most: float = 150.0) -> list[Line]:
    """Consecutive parts of at most this length; slivers are dropped."""
    out, part, left = [], [line[0]], most
    for b in line[1:]:
        a = part[-1]
        step = math.dist(a, b)
        while step > left:
            cut = (a[0] + (b[0] - a[0]) * left / step, a[1] + (b[1] - a[1]) * left / step)
            out.append([*part, cut])
            part, a, step, left = [cut], cut, step - left, most
        part.append(b)
        left -= step
    out.append(part)
    return [p for p in out if length(p) > SLIVER]


def _joined(a: Line, b: Line) -> Line | None:
    """One line of two that meet at an end."""
    for x in (a, a[::-1]):
        for y in (b, b[::-1]):
            if math.dist(x[-1], y[0]) < 1e-9:
                return [*x, *y[1:]]
    return None


def cut_lines(lines: list[Line], limit: float = 35.0, least: float = 20.0, most: float = 150.0) -> list[tuple[int, Line]]:
    """(line, part) of a road's lines in their order, split by bearing and length; a short part is merged with the next one, be it the next line's, where they meet; lines and parts that stay short are dropped."""
    parts = [(k, p) for k, line in enumerate(lines) if length(line) >= least for b in split_by_bearing(line, limit) for p in split_by_length(b, most)]
    out, skip = [], False
    for n, (k, part) in enumerate(parts):
        if skip:
            skip = False
            continue
        both = _joined(part, parts[n + 1][1]) if length(part) < least and n + 1 < len(parts) else None
        skip = both is not None
        out.append((k, both or part))
    return [(k, p) for k, p in out if length(p) >= least]


def cut_road(line: Line, limit: float = 35.0, least: float = 20.0, most: float = 150.0) -> list[Line]:
    """The parts of one line alone."""
    return [p for _, p in cut_lines([line], limit, least, most)]


def cut_roads(roads: DataFrame, key: str, lines: str, limit: float = 35.0, least: float = 20.0, most: float = 150.0) -> DataFrame:
    """``key, part, piece, line`` of every road, a line or an array of lines that follow one another; roads are cut each on its own. ``part`` is the line's place in its road."""
    flat = dict(roads.dtypes)[lines].count("array<") == 1
    of = roads.select(key, (F.array(lines) if flat else F.col(lines)).alias("__lines")).where("__lines IS NOT NULL")

    def cut(row: dict):
        parts = cut_lines([_line(ln) for ln in row["__lines"] if ln is not None], limit, least, most)
        for n, (part, p) in enumerate(parts):
            yield {key: row[key], "part": part, "piece": n, "line": _points(p)}

    return map_rows(of, cut, with_fields(of, "part int, piece int, line array<struct<x:double,y:double>>", ("__lines",)))


def clip_line(line: Line, ring: Line) -> list[Line]:
    """The parts of a line inside a simple ring."""
    return polygons.clip_line(line, [ring])


def inside(ring: Line, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def clip_polygon(ring: Line, convex: Line) -> Line:
    """A polygon cut to a convex one (closed, counter-clockwise), edge by edge; [] if nothing is left."""
    out = ring[:-1]
    for (ax, ay), (bx, by) in zip(convex, convex[1:]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        now, out = out, []
        for p, q in zip(now, now[1:] + now[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if (s > 0 > t) or (s < 0 < t):
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        if not out:
            return []
    return [*out, out[0]]


def triangles(ring: Line) -> list[Line]:
    """A simple closed ring as counter-clockwise closed triangles, ear by ear; flat corners are left out."""
    p = [tuple(q) for q in (ring if _twice_area(ring) > 0 else ring[::-1])[:-1]]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out: list[Line] = []
    while len(p) > 2:
        for k in range(len(p)):
            a, b, c = p[k - 1], p[k], p[(k + 1) % len(p)]
            t = turn(a, b, c)
            if t == 0 or (t > 0 and not any(q not in (a, b, c) and turn(a, b, q) >= 0 and turn(b, c, q) >= 0 and turn(c, a, q) >= 0 for q in p)):
                break
        else:
            raise ValueError("the ring crosses itself")
        if t > 0:
            out.append([a, b, c, a])
        del p[k]
    return out


def is_convex(ring: Line) -> bool:
    """Whether a counter-clockwise closed ring never turns right."""
    p = ring[:-1]
    return all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for a, b, c in zip(p, p[1:] + p[:1], p[2:] + p[:2]))


def common_area(feature: Line, unit: Line) -> float:
    """The area of a closed ring inside another; a unit that is not convex is taken triangle by triangle."""
    unit = unit if _twice_area(unit) > 0 else unit[::-1]
    cuts = [clip_polygon(feature, t) for t in ([unit] if is_convex(unit) else triangles(unit))]
    return sum(abs(_twice_area(c)) / 2 for c in cuts if c)


def clip_to_box(units: DataFrame, ring: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Units with their rings cut to (x, y, x, y); those that share no area with it are left out, also where they touch it, and other columns stay."""
    x1, y1, x2, y2 = box
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]

    def cut(points: list) -> list:
        left = clip_polygon([(q["x"], q["y"]) for q in points], corners)
        return [{"x": x, "y": y} for x, y in left] if polygons.twice_area(left) else []

    def run(parts):
        for pdf in parts:
            yield pdf.assign(**{ring: [cut(r) for r in pdf[ring]]})

    return units.where(F.size(ring) > 3).mapInPandas(run, units.schema).where(F.size(ring) > 3)


def clip_lines_to_units(lines: DataFrame, units: DataFrame, key: str, line: str, unit: str, ring: str, size: float) -> DataFrame:
    """``unit, key, line, length``: the parts of each line in each unit; of lines that have at most SLIVER in a unit, none.

    A unit is a ring or a polygon, an array of rings of which those inside another are
    holes. Grid cells of both boxes find the candidates. Null and empty shapes give no row.
    """
    def boxed(df: DataFrame, points: Column) -> DataFrame:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return cover(df, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), size)

    flat = dict(units.dtypes)[ring].count("array<") == 1
    mine = lines.where(F.size(line) > 1).select(F.col(key).alias("__key"), F.col(line).alias("__line"))
    of = units.select(F.col(unit).alias("__unit"), (F.array(ring) if flat else F.col(ring)).alias("__rings")).where(F.size(F.flatten("__rings")) > 0)
    found = boxed(mine, F.col("__line")).join(boxed(of, F.flatten("__rings")), ["__cx", "__cy"]).select("__unit", "__key").distinct()
    pairs = found.join(mine, "__key").join(of, "__unit").select("__unit", "__key", "__line", "__rings")

    def cut(row: dict):
        parts = polygons.clip_line(_line(row["__line"]), [_line(r) for r in row["__rings"]])
        if sum(map(length, parts)) > SLIVER:
            for p in parts:
                yield {"__unit": row["__unit"], "__key": row["__key"], "line": _points(p), "length": length(p)}

    out = map_rows(pairs, cut, with_fields(pairs, "line array<struct<x:double,y:double>>, length double", ("__line", "__rings")))
    return out.withColumnsRenamed({"__unit": unit, "__key": key})


def proximity_merge(segs: DataFrame, key: str, near: float = 1e-4) -> DataFrame:
    """``node, component``: lines that meet or come within a distance of one another, through others too."""
    return connected_components(near_links(segs, key, near, [], _mean_length(segs)), segs.select(key).distinct())


def unit_graph(units: DataFrame, key: str, ring: str, buffer: float = 0.0) -> DataFrame:
    """``a, b`` (a < b): units that, each widened by a buffer, touch: by their outlines, where distances stand for widened polygons, or as one lies inside the other."""
    near, kind = 2 * buffer, StructType([StructField(c, units.schema[key].dataType) for c in ("a", "b")])
    axis = lambda c: F.transform(ring, lambda p: p[c])
    boxes = {"__x1": F.array_min(axis("x")), "__y1": F.array_min(axis("y")), "__x2": F.array_max(axis("x")), "__y2": F.array_max(axis("y"))}
    of = dealt(units.select(key, ring)).where(F.col(key).isNotNull() & (F.size(ring) > 0)).select(F.col(key).alias("__key"), F.array(ring).alias("__rings"), *[c.alias(n) for n, c in boxes.items()])
    wide = of.agg(F.avg(F.greatest(F.col("__x2") - F.col("__x1"), F.col("__y2") - F.col("__y1"))).alias("w"), (F.count("*") == F.count_distinct("__key")).alias("own")).first()
    widened = of.withColumns({c: F.col(c) + (near if c.endswith("2") else -near) for c in boxes})

    def run(l: pa.Table, r: pa.Table, pairs: Iterator, _: tuple) -> Iterator[pa.Table]:
        one, other = (pair_kernels.Outlines.of(flat(t.column("__rings").combine_chunks())) for t in (l, r))
        a, b = (t.column("__key").to_numpy() for t in (l, r))
        for i, j in pairs:
            some = np.flatnonzero(a[i] < b[j])
            some = some[pair_kernels.touching(one, other, i[some], j[some], near)]
            yield pa.table({"a": l.column("__key").take(pa.array(i[some])), "b": r.column("__key").take(pa.array(j[some]))})

    found = in_cells(of, widened, max(wide.w or 1.0, 4 * near), run, kind)
    return found if wide.own else found.distinct()


def _mean_length(segs: DataFrame) -> float:
    """A width of cells in which a segment touches few of them."""
    return segs.agg(F.avg(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))).first()[0] or 1.0


def overlay(features: DataFrame, units: DataFrame, key: str, ring: str, unit: str, unit_ring: str, size: float, kept: list[str] | None = None) -> DataFrame:
    """``unit, key, <kept>, area``: the area of each feature inside each unit; grid cells of both boxes find the candidates."""
    def boxed(df: DataFrame, g: str) -> DataFrame:
        xs, ys = F.transform(g, lambda p: p["x"]), F.transform(g, lambda p: p["y"])
        return cover(df, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), size)

    kept, u_ring = kept or [], units.select(unit, F.col(unit_ring).alias("__unit_ring"))
    found = boxed(features.select(key, ring), ring).join(boxed(u_ring, "__unit_ring"), ["__cx", "__cy"]).select(unit, key).distinct()
    pairs = found.join(features.select(key, *kept, F.col(ring).alias("__ring")), key).join(u_ring, unit)

    def run(parts):
        for pdf in parts:
            area = []
            for a, b in zip(pdf["__ring"], pdf["__unit_ring"]):
                area.append(common_area([(q["x"], q["y"]) for q in a], [(q["x"], q["y"]) for q in b]))
            yield pdf.drop(columns=["__ring", "__unit_ring"]).assign(area=area)

    out = pairs.select(unit, key, *kept, "__ring", "__unit_ring")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if not f.name.startswith("__"))
    return out.mapInPandas(run, f"{schema}, area double").where("area > 0")


def _twice_area(ring: Line) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def touching(segs: DataFrame, key: str, near: float = 0.0) -> DataFrame:
    """``a, b``: lines that share an end point, or with ``near`` have end points in one cell of that width or its neighbours and within it."""
    ends = segs.select(key, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(key, "p.x", "p.y").distinct()
    if not near:
        l, r = ends.alias("l"), ends.alias("r")
        return l.join(r, [F.col("l.x") == F.col("r.x"), F.col("l.y") == F.col("r.y")]).where(F.col(f"l.{key}") < F.col(f"r.{key}")).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b")).distinct()
    wide = cover(ends, F.col("x") - near, F.col("y") - near, F.col("x") + near, F.col("y") + near, 4 * near)
    l, r = wide.alias("l"), wide.alias("r")
    d = F.sqrt(F.pow(F.col("l.x") - F.col("r.x"), 2) + F.pow(F.col("l.y") - F.col("r.y"), 2))
    return l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("__cx", "__cy")]).where((F.col(f"l.{key}") < F.col(f"r.{key}")) & (d <= near)).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b")).distinct()


def street_profile(streets: DataFrame, walls: DataFrame, unit: str, every: float = 50.0, tick: float = 50.0) -> DataFrame:
    """Mean street profile by unit: width, openness, deviations, height and height-width ratio.

    streets: ``unit, x1, y1, x2, y2``; walls: building edges ``x1, y1, x2, y2, height``.
    Ticks stand across each street every ``every`` metres; each side's nearest wall
    within half a tick gives the width, a side without one counts as half a tick.
    """
    s = streets.withColumn("__l", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))).where("__l > 0").withColumn("__s", F.monotonically_increasing_id())
    t = s.withColumn("__at", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("__l") / every).cast("int")), lambda k: k * every)))
    half = tick / 2
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("__l"), (F.col("y2") - F.col("y1")) / F.col("__l")
    t = t.select(unit, "__s", "__at", (F.col("x1") + ux * F.col("__at")).alias("px"), (F.col("y1") + uy * F.col("__at")).alias("py"), ux.alias("ux"), uy.alias("uy"))
    t = t.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumns({"qx": F.col("px") - F.col("uy") * half * F.col("side"), "qy": F.col("py") + F.col("ux") * half * F.col("side")})
    size = max(tick, 1.0)
    a = cover(t, F.least("px", "qx"), F.least("py", "qy"), F.greatest("px", "qx"), F.greatest("py", "qy"), size)
    b = cover(walls, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
    c = F.col
    den = (c("qx") - c("px")) * (c("y2") - c("y1")) - (c("qy") - c("py")) * (c("x2") - c("x1"))
    along = F.try_divide((c("x1") - c("px")) * (c("y2") - c("y1")) - (c("y1") - c("py")) * (c("x2") - c("x1")), den)
    across = F.try_divide((c("x1") - c("px")) * (c("qy") - c("py")) - (c("y1") - c("py")) * (c("qx") - c("px")), den)
    hits = a.join(b, ["__cx", "__cy"]).where(along.between(0, 1) & across.between(0, 1)).groupBy("__s", "__at", "side").agg(F.min(F.struct((along * half).alias("d"), F.col("height").alias("h"))).alias("hit"))
    ticks = t.join(hits, ["__s", "__at", "side"], "left").groupBy(unit, "__s", "__at").agg(F.sum(F.coalesce(c("hit.d"), F.lit(half))).alias("w"), F.avg("hit.h").alias("h"), F.avg(c("hit").isNull().cast("double")).alias("open"))
    each = ticks.groupBy(unit, "__s").agg(F.avg("w").alias("width"), F.avg("open").alias("openness"), F.stddev_pop("w").alias("width_deviation"), F.avg("h").alias("height"), F.stddev_pop("h").alias("height_deviation"))
    each = each.withColumn("hw_ratio", F.try_divide("height", "width"))
    return each.groupBy(unit).agg(*[F.avg(n).alias(n) for n in ("width", "openness", "width_deviation", "height", "height_deviation", "hw_ratio")])


def raster_regions(pixels: DataFrame) -> DataFrame:
    """``row, col, value, region``: 4-connected pixels of equal value; null pixels are left out."""
    p = pixels.where(F.col("value").isNotNull()).select("row", "col", "value", F.concat_ws(":", F.lpad(F.col("row").cast("string"), 9, "0"), F.lpad(F.col("col").cast("string"), 9, "0")).alias("node"))
    l, r = p.alias("l"), p.alias("r")
    near = lambda dr, dc: l.join(r, [F.col("l.value") == F.col("r.value"), F.col("l.row") + dr == F.col("r.row"), F.col("l.col") + dc == F.col("r.col")]).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    of = connected_components(near(0, 1).union(near(1, 0)), p.select("node"))
    return p.join(of, "node").select("row", "col", "value", F.col("component").alias("region"))


#: Steps around a pixel with the pixel on the right: the corner where each begins, as (row, col) from the pixel's own, by direction east, south, west, north.
STEPS = [(0, 0), (0, 1), (1, 1), (1, 0)]


def region_outlines(regions: DataFrame) -> DataFrame:
    """``region, value, way, a_row, a_col, b_row, b_col``: the straight parts of the regions' outlines, the region on the right.

    Steps between two pixels of a region cancel, the others are joined as far as they go straight.
    """
    steps = F.array(*[F.struct(F.lit(way).alias("way"), (F.col("row") + r).alias("r"), (F.col("col") + c).alias("c")) for way, (r, c) in enumerate(STEPS)])
    step = regions.select("region", "value", F.explode(steps).alias("s")).select("region", "value", "s.way", "s.r", "s.c")
    flat = F.col("way") % 2 == 0
    step = step.select("region", "value", "way", F.when(flat, F.col("r")).otherwise(F.col("c")).alias("on"), (F.when(flat, F.col("c")).otherwise(F.col("r")) - (F.col("way") >= 2).cast("int")).alias("at"), flat.alias("flat"))
    once = step.groupBy("region", "value", "flat", "on", "at").agg(F.min("way").alias("way"), F.count("*").alias("n")).where("n = 1")
    by = W.partitionBy("region", "value", "flat", "on", "way").orderBy("at")
    part = once.withColumn("part", F.col("at") - F.row_number().over(by)).groupBy("region", "value", "flat", "on", "way", "part").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    back = F.col("way") >= 2
    a, b = F.when(back, F.col("high")).otherwise(F.col("low")), F.when(back, F.col("low")).otherwise(F.col("high"))
    place = lambda v: (F.when(F.col("flat"), F.col("on")).otherwise(v), F.when(F.col("flat"), v).otherwise(F.col("on")))
    (ar, ac), (br, bc) = place(a), place(b)
    return part.select("region", "value", "way", ar.alias("a_row"), ac.alias("a_col"), br.alias("b_row"), bc.alias("b_col"))


def outline_rings(parts: list[tuple]) -> list[list[tuple[int, int]]]:
    """Closed rings of corners from ``(way, a_row, a_col, b_row, b_col)``; where a region touches itself at a corner, the ring turns right and so stays with its pixel."""
    begin = {}
    for way, *corners in sorted(parts):
        begin.setdefault(tuple(corners[:2]), {})[way] = tuple(corners[2:])
    rings = []
    for first in sorted(begin):
        while begin[first]:
            way, ring, here = min(begin[first]), [first], first
            while begin[here]:
                way = (way + 1) % 4 if len(ring) > 1 and (way + 1) % 4 in begin[here] else way if way in begin[here] else min(begin[here])
                here = begin[here].pop(way)
                ring.append(here)
                if here == first:
                    break
            rings.append(ring)
    return rings


def raster_polygons(regions: DataFrame, x0: float = 0.0, y0: float = 0.0, width: float = 1.0, height: float = -1.0) -> DataFrame:
    """``region, value, hole, ring, area``: the rings around the regions of ``raster_regions``, and those around their holes.

    x0, y0: the place of the raster's first corner; width, height: the size of a pixel,
    the height negative where rows go south. The corners of one region (a building,
    of straight parts) are chained in a task, its pixels are not. No pixels give no rings.
    """
    of = region_outlines(regions).groupBy("region", "value").agg(F.collect_list(F.struct("way", "a_row", "a_col", "b_row", "b_col")).alias("parts"))

    def run(frames):
        for pdf in frames:
            out = []
            for region, value, parts in zip(pdf["region"], pdf["value"], pdf["parts"]):
                for ring in outline_rings([(p["way"], p["a_row"], p["a_col"], p["b_row"], p["b_col"]) for p in parts]):
                    turned = _twice_area([(float(c), float(r)) for r, c in ring]) / 2
                    out.append((region, value, turned < 0, [{"x": x0 + c * width, "y": y0 + r * height} for r, c in ring], abs(turned * width * height)))
            yield pd.DataFrame(out, columns=["region", "value", "hole", "ring", "area"])

    return of.mapInPandas(run, f"region string, value {dict(regions.dtypes)['value']}, hole boolean, ring array<struct<x:double,y:double>>, area double")


def building_adjacency(edges: DataFrame, centroids: DataFrame, key: str, band: float = 50.0) -> DataFrame:
    """``key, adjacency``: the joined structures among the buildings within a band, divided by these buildings.

    edges: ``key, x1, y1, x2, y2`` of building outlines; shared edges join buildings.
    """
    from .spatial import distance_band

    a, b = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2))
    one = edges.select(key, F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    l, r = one.alias("l"), one.alias("r")
    shared = l.join(r, [F.col("l.p") == F.col("r.p"), F.col("l.q") == F.col("r.q")]).where(F.col(f"l.{key}") < F.col(f"r.{key}")).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))
    of = connected_components(shared, centroids.select(F.col(key).alias("node")))
    near = distance_band(centroids, key, "x", "y", band).select("focal", "neighbor").union(centroids.select(F.col(key), F.col(key)))
    return near.join(of, F.col("neighbor") == F.col("node")).groupBy(F.col("focal").alias(key)).agg((F.countDistinct("component") / F.count("*")).alias("adjacency"))
