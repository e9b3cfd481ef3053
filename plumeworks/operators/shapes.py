"""Clipped and widened shapes: polygons with holes against units, and buffers of roads.

A shape is a ring (an array of points) or a polygon (an array of rings, outer ring and
holes in any order and direction). A result's ``parts`` are polygons, each an outer ring
and then its holes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import arrangements as A
from ..functions import pairs as K
from ..functions import polygons as P
from .rows import dealt, map_rows, with_fields
from .spatial import cell, cover, in_cells

PARTS = "array<array<array<struct<x:double,y:double>>>>"


def rings(df: DataFrame, shape: str) -> Column:
    """The shape as a polygon."""
    return F.array(F.col(shape)) if dict(df.dtypes)[shape].count("array<") == 1 else F.col(shape)


def boxed(df: DataFrame, polygon: str, size: float, low: tuple[str, str] | None = None) -> DataFrame:
    """A row for each grid cell that a polygon's box touches; shapes without points have none. low: names of columns for the box's least corner."""
    flat = F.flatten(polygon)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    of = df.where(F.size(flat) > 0)
    of = of.withColumns({low[0]: F.array_min(xs), low[1]: F.array_min(ys)}) if low else of
    return cover(of, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), size)


def _plain(polygon) -> P.Polygon:
    return [[(p["x"], p["y"]) for p in ring] for ring in polygon]


def _rows(parts: list[P.Polygon]) -> list:
    return [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


def flat(polygons: pa.ListArray) -> A.Shapes:
    """A column of polygons as arrays."""
    levels, of = [], polygons
    for _ in range(2):
        offsets = of.offsets.to_numpy().astype(int)
        levels.append(offsets - offsets[0])
        of = of.values.slice(offsets[0], offsets[-1] - offsets[0])
    return A.Shapes(np.c_[tuple(c.to_numpy(zero_copy_only=False) for c in of.flatten())].astype(float), levels[1], levels[0], np.arange(len(polygons) + 1))


def _nested(s: A.Shapes) -> pa.ListArray:
    """A group's polygons in each row."""
    of = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in s.points.T], ["x", "y"])
    for offsets in (s.rings, s.polygons, s.groups):
        of = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), of)
    return of


def _combined(df: DataFrame, without: tuple[str, ...], shapes_: Callable[[pa.RecordBatch], A.Shapes], every: bool) -> DataFrame:
    """df without some columns and with ``parts, area`` of the shapes that a batch gives for each row; with ``every``, rows without parts are left out."""
    kind = with_fields(df, f"parts {PARTS}, area double", without)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch.select([n for n in arrow.names if n in batch.schema.names and n not in ("parts", "area")])
            for at, parts, area in A.in_runs(shapes_(batch), every):
                of = kept.slice(at, len(area))
                out = pa.Table.from_arrays([*of.columns, _nested(parts), pa.array(area)], [*of.schema.names, "parts", "area"])
                out = out.filter(pa.array(np.diff(parts.groups) > 0)) if every else out
                yield from out.select(arrow.names).cast(arrow).to_batches()

    return df.mapInArrow(run, kind)


def clip_polygons(features: DataFrame, units: DataFrame, key: str, shape: str, unit: str, unit_shape: str, size: float, kept: list[str] | None = None, drawn: bool = True) -> DataFrame:
    """``unit, key, <kept>, parts, area``: each feature cut to each unit that it shares an area with.

    Grid cells of ``size`` that both boxes touch find the pairs, each in the cell where
    the boxes' common corner is; pairs are cut in tasks, many at once. Null and empty
    shapes, and pairs that only touch, give no row; rows are features and units of their
    own, also where keys are repeated. Empty tables give none. drawn: without it there
    are no ``parts``, and areas come from the edges of both, see pairs.common_areas.
    """
    kept = kept or []
    mine = features.select(F.col(key).alias("__key"), *kept, rings(features, shape).alias("__shape")).where(F.col("__shape").isNotNull())
    of = units.select(F.col(unit).alias("__unit"), rings(units, unit_shape).alias("__mask")).where(F.col("__mask").isNotNull())
    if not drawn:
        return _areas(mine, of, kept, size).withColumnsRenamed({"__unit": unit, "__key": key})
    found = boxed(dealt(mine), "__shape", size, ("__x", "__y")).join(boxed(of, "__mask", size, ("__u", "__v")), ["__cx", "__cy"])
    first = (cell(F.greatest("__x", "__u"), size) == F.col("__cx")) & (cell(F.greatest("__y", "__v"), size) == F.col("__cy"))
    pairs = found.where(first).select("__unit", "__key", *kept, "__shape", "__mask")
    both = lambda batch: flat(batch.column("__shape")).side_by_side(flat(batch.column("__mask")))
    return _combined(pairs, ("__shape", "__mask"), both, True).withColumnsRenamed({"__unit": unit, "__key": key})


def _areas(mine: DataFrame, of: DataFrame, kept: list[str], size: float) -> DataFrame:
    """``__unit, __key, <kept>, area`` of each pair that shares an area."""
    kind = StructType([of.schema["__unit"], mine.schema["__key"], *[mine.schema[c] for c in kept], StructField("area", DoubleType())])
    names = [f.name for f in kind[1:-1]]

    def with_box(df: DataFrame, polygon: str) -> DataFrame:
        xs, ys = (F.transform(F.flatten(polygon), lambda p: p[axis]) for axis in ("x", "y"))
        of = {"__x1": F.array_min(xs), "__y1": F.array_min(ys), "__x2": F.array_max(xs), "__y2": F.array_max(ys)}
        return df.where(F.size(F.flatten(polygon)) > 0).withColumns(of)

    def run(l: pa.Table, r: pa.Table, pairs: Iterator, corner: tuple[float, float]) -> Iterator[pa.Table]:
        one, other = (K.Areas(flat(t.column(c).combine_chunks()), corner) for t, c in ((l, "__shape"), (r, "__mask")))
        left, right = l.select(names).combine_chunks(), r.select(["__unit"]).combine_chunks()
        for i, j in pairs:
            area = K.common_areas(one, other, i, j)
            some = np.flatnonzero(area)
            yield pa.table([*right.take(pa.array(j[some])).columns, *left.take(pa.array(i[some])).columns, pa.array(area[some])], kind.names)

    return in_cells(with_box(dealt(mine), "__shape"), with_box(of, "__mask"), size, run, kind)


def buffers(df: DataFrame, key: str, lines: str, radius: float, quarter: int = 16, filled: bool = False) -> DataFrame:
    """``key, parts, area``: all places within a radius of each row's line, or array of lines, with round joins of ``4 * quarter`` sides a circle.

    filled: the lines are rings of a shape, and what is inside them counts too. A row's
    lines are widened in one task, many rows at once. Null and empty lines give no row.
    """
    of = df.select(F.col(key).alias("__key"), rings(df, lines).alias("__lines")).where(F.size(F.flatten("__lines")) > 0)
    widened = lambda batch: A.Shapes.of([P.pieces(_plain(x), radius, quarter, filled) for x in batch.column("__lines").to_pylist()])
    return _combined(dealt(of), ("__lines",), widened, False).withColumnRenamed("__key", key)


def merged(df: DataFrame, by: str, parts: str) -> DataFrame:
    """``by, parts, area``: the union of a group's polygons. A group's polygons fit a task."""
    of = df.groupBy(by).agg(F.flatten(F.collect_list(parts)).alias("__parts"))

    def unite(row: dict):
        one = P.union([_plain(p) for p in row["__parts"]])
        yield {by: row[by], "parts": _rows(one), "area": P.area(one)}

    return map_rows(of, unite, with_fields(of, f"parts {PARTS}, area double", ("__parts",)))
