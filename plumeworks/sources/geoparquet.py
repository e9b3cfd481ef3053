"""GeoParquet: geometries as WKB with the ``geo`` metadata of a file, and a box column by which files and row groups are left out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import wkb
from ..operators.rows import map_rows, with_fields
from .storage import storage

VERSION = "1.1.0"
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
POINT = "struct<x:double,y:double>"
#: A column's type by the geometry that it holds.
SHAPES = {POINT: wkb.POINT, f"array<{POINT}>": wkb.LINE, f"array<array<{POINT}>>": wkb.POLYGON, f"array<array<array<{POINT}>>>": wkb.MULTI_POLYGON}
#: Rows of a row group at most.
ROWS = 50_000


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written."""

    names: list[str]


class GeoParquetSink(DataSource):
    """Writes rows with a WKB column; options ``path``, ``geo`` (the metadata as JSON), ``rows`` of a row group. A task's file is moved to its place when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "geoparquetsink"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return GeoParquetWriter(self.options["path"], self.options["geo"], int(self.options.get("rows", ROWS)))


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, geo: str, rows: int):
        self.path, self.geo, self.rows, self.run = path, geo, rows, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = storage(self.path)
        name, out, held, n = f"part-{uuid.uuid4().hex}.parquet", None, [], 0

        def flush() -> None:
            nonlocal held, n
            out.write_table(pa.Table.from_batches(held).replace_schema_metadata(out.schema.metadata), row_group_size=self.rows)
            held, n = [], 0

        for batch in iterator:
            if out is None:
                fs.create_dir(f"{path}/_temporary-{self.run}", recursive=True)
                schema = batch.schema.with_metadata({b"geo": self.geo.encode()})
                out = pq.ParquetWriter(fs.open_output_stream(f"{path}/_temporary-{self.run}/{name}", compression=None), schema)
            held.append(batch)
            n += batch.num_rows
            if n >= self.rows:
                flush()
        if out is None:
            return Written([])
        if held:
            flush()
        out.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = storage(self.path)
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{path}/_temporary-{self.run}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, path = storage(self.path)
        if any(f.path.endswith(f"_temporary-{self.run}") for f in fs.get_file_info(FileSelector(path, allow_not_found=True))):
            fs.delete_dir(f"{path}/_temporary-{self.run}")


def _flat(geometry, depth: int) -> list:
    return [geometry] if depth == 0 else [p for g in geometry for p in _flat(g, depth - 1)]


def encoded(df: DataFrame, geometry: str) -> DataFrame:
    """df with its geometry as WKB and ``bbox``; a null geometry has a null box, one without points too. A given column ``bbox`` is replaced."""
    kind = SHAPES[df.schema[geometry].dataType.simpleString()]
    depth = {wkb.POINT: 0, wkb.LINE: 1, wkb.POLYGON: 2, wkb.MULTI_POLYGON: 3}[kind]
    plain = lambda g, d: (g["x"], g["y"]) if d == 0 else [plain(x, d - 1) for x in g]

    def one(row: dict):
        g = row[geometry]
        given = None if g is None else plain(g, depth)
        points = [] if g is None else _flat(given, depth)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        box = {"xmin": min(xs), "ymin": min(ys), "xmax": max(xs), "ymax": max(ys)} if points else None
        yield row | {geometry: None if g is None else wkb.encode(given, kind), "bbox": box}

    of = df.drop("bbox")
    return map_rows(of, one, with_fields(of, f"`{geometry}` binary, bbox {BOX}", (geometry,)))


def write_geoparquet(df: DataFrame, path: str, geometry: str, crs: dict | None = None, rows: int = ROWS) -> None:
    """Adds df's rows as GeoParquet files under ``path``; crs: a PROJJSON object, none for longitude and latitude of WGS 84."""
    kind = SHAPES[df.schema[geometry].dataType.simpleString()]
    column = {"encoding": "WKB", "geometry_types": [wkb.NAMES[kind]], "covering": {"bbox": {c: ["bbox", c] for c in ("xmin", "ymin", "xmax", "ymax")}}}
    geo = {"version": VERSION, "primary_column": geometry, "columns": {geometry: column | ({"crs": crs} if crs else {})}}
    df.sparkSession.dataSource.register(GeoParquetSink)
    encoded(df, geometry).write.format("geoparquetsink").mode("append").option("geo", json.dumps(geo)).option("rows", rows).save(path)


def metadata(path: str) -> dict:
    """The ``geo`` metadata of the first file under a path."""
    fs, at = storage(path)
    first = min((f.path for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")), default=None)
    if first is None:
        raise ValueError(f"there is no Parquet file under {path}")
    return json.loads(pq.read_metadata(first, filesystem=fs).metadata[b"geo"])


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Whether a row's box meets (xmin, ymin, xmax, ymax): comparisons that the scan takes over."""
    x1, y1, x2, y2 = box
    return (F.col("bbox.xmin") <= x2) & (F.col("bbox.xmax") >= x1) & (F.col("bbox.ymin") <= y2) & (F.col("bbox.ymax") >= y1)


def read_geoparquet(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, decode: bool = True) -> DataFrame:
    """The rows, those with a box that meets ``box`` if one is given; with ``decode`` the geometry as points, lines, rings or polygons instead of WKB."""
    of = spark.read.parquet(path)
    of = of.where(in_box(box)) if box else of
    if not decode:
        return of
    geometry = metadata(path)["primary_column"]
    kinds = metadata(path)["columns"][geometry]["geometry_types"]
    kind = next(t for t, k in SHAPES.items() if kinds == [wkb.NAMES[k]])

    def points(g, depth: int):
        return {"x": g[0], "y": g[1]} if depth == 0 else [points(x, depth - 1) for x in g]

    depth = kind.count("array<")
    return map_rows(of, lambda row: [row | {geometry: None if row[geometry] is None else points(wkb.decode(row[geometry])[1], depth)}], with_fields(of, f"`{geometry}` {kind}", (geometry,)))
