"""Files: CSV, GeoParquet, GeoJSON, GeoPackage, GeoTIFF, paged JSON; versioned and text sinks."""

from __future__ import annotations

import json
import sqlite3
import struct
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raster import GeoTiff

AIR = "gps_timestamp string, latitude double, longitude double, NO2_ugm3 double"
TRAFFIC = "End_Time string, Site string, Sum_Volume double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_geojson(spark: SparkSession, path: str, properties: str = "") -> DataFrame:
    """``type, coordinates`` (as JSON) and the named properties of each feature."""
    of = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>")["features"]).alias("f"))
    return of.select("f.geometry.type", "f.geometry.coordinates", *(["f.properties.*"] if properties else []))


def read_geojson_lines(spark: SparkSession, path: str, properties: str = "") -> DataFrame:
    """The same from files with a feature on each line: sequences of features, or collections written so, whose first and last lines are left out.

    Lines are dealt to tasks, so that a file of any size is read by many. A line that is
    neither a feature nor the frame of a collection raises, as read_geojson would be needed.
    """
    schema = f"type string, geometry struct<type:string,coordinates:string>, properties struct<{properties}>"
    text = F.regexp_replace(F.trim(F.regexp_replace("value", "[\x1e\r]", "")), ",$", "")
    of = spark.read.text(path).select(text.alias("t")).where("t <> ''").withColumn("f", F.from_json("t", schema))
    frame = F.col("t").rlike(r'^\{[^{}]*"features"\s*:\s*\[$') | F.col("t").rlike(r"^[\]\[{}]+$") | F.col("t").rlike(r'^"(type|name|bbox|crs)"\s*:') | F.col("t").rlike(r'^"features"\s*:\s*\[$')
    checked = F.when(F.col("f.type") == "Feature", F.col("f")).when(~frame, F.raise_error(F.concat(F.lit("a line is no feature: "), F.substring("t", 1, 80))).cast(f"struct<{schema.replace(' string', ':string').replace(' struct', ':struct')}>"))
    return of.select(checked.alias("f")).where("f IS NOT NULL").select("f.geometry.type", "f.geometry.coordinates", *(["f.properties.*"] if properties else []))


def polygon_ring(coordinates) -> Column:
    """The outer ring of a GeoJSON polygon."""
    rings = F.from_json(coordinates, "array<array<array<double>>>")
    return F.transform(rings[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def point(coordinates) -> Column:
    p = F.from_json(coordinates, "array<double>")
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def write_version(df: DataFrame, path: str, version: str | None = None) -> str:
    """A new version beside the earlier ones."""
    version = version or time.strftime("%Y-%m-%dT%H.%M.%S", time.gmtime()) + f".{time.time_ns() % 10**9:09d}Z"
    df.write.parquet(f"{path}/version={version}")
    return version


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the greatest version; other versions' files are not read."""
    of = spark.read.option("basePath", path).parquet(path)
    last = of.agg(F.max(F.col("version").cast("string")).alias("v")).first()["v"]
    return of.where(F.col("version").cast("string") == last).drop("version")


def write_text(df: DataFrame, path: str) -> None:
    """Rows of one string column, as lines of one file; for summaries of a few rows."""
    df.coalesce(1).write.text(path)


def wkb_points(blob: bytes) -> list[list[tuple[float, float]]]:
    """The rings, lines or points of a WKB geometry, parts one after another."""
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(fmt, blob, at)
        at += struct.calcsize(fmt)
        return out

    def one() -> list[list[tuple[float, float]]]:
        order = "<" if take("B")[0] else ">"
        kind = take(order + "I")[0]
        dims = 2 + (kind // 1000 % 10 in (1, 2)) + 2 * (kind // 1000 % 10 == 3)
        points = lambda n: [take(order + f"{dims}d")[:2] for _ in range(n)]
        match kind % 1000:
            case 1:
                return [points(1)]
            case 2:
                return [points(take(order + "I")[0])]
            case 3:
                return [points(take(order + "I")[0]) for _ in range(take(order + "I")[0])]
            case _:
                return [p for _ in range(take(order + "I")[0]) for p in one()]

    return one()


class GeoPackage(DataSource):
    """A layer of a GeoPackage: ``fid, geometry`` (WKB) and its other columns as strings."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _columns(self) -> list[str]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            return [r[1] for r in db.execute(f'PRAGMA table_info("{self.options["layer"]}")')]

    def schema(self) -> str:
        return ", ".join(f"`{c}` {'binary' if c == self.options.get('geometry', 'geom') else 'string'}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _GeoPackageReader(self.options, self._columns())


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["layer"]}"').fetchone()
        if low is None:
            return []
        step = int(self.options.get("rows", 100_000))
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        geometry = self.columns.index(g) if (g := self.options.get("geometry", "geom")) in self.columns else -1
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.options["layer"]}" WHERE rowid >= ? AND rowid < ?', partition.value):
                yield tuple(_without_header(v) if k == geometry else None if v is None else str(v) for k, v in enumerate(row))


def _without_header(blob: bytes | None) -> bytes | None:
    """The WKB after a GeoPackage header, whose flags tell the size of its envelope."""
    return None if blob is None else bytes(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])


def paged(first: str, fetch: Callable[[str], str] | None = None, link: str = "@iot.nextLink") -> Iterator[dict]:
    """The values of a paged REST answer, page after page; ``fetch`` gives a URL's body."""
    fetch = fetch or (lambda url: urllib.request.urlopen(url, timeout=60).read().decode())  # noqa: S310
    url: str | None = first
    while url:
        page = json.loads(fetch(url))
        yield from page.get("value", [])
        url = page.get(link)


class PagedJson(DataSource):
    """Values of paged REST answers as ``url, value`` (JSON text); option ``urls``: first pages as a JSON list, each read by a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "pagedjson"

    def schema(self) -> str:
        return "url string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(json.loads(self.options["urls"]), self.options.get("link", "@iot.nextLink"))


class _PagedReader(DataSourceReader):
    def __init__(self, urls: list[str], link: str):
        self.urls, self.link = urls, link

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for v in paged(partition.value, link=self.link):
            yield partition.value, json.dumps(v)


def time_spans(base: str, field: str, times: list[str], top: int = 1000) -> list[str]:
    """A URL for each span between neighbouring ISO times, filtered on ``field`` and with pages of ``top`` rows."""
    spans = [urllib.parse.urlencode({"$top": top, "$filter": f"{field} ge {a} and {field} lt {b}"}) for a, b in zip(times, times[1:])]
    return [f"{base}?{s}" for s in spans]


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """``id, line, junction, oneway`` and tag lists of the ways in landed map answers (JSON files with ``elements``); coordinates are (lon, lat).

    A list of tags is text divided by ``;``. Nothing is downloaded here; ``land`` does that.
    """
    of = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "elements array<struct<type:string,id:long,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>")["elements"]).alias("e"))
    tag = lambda k: F.col("e.tags")[k]
    many = [F.split(tag(k), ";").alias(k) for k in ("name", "highway", "lanes", "maxspeed", "tunnel", "bridge")]
    line = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return of.where("e.type = 'way'").select("e.id", line.alias("line"), tag("junction").alias("junction"), F.coalesce(tag("oneway") == "yes", F.lit(False)).alias("oneway"), *many)


def land(spark: SparkSession, url: str, bodies: list[str], path: str, fetch: Callable[[str, str], str] | None = None) -> None:
    """Writes the answer to each posted body as a line of text under ``path``; a task for each."""

    def post(u: str, body: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(u, body.encode()), timeout=600) as answer:  # noqa: S310
            return answer.read().decode()

    get = fetch or post

    def run(parts):
        for pdf in parts:
            yield pdf.assign(value=[json.dumps(json.loads(get(url, b))) for b in pdf["body"]])[["value"]]

    asked = spark.createDataFrame([(b,) for b in bodies], "body string").repartition(max(len(bodies), 1))
    asked.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_model(spark: SparkSession, fit: dict, path: str, version: str | None = None) -> str:
    """Parameters and diagnostics of a fit as ``name, value`` (JSON), a new version beside the earlier ones; tables are left out."""
    plain = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in fit.items()}
    rows = [(k, json.dumps(v)) for k, v in sorted(plain.items()) if not hasattr(v, "columns")]
    return write_version(spark.createDataFrame(rows, "name string, value string").coalesce(1), path, version)


def read_model(spark: SparkSession, path: str) -> dict:
    """The latest version of a fit."""
    return {r["name"]: json.loads(r["value"]) for r in read_latest(spark, path).collect()}


def observations(df: DataFrame, interval: str = "phenomenonTime") -> DataFrame:
    """Start and end of an ISO interval ``start/end`` as timestamps."""
    parts = F.split(interval, "/")
    return df.withColumns({"start_time": F.try_to_timestamp(parts[0]), "end_time": F.try_to_timestamp(F.element_at(parts, -1))})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackage)
    spark.dataSource.register(GeoTiff)
    spark.dataSource.register(PagedJson)
