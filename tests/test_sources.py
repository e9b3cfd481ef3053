import io
import json
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumeworks.functions import wkb
from plumeworks.sources import files, geoparquet, raster


def pack_lzw(data: bytes) -> bytes:
    """A plain encoder: codes of 9 to 12 bits, highest bit first, one code early; a table that is full is cleared."""
    codes, out, table, width, before = [], bytearray(), {}, 9, b""

    def emit(code):
        codes.append((code, width))

    def clear():
        nonlocal table, width
        emit(raster.CLEAR)
        table, width = {bytes([k]): k for k in range(256)}, 9

    clear()
    for k in range(len(data)):
        text = before + data[k : k + 1]
        if text in table:
            before = text
            continue
        emit(table[before])
        table[text] = len(table) + 2
        if len(table) + 2 == 4095:
            clear()
        else:
            width = max(9, (len(table) + 2).bit_length())
        before = data[k : k + 1]
    if before:
        emit(table[before])
    emit(raster.END)
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    for k in range(0, len(bits), 8):
        out.append(int(bits[k : k + 8].ljust(8, "0"), 2))
    return bytes(out)


def tiff(path, pixels, tile=None, strip=2, compression=1, predictor=1, none=None, order="<"):
    """A file of pixels (rows, columns) or (rows, columns, samples), written here from the format."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    rows, cols, samples = pixels.shape
    kind = pixels.dtype.newbyteorder(order)
    h, w = tile or (strip, cols)
    blocks = []
    for top in range(0, rows, h):
        for left in range(0, cols, w):
            block = pixels[top : top + h, left : left + w]
            if tile:
                full = np.zeros((h, w, samples), pixels.dtype)
                full[: block.shape[0], : block.shape[1]] = block
                block = full
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            if predictor == 3:
                raw = np.ascontiguousarray(block.astype(kind.newbyteorder(">"))).view(np.uint8).reshape(block.shape[0], w * samples, kind.itemsize).transpose(0, 2, 1).reshape(block.shape[0], -1, samples)
                raw = np.diff(raw, axis=1, prepend=np.zeros_like(raw[:, :1])).tobytes()
            else:
                raw = block.astype(kind).tobytes()
            blocks.append({1: lambda b: b, 5: pack_lzw, 8: zlib.compress}[compression](raw))
    bits, form = pixels.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    at, data = [], b""
    for b in blocks:
        at.append(8 + len(data))
        data += b
    sizes = [len(b) for b in blocks]
    tags = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [bits] * samples), (259, "H", [compression]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [form] * samples)]
    tags += [(322, "I", [w]), (323, "I", [h]), (324, "I", at), (325, "I", sizes)] if tile else [(273, "I", at), (278, "I", [h]), (279, "I", sizes)]
    tags += [(42113, "c", [c.encode() for c in str(none)] + [b"\0"])] if none is not None else []
    head = 8 + len(data)
    entries, extra, place = b"", b"", head + 2 + 12 * len(tags) + 4
    for tag, fmt, values in sorted(tags, key=lambda t: t[0]):
        raw = struct.pack(f"{order}{len(values)}{fmt}", *values)
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", place + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "c": 2}[fmt], len(values)) + where
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, head) + data + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + extra)


def read(spark, path):
    spark.dataSource.register(raster.GeoTiff)
    return sorted(map(tuple, spark.read.format("geotiff").load(str(path)).collect()))


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 60_000])
def test_lzw(n):
    rnd = np.random.default_rng(n)
    for data in (bytes(n), rnd.integers(0, 256, n, np.uint8).tobytes(), rnd.integers(0, 3, n, np.uint8).tobytes()):
        assert raster.unpack_lzw(pack_lzw(data)) == data
    with pytest.raises(ValueError):
        raster.unpack_lzw(b"\x80\x7f\xff\xff")


@pytest.mark.parametrize(("kind", "predictors"), [("f4", (1, 3)), ("f8", (1, 3)), ("i2", (1, 2)), ("u1", (1, 2)), ("u4", (1, 2))])
def test_tiles_and_strips_hold_the_same(spark, tmp_path, kind, predictors):
    rnd = np.random.default_rng(5)
    pixels = (rnd.integers(0, 90, (37, 50)) * (1.25 if kind[0] == "f" else 1)).astype(kind)
    pixels[3:5, 7:30] = 7
    if kind[0] == "f":
        pixels[0, 0] = np.nan
    want = sorted((r, c, None if pixels[r, c] != pixels[r, c] or pixels[r, c] == 7 else float(pixels[r, c])) for r in range(37) for c in range(50))
    tiff(tmp_path / "strips.tif", pixels, strip=4, none=7)
    assert read(spark, tmp_path / "strips.tif") == want
    for k, (compression, predictor, order) in enumerate([(5, predictors[0], "<"), (5, predictors[1], ">"), (8, predictors[1], "<"), (1, predictors[1], "<")]):
        tiff(tmp_path / f"{k}.tif", pixels, (16, 16), compression=compression, predictor=predictor, none=7, order=order)
        assert read(spark, tmp_path / f"{k}.tif") == want


def test_bands_ranges_and_errors(spark, tmp_path):
    pixels = np.arange(2 * 3 * 2, dtype="u2").reshape(2, 3, 2)
    tiff(tmp_path / "bands.tif", pixels, strip=1)
    assert read(spark, tmp_path / "bands.tif") == [(r, c, float(pixels[r, c, 0])) for r in range(2) for c in range(3)]
    big = tmp_path / "big.tif"
    tiff(big, np.zeros((512, 512), "f8"), (64, 64))
    reads, source = [], raster.GeoTiffReader(str(big))

    class Watched(io.BytesIO):
        def read_at(self, n, at):
            reads.append(n)
            self.seek(at)
            return self.read(n)

    source._tags(Watched(big.read_bytes()))
    assert sum(reads) < 2000 < big.stat().st_size  # the header alone
    assert len(source.partitions()) == 64
    (tmp_path / "no.tif").write_bytes(b"II\x2b\0" + bytes(20))
    with pytest.raises(ValueError):
        raster.GeoTiffReader(str(tmp_path / "no.tif")).partitions()


P = "struct<x:double,y:double>"
SHAPES = [
    (P, (1.5, -2.0)), (f"array<{P}>", [(0.0, 0.0), (1.0, 2.0)]), (f"array<array<{P}>>", [[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)], [(1.0, 1.0), (1.5, 1.0), (1.0, 1.5), (1.0, 1.0)]]),
    (f"array<array<array<{P}>>>", [[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]], [[(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]]]),
]


@pytest.mark.parametrize(("kind", "shape"), SHAPES)
def test_geometries_come_back(spark, tmp_path, kind, shape):
    number = geoparquet.SHAPES[kind]
    assert wkb.decode(wkb.encode(shape, number)) == (number, shape)
    df = spark.createDataFrame([(1, shape, "x"), (2, None, "y")], f"id long, geometry {kind}, bbox string").repartition(2)
    geoparquet.write_geoparquet(df, str(tmp_path / "g"), "geometry", {"id": {"authority": "EPSG", "code": 2157}})
    geoparquet.write_geoparquet(df.where("id = 1").withColumn("id", F.lit(3).cast("long")), str(tmp_path / "g"), "geometry", {"id": {"authority": "EPSG", "code": 2157}})
    geo = geoparquet.metadata(str(tmp_path / "g"))
    assert geo["columns"]["geometry"]["crs"]["id"]["code"] == 2157 and geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB"
    got = {r.id: r for r in geoparquet.read_geoparquet(spark, str(tmp_path / "g")).collect()}
    want = {r.id: r.geometry for r in df.collect()}
    assert set(got) == {1, 2, 3} and got[1].geometry == want[1] == got[3].geometry and got[2].geometry is None is got[2].bbox
    assert [p.name for p in (tmp_path / "g").iterdir() if p.name.startswith("_")] == []
    assert geoparquet.read_geoparquet(spark, str(tmp_path / "g"), (100.0, 100.0, 101.0, 101.0)).count() == 0


def test_row_groups_outside_the_box_are_left_out(spark, tmp_path):
    df = spark.range(4000).select("id", F.struct(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y")).alias("place")).coalesce(1)
    geoparquet.write_geoparquet(df, str(tmp_path / "g"), "place", rows=500)
    (file,) = (tmp_path / "g").glob("*.parquet")
    assert pq.read_metadata(file).num_row_groups == 8 and json.loads(pq.read_metadata(file).metadata[b"geo"])["columns"]["place"]["geometry_types"] == ["Point"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    of = geoparquet.read_geoparquet(spark, str(tmp_path / "g"), (1000.0, -1009.0, 1009.5, 0.0), decode=False)
    plan = of._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(bbox.xmax,1000.0)" in plan and "LessThanOrEqual(bbox.xmin,1009.5)" in plan
    assert sorted(r.id for r in of.collect()) == list(range(1000, 1010))
    empty = df.limit(0)
    geoparquet.write_geoparquet(empty, str(tmp_path / "none"), "place")
    with pytest.raises(ValueError):
        geoparquet.metadata(str(tmp_path / "none"))


FEATURE = '{"type": "Feature", "properties": {"id": %d}, "geometry": {"type": "Point", "coordinates": [%d.5, -1]}}'


@pytest.mark.parametrize("form", ["sequence", "collection"])
def test_features_by_line(spark, tmp_path, form):
    lines = [FEATURE % (k, k) for k in range(50)]
    head = ["{", '"type": "FeatureCollection",', '"name": "places",', '"features": ['] if form == "collection" else []
    text = "\n".join([*head, *[x + ("," if k < 49 and head else "") for k, x in enumerate(lines)], *(["]", "}"] if head else [])])
    (tmp_path / "f.json").write_text(text)
    rows = files.read_geojson_lines(spark, str(tmp_path / "f.json"), "id:int").collect()
    assert sorted((r.id, r.type, json.loads(r.coordinates)) for r in rows) == [(k, "Point", [k + 0.5, -1]) for k in range(50)]
    if head:
        assert sorted(map(tuple, rows)) == sorted(map(tuple, files.read_geojson(spark, str(tmp_path / "f.json"), "id:int").collect()))
    (tmp_path / "broken.json").write_text(text + '\n{"type": "Feature",')
    with pytest.raises(Exception, match="no feature"):
        files.read_geojson_lines(spark, str(tmp_path / "broken.json"), "id:int").collect()
