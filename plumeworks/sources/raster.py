"""GeoTIFF rasters in strips or tiles, plain, deflated or LZW, with or without a predictor; only the parts needed of a file are read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import storage

# Fixed values of the format: tag numbers, bytes and struct letters of a tag's type, numpy letters of (bits, sample format), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, NO_DATA = 322, 323, 324, 325, 339, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
CLEAR, END = 256, 257
#: Partitions of a raster at most; more blocks than that are read several to a task.
PARTITIONS = 1024


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first, that grow one code early."""
    out, table, before = bytearray(), [], b""
    bits, held, width = 0, 0, 9
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, before, width = list(first), b"", 9
            continue
        if not table:
            table = list(first)
        if code < len(table):
            text = table[code]
        elif code == len(table) and before:
            text = before + before[:1]
        else:
            raise ValueError("a code is not known yet")
        out += text
        if before:
            table.append(before + text[:1])
        before = text
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


class GeoTiff(DataSource):
    """The first band of a GeoTIFF as ``row, col, value``; no-data pixels are null. A task reads a block or a few: strips or tiles."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(self.options["path"])


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.header = path, None

    def _tags(self, f: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
        """The byte order and the tags of the first image, by ranges of the file."""
        head = f.read_at(8, 0)
        order = "<" if head[:2] == b"II" else ">"
        if struct.unpack_from(order + "H", head, 2)[0] != 42:
            raise ValueError(f"{self.path} is not a TIFF file")
        at = struct.unpack_from(order + "I", head, 4)[0]
        n = struct.unpack(order + "H", f.read_at(2, at))[0]
        entries, out = f.read_at(12 * n, at + 2), {}
        for k in range(n):
            tag, kind, count, place = struct.unpack_from(order + "HHII", entries, 12 * k)
            if kind in TYPES:
                fmt = f"{order}{count}{TYPES[kind]}"
                size = struct.calcsize(fmt)
                raw = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else f.read_at(size, place)
                out[tag] = (raw,) if kind == 2 else struct.unpack(fmt, raw)
        return order, out

    def _open(self) -> tuple[pa.NativeFile, str, dict[int, tuple]]:
        fs, path = storage(self.path)
        f = fs.open_input_file(path)
        if self.header is None:
            self.header = self._tags(f)
        return f, *self.header

    def _first_band(self, tags: dict[int, tuple]) -> tuple[int, int, int]:
        """(block width, block height, number of blocks) of the first band."""
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if TILES in tags else (width, min(height, tags.get(STRIP_ROWS, (height,))[0]))
        return w, h, -(-width // w) * -(-height // h)

    def partitions(self) -> list[InputPartition]:
        f, _, tags = self._open()
        f.close()
        n = self._first_band(tags)[2]
        step = max(1, -(-n // PARTITIONS))
        return [InputPartition((k, min(n, k + step))) for k in range(0, n, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        f, order, tags = self._open()
        compression, samples = tags.get(COMPRESSION, (PLAIN,))[0], tags.get(SAMPLES, (1,))[0]
        if compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
            raise ValueError(f"compression {compression} is not read")
        chunky = samples if tags.get(PLANES, (1,))[0] == 1 else 1
        kind = np.dtype(KINDS[tags.get(BITS, (8,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]]).newbyteorder(order)
        none = float(tags[NO_DATA][0].rstrip(b"\0").decode()) if NO_DATA in tags else None
        w, h, _ = self._first_band(tags)
        width, height, across = tags[WIDTH][0], tags[HEIGHT][0], -(-tags[WIDTH][0] // w)
        at, size = (tags[TILES], tags[TILE_BYTES]) if TILES in tags else (tags[STRIPS], tags[STRIP_BYTES])
        for k in range(*partition.value):
            top, left = k // across * h, k % across * w
            rows = h if TILES in tags else min(h, height - top)
            if size[k]:
                raw = f.read_at(size[k], at[k])
                raw = unpack_lzw(raw) if compression == LZW else raw if compression == PLAIN else zlib.decompress(raw)
                block = unpredicted(raw, tags.get(PREDICTOR, (1,))[0], kind, rows, w, chunky)[:, :, 0]
            else:  # a block that the file leaves out holds no data
                block = np.full((rows, w), np.nan)
            block = block[: height - top, : width - left].astype(float)
            r, c = np.indices(block.shape)
            values = block.ravel()
            empty = np.isnan(values) if none is None else np.isnan(values) | (values == none)
            yield pa.record_batch([pa.array((r + top).ravel(), pa.int32()), pa.array((c + left).ravel(), pa.int32()), pa.array(values, pa.float64(), mask=empty)], names=["row", "col", "value"])
        f.close()


def unpredicted(raw: bytes, predictor: int, kind: np.dtype, rows: int, width: int, samples: int) -> np.ndarray:
    """The pixels ``(rows, width, samples)`` of a block: as they are (1), from differences along a row (2), or from those of floating-point bytes (3)."""
    shape = (rows, width, samples)
    if predictor == 3:
        size = kind.itemsize
        planes = np.frombuffer(raw, np.uint8, rows * width * samples * size).reshape(rows, size * width, samples)
        planes = np.cumsum(planes, 1, dtype=np.uint8).reshape(rows, size, width * samples)  # highest bytes of a row first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    pixels = np.frombuffer(raw, kind, rows * width * samples).reshape(shape)
    if predictor == 2:
        return np.cumsum(pixels.astype(kind.newbyteorder("=")), 1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not read")
    return pixels
