"""Well-known binary of points, lines and polygons, both ways. A geometry is nested lists of (x, y): a point, a line's points, a polygon's rings, or polygons."""

from __future__ import annotations

import struct

# Fixed values of the format: type numbers of geometries, and little-endian order.
POINT, LINE, POLYGON, MULTI_POLYGON = 1, 2, 3, 6
LITTLE = 1
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTI_POLYGON: "MultiPolygon"}


def _points(points) -> bytes:
    return struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def encode(geometry, kind: int) -> bytes:
    head = struct.pack("<BI", LITTLE, kind)
    if kind == POINT:
        return head + struct.pack("<dd", *geometry)
    if kind == LINE:
        return head + _points(geometry)
    if kind == POLYGON:
        return head + struct.pack("<I", len(geometry)) + b"".join(map(_points, geometry))
    if kind == MULTI_POLYGON:
        return head + struct.pack("<I", len(geometry)) + b"".join(encode(g, POLYGON) for g in geometry)
    raise ValueError(f"geometries of type {kind} are not written")


def decode(data: bytes) -> tuple[int, list | tuple]:
    """(type, geometry)."""
    kind, geometry, _ = _decoded(data, 0)
    return kind, geometry


def _decoded(data: bytes, at: int):
    order = "<" if data[at] == LITTLE else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def point() -> tuple:
        nonlocal at
        at += 16
        return struct.unpack_from(order + "dd", data, at - 16)

    if kind == POINT:
        return kind, point(), at
    if kind == LINE:
        return kind, [point() for _ in range(count())], at
    if kind == POLYGON:
        return kind, [[point() for _ in range(count())] for _ in range(count())], at
    if kind == MULTI_POLYGON:
        out = []
        for _ in range(count()):
            _, polygon, at = _decoded(data, at)
            out.append(polygon)
        return kind, out, at
    raise ValueError(f"geometries of type {kind} are not read")
