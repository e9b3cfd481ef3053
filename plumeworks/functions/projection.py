"""Transverse Mercator as Column expressions, by series in the third flattening; errors stay below a millimetre within some 1000 km of the meridian."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import EARTH, mercator_x, mercator_y


@dataclass(frozen=True)
class Meridian:
    """A transverse Mercator grid: central point in degrees, scale, false origin in metres, ellipsoid."""

    lat: float
    lon: float
    scale: float
    east: float
    north: float
    axis: float = 6378137.0
    flattening: float = 1 / 298.257222101


#: Grids by name (fixed values).
GRIDS = {"EPSG:2157": Meridian(53.5, -8.0, 0.99982, 600_000.0, 750_000.0), "EPSG:10285": Meridian(0.0, 9.0, 0.9996, 500_000.0, 0.0), "EPSG:25832": Meridian(0.0, 9.0, 0.9996, 500_000.0, 0.0)}


def _series(grid: Meridian) -> tuple[float, list[float], list[float], list[float]]:
    """(radius of the rectified meridian, coefficients forward, back, and from conformal to geodetic latitude)."""
    n = grid.flattening / (2 - grid.flattening)
    radius = grid.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, forward, back, latitude


def _origin(grid: Meridian) -> float:
    """Northing of the central point on the meridian, before scale."""
    radius, forward, _, _ = _series(grid)
    e, s = math.sqrt(grid.flattening * (2 - grid.flattening)), math.sin(math.radians(grid.lat))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(forward, 1)))


def to_grid(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """(x, y) in metres of a named grid, or of Web Mercator; null where a coordinate is null or beyond 90 or 180 degrees."""
    known = (F.abs(lat) < 90) & (F.abs(lon) <= 180)
    lon, lat = F.when(known, lon), F.when(known, lat)
    if crs == "EPSG:3857":
        return mercator_x(lon), mercator_y(lat)
    g = GRIDS[crs]
    radius, forward, _, _ = _series(g)
    e = math.sqrt(g.flattening * (2 - g.flattening))
    s, d = F.sin(F.radians(lat)), F.radians(lon - g.lon)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    x = sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(forward, 1)), eta)
    y = sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(forward, 1)), xi)
    return g.east + g.scale * radius * x, g.north + g.scale * (radius * y - _origin(g))


def from_grid(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a place in a named grid or in Web Mercator."""
    if crs == "EPSG:3857":
        return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)
    g = GRIDS[crs]
    radius, _, back, latitude = _series(g)
    xi, eta = ((y - g.north) / g.scale + _origin(g)) / radius, (x - g.east) / (g.scale * radius)
    u = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    v = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    conformal = F.asin(F.sin(u) / F.cosh(v))
    lat = sum((c * F.sin(2 * j * conformal) for j, c in enumerate(latitude, 1)), conformal)
    return g.lon + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def projected_line(line: Column, crs: str) -> Column:
    """A line or ring of (x, y) = (lon, lat) in metres of a grid."""

    def place(p: Column) -> Column:
        x, y = to_grid(p["x"], p["y"], crs)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, place)
