"""Map projections as Column expressions: transverse Mercator (Krüger series on GRS80) and spherical Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid, and zone 35 of the Finnish grid (central meridian, scale, false easting).
A, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN, SCALE, EASTING = 27.0, 0.9996, 500_000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of degrees."""
    s = F.sin(F.radians(lat))
    t = F.sinh(_atanh(s) - E * _atanh(E * s))
    d = F.radians(lon - MERIDIAN)
    xi, eta = F.atan2(t, F.cos(d)), _atanh(F.sin(d) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EASTING + SCALE * RADIUS * east, SCALE * RADIUS * north


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing."""
    xi, eta = y / (SCALE * RADIUS), (x - EASTING) / (SCALE * RADIUS)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat, psi = chi, _atanh(F.sin(chi))
    for _ in range(5):  # the isometric latitude undone by fixed point
        lat = F.asin(F.tanh(psi + E * _atanh(E * F.sin(lat))))
    return MERIDIAN + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(lat)


def to_web(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile, counted from the north-west."""
    n = 1 << zoom
    y = (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2
    return F.floor((lon + 180) / 360 * n), F.floor(y * n)
