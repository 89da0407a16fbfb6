"""Transverse Mercator on the ellipsoid as column expressions, both ways, by series in the third flattening to its fourth power.

Good to well below a millimetre within some thousand kilometres of a zone's meridian. Latitudes and longitudes in degrees,
easting and northing in metres; null stays null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ellipsoid WGS 84 and the zones' scale, false easting and false northing of the south
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EASTING, SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, scaled.
RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
# fixed values: coefficients of the published series (Krueger), by powers of n from the first term's own on
ALPHA = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
BETA = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
DELTA = ((2.0, -2 / 3, -2.0, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def terms(series: tuple[tuple[float, ...], ...]) -> list[float]:
    """The series' factors of the angle twice, four times and so on."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(series, 1)]


def meridian(zone: Column) -> Column:
    return zone * 6 - 183


def to_metres(lon: Column, lat: Column, zone: Column) -> Column:
    """struct(x, y) in the zone's grid; a southern latitude gets the southern false northing."""
    phi, dlon = F.radians(lat), F.radians(lon - meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(terms(ALPHA), 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EASTING + RADIUS * x).alias("x"), (RADIUS * y + F.when(lat < 0, SOUTH).otherwise(0.0)).alias("y"))


def to_degrees(x: Column, y: Column, zone: Column, south: Column | None = None) -> Column:
    """struct(lon, lat) of a place in a zone's grid."""
    xi = (y - (F.when(south, SOUTH).otherwise(0.0) if south is not None else 0.0)) / RADIUS
    eta = (x - EASTING) / RADIUS
    a, b = xi, eta
    for j, c in enumerate(terms(BETA), 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, c in enumerate(terms(DELTA), 1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.struct((meridian(zone) + F.degrees(F.atan2(F.sinh(b), F.cos(a)))).alias("lon"), F.degrees(phi).alias("lat"))
