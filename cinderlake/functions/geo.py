"""Distances, grid cells, affine indices and tile names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a degree of latitude.
METRES = 111_320.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres, scaled at the middle latitude."""
    return F.hypot((lon1 - lon2) * METRES * F.cos(F.radians((lat1 + lat2) / 2)), (lat1 - lat2) * METRES)


def cell_row(lat: Column, size_m: float) -> Column:
    return F.floor(lat / F.lit(size_m / METRES))


def cell_col(lon: Column, row: Column, size_m: float) -> Column:
    """Column within a band of latitude; the step depends on the band only, so that neighbours agree on it."""
    return F.floor(lon / (F.lit(size_m) / (METRES * F.greatest(F.cos(F.radians(row * (size_m / METRES))), F.lit(1e-6)))))


def neighbour_cells(lat: Column, lon: Column, size_m: float) -> Column:
    """The nine cells around a point, each column taken in its own band's step."""
    row = cell_row(lat, size_m)
    cells = [F.struct((row + dy).alias("cell_row"), (cell_col(lon, row + dy, size_m) + dx).alias("cell_col")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return F.array(*cells)


def with_cell(df: DataFrame, size_m: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumn("cell_row", cell_row(F.col(lat), size_m)).withColumn("cell_col", cell_col(F.col(lon), F.col("cell_row"), size_m))


def padded_bbox(west: Column, south: Column, east: Column, north: Column, pad_m: float) -> list[Column]:
    dlat = F.lit(pad_m / METRES)
    dlon = F.lit(pad_m) / (METRES * F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(1e-6)))
    return [west - dlon, south - dlat, east + dlon, north + dlat]


def extent_km(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The longer side of a box."""
    mid = (south + north) / 2
    return F.greatest(distance_m(mid, west, mid, east), distance_m(south, west, north, west)) / 1000.0


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float] | None) -> Column:
    """Containment, closed on all sides; no box contains everything."""
    if bbox is None:
        return F.lit(True)
    w, s, e, n = bbox
    return lon.between(w, e) & lat.between(s, n)


def overlap_open(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of open rectangles; boxes that only touch don't overlap."""
    return (a["w"] < b["e"]) & (b["w"] < a["e"]) & (a["s"] < b["n"]) & (b["s"] < a["n"])


def worldcover_tile(lat: Column, lon: Column) -> Column:
    """Name of the three-degree tile that holds a point, such as N51E087."""
    y, x = (F.floor(lat / 3) * 3).cast("int"), (F.floor(lon / 3) * 3).cast("int")
    pad = lambda v, n: F.lpad(F.abs(v).cast("string"), n, "0")
    return F.concat(F.when(y >= 0, "N").otherwise("S"), pad(y, 2), F.when(x >= 0, "E").otherwise("W"), pad(x, 3))


def pixel_index(x: Column, y: Column, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Row and column of a point under (a, b, c, d, e, f), truncated toward zero as indices are."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    if det == 0:
        raise ValueError("the affine transform has no inverse")
    col = (F.lit(e) * (x - c) - F.lit(b) * (y - f)) / det
    row = (F.lit(a) * (y - f) - F.lit(d) * (x - c)) / det
    return row.cast("long"), col.cast("long")


def pixel_ha(a: float, e: float) -> float:
    return abs(a * e) / 10_000.0
