"""Calendar windows, seasons and day-of-year gaps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_day(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def in_window(day: Column, start: int, end: int) -> Column:
    """Whether a day falls in a yearly window of month*100+day bounds; a window may wrap New Year."""
    md = month_day(day)
    return md.between(start, end) if start <= end else (md >= start) | (md <= end)


def in_any_window(day: Column, windows: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in windows:
        out = out | in_window(day, a, b)
    return out


def doy_gap(a: Column, b: Column) -> Column:
    d = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(d, F.lit(365) - d)


def season_band(lat: Column, bands: list[tuple[float, int, int]]) -> Column:
    """The band (max_lat, start, end) of smallest max_lat that reaches the latitude; null beyond all."""
    out = F.lit(None).cast("struct<max_lat:double,start:int,end:int>")
    for max_lat, start, end in sorted(bands, reverse=True):
        out = F.when(F.abs(lat) <= max_lat, F.struct(F.lit(float(max_lat)).alias("max_lat"), F.lit(start).alias("start"), F.lit(end).alias("end"))).otherwise(out)
    return out


def season_check(fire_end: Column, band: Column, wait_days: int = 5) -> Column:
    """struct(ok, earliest, next_start): can a scene after the fire be taken in season, and if not, from when."""
    earliest = F.date_add(fire_end, wait_days)
    md = month_day(earliest)
    ok = md.between(band["start"], band["end"])
    year = F.year(earliest) + F.when(md > band["end"], 1).otherwise(0)
    start = F.make_date(year, (band["start"] / 100).cast("int"), F.pmod(band["start"], F.lit(100)))
    return F.struct(ok.alias("ok"), earliest.alias("earliest"), F.when(~ok, start).alias("next_start"))


# fixed values: first and last years that each burned-area product covers
COVERED_YEARS = {"FireCCI51": (2001, 2020), "FireCCIS311": (2019, 2024), "FireCCILT11": (1982, 2018)}


def product_covers(at: Column, product: str) -> Column:
    """Whether the product covers the date's year; an unknown product is an error."""
    if product not in COVERED_YEARS:
        raise ValueError(f"unknown product: {product}")
    return F.year(at).between(*COVERED_YEARS[product])
