"""Detections from the text exports of fire sensors, with explicit columns and no inference."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: columns that every export has, and the known sources
REQUIRED = ("latitude", "longitude", "acq_date", "acq_time")
SOURCES = ("VIIRS_SNPP_NRT", "VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT", "MODIS_NRT", "VIIRS_SNPP_SP", "VIIRS_NOAA20_SP", "MODIS_SP")
COLUMNS = ("latitude", "longitude", "brightness", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_t31", "bright_ti5", "frp", "daynight", "type")


def redact(text: str, secret: str | None) -> str:
    return text.replace(secret, "***") if secret else text


def check_request(source: str, days: int) -> None:
    if source == "LANDSAT_NRT":
        raise ValueError("LANDSAT_NRT covers North America only")
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}; known: {', '.join(SOURCES)}")
    if not 1 <= days <= 5:
        raise ValueError(f"days must be 1 to 5, not {days}")


def _blank(name: str) -> Column:
    return F.when(F.trim(F.col(name)) != "", F.trim(F.col(name)))


def number(name: str) -> Column:
    """A double, or null for a blank or anything that isn't a number."""
    return _blank(name).try_cast("double")


def acquired_at(day: str = "acq_date", hhmm: str = "acq_time") -> Column:
    """UTC time of a date and digits HHMM without a separator; a blank time is midnight."""
    digits = F.lpad(F.coalesce(_blank(hhmm), F.lit("0")), 4, "0")
    return F.try_to_timestamp(F.concat_ws(" ", F.col(day), digits), F.lit("yyyy-MM-dd HHmm"))


def parse(raw: DataFrame, sensor: str | Column) -> DataFrame:
    """Text columns to detections; rows without a position go. raw: all columns as text, as they came."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"not an export of detections: no column {', '.join(missing)}; it has {str(raw.columns)[:200]}")
    full = raw.withColumns({c: F.lit(None).cast("string") for c in COLUMNS if c not in raw.columns})
    out = full.select(
        (F.lit(sensor) if isinstance(sensor, str) else sensor).alias("sensor"), number("latitude").alias("latitude"), number("longitude").alias("longitude"), acquired_at().alias("acquired_at"),
        F.coalesce(number("brightness"), number("bright_ti4")).alias("brightness"), number("frp").alias("frp"), F.trim("confidence").alias("confidence"),
        "satellite", "daynight", "version", F.col("type").try_cast("int").alias("fire_type"),
    )
    return out.where("latitude is not null and longitude is not null")


def read_csv(spark: SparkSession, path: str, sensor: str) -> DataFrame:
    return parse(spark.read.option("header", True).option("inferSchema", False).csv(path), sensor)


def sensor_of_name(name: Column) -> Column:
    """The sensor that an archive file's name tells of; null for names that tell of none."""
    up = F.upper(name)
    return F.when(up.rlike("SV-C2|SNPP"), "VIIRS_SNPP_SP").when(up.rlike("J1V-C2|NOAA-?20"), "VIIRS_NOAA20_SP").when(up.rlike("J2V-C2|NOAA-?21"), "VIIRS_NOAA21_SP").when(up.rlike("M-C61|MODIS"), "MODIS_SP")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b.path, b.content, strict=True):
            name = re.sub(r".*/", "", path)
            if name.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [(m, z.read(m)) for m in z.namelist() if m.lower().endswith(".csv")]
            else:
                members = [(name, content)]
            for member, data in members:
                rows = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False)
                yield rows.reindex(columns=list(COLUMNS)).assign(member=member).astype(object).where(lambda x: x.notna(), None)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Detections of CSV files, plain or zipped; each file's sensor comes from its name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = files.mapInPandas(_unzip, ", ".join(f"{c} string" for c in (*COLUMNS, "member")))
    sensor = F.coalesce(sensor_of_name(F.col("member")), F.raise_error(F.concat(F.lit("no known sensor in the name "), F.col("member"))).cast("string"))
    return parse(raw, sensor)


def backfill_windows(spark: SparkSession, end: str, days: int, chunk: int = 5) -> DataFrame:
    """Rows (window_start, window_end): steps back from a day, each of `chunk` days at most, the last one shorter."""
    steps = spark.range(0, days, chunk).select((F.col("id")).cast("int").alias("back"))
    stop = F.date_sub(F.to_date(F.lit(end)), F.col("back"))
    return steps.select(F.date_sub(stop, F.least(F.lit(chunk), F.lit(days) - F.col("back"))).alias("window_start"), stop.alias("window_end"))


def activations(raw: DataFrame) -> DataFrame:
    """Activation records to one form: countries may be a list of names or objects, or missing; so may categories.

    raw: code, countries and category as JSON texts."""
    names = F.from_json("countries", "array<string>")
    objects = F.from_json("countries", "array<struct<name:string>>")
    listed = F.coalesce(F.when(F.col("countries").rlike(r"^\s*\[\s*\{"), F.transform(objects, lambda x: x["name"])), names)
    clean = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    kind = F.coalesce(F.get_json_object("category", "$.name"), F.regexp_replace("category", '^"|"$', ""))
    return raw.select("code", F.coalesce(clean, F.array().cast("array<string>")).alias("countries"), (F.coalesce(F.size(clean), F.lit(0)) == 0).alias("unknown_country"), kind.alias("category"))


def product_name(name: Column) -> Column:
    """struct(tile, day) of a granule's name, from its tile code and year with day of year."""
    tile = F.regexp_extract(name, r"\.T(\d{2}[A-Z]{3})\.", 1)
    day = F.regexp_extract(name, r"\.(\d{7})T\d{6}", 1)
    return F.struct(F.when(tile != "", tile).alias("tile"), F.when(day != "", F.to_date(F.try_to_timestamp(day, F.lit("yyyyDDD")))).alias("day"))
