"""Confidence of detections on one scale: 0 low, 1 nominal, 2 high."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 30, 80


def check_thresholds(low: int, high: int) -> None:
    if not 0 <= low <= high <= 100:
        raise ValueError(f"thresholds must satisfy 0 <= low <= high <= 100, not {low}, {high}")


def scale_of(sensor: Column) -> Column:
    """'categorical' for VIIRS, 'numeric' for MODIS, null for any other sensor."""
    name = F.upper(F.trim(sensor))
    return F.when(name.startswith("VIIRS"), "categorical").when(name.startswith("MODIS"), "numeric")


def level(sensor: Column, raw: Column, low: int = LOW, high: int = HIGH) -> Column:
    """The level, or null for a sensor, letter or number that isn't known; unknown is never low."""
    check_thresholds(low, high)
    word = F.lower(F.trim(raw))
    number = F.when(F.trim(raw).rlike(r"^[+-]?[0-9]+$"), F.trim(raw).try_cast("int"))
    letters = F.when(word == "l", 0).when(word == "n", 1).when(word == "h", 2)
    scaled = F.when(number.between(0, 100), F.when(number < low, 0).when(number >= high, 2).otherwise(1))
    return F.when(scale_of(sensor) == "categorical", letters).when(scale_of(sensor) == "numeric", scaled)


def strict_level(sensor: Column, raw: Column, low: int = LOW, high: int = HIGH) -> Column:
    """The level; a value that isn't known raises when the row is computed."""
    found = level(sensor, raw, low, high)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown confidence '"), F.coalesce(raw, F.lit("null")), F.lit("' of sensor "), F.coalesce(sensor, F.lit("null")))).cast("int"))


def partition(detections: DataFrame, minimum: int = 1, low: int = LOW, high: int = HIGH) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by level; the stored rows aren't changed."""
    leveled = detections.withColumn("level", strict_level(F.col("sensor"), F.col("confidence"), low, high))
    return leveled.where(F.col("level") >= minimum), leveled.where(F.col("level") < minimum)


def is_archive(version: Column) -> Column:
    return (F.length(F.coalesce(version, F.lit(""))) > 0) & ~F.contains(F.upper(version), F.lit("NRT"))
