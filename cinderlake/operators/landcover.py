"""Land classes of points from tiles of pixels, and the agricultural flag that they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import geo
from cinderlake.functions.dates import in_any_window

CROPLAND, OTHER, UNKNOWN = "cropland", "other", "unknown"


def land_class(detections: DataFrame, pixels: DataFrame, side: int = 300, degrees: float = 3.0) -> DataFrame:
    """detections with land_class: cropland, other, or unknown where no tile has a pixel for the point.

    pixels: tile, row (from the north), col, cropland (1 or 0); `side` pixels a side. One equal join on tile and pixel."""
    lat, lon = F.col("latitude"), F.col("longitude")
    step = degrees / side
    north, west = F.floor(lat / degrees) * degrees + degrees, F.floor(lon / degrees) * degrees
    keyed = detections.withColumns({"_tile": geo.worldcover_tile(lat, lon), "_row": F.floor((north - lat) / step).cast("int"), "_col": F.floor((lon - west) / step).cast("int")})
    named = pixels.select(F.col("tile").alias("_tile"), F.col("row").cast("int").alias("_row"), F.col("col").cast("int").alias("_col"), F.col("cropland").alias("_crop"))
    kind = F.when(F.col("_crop") == 1, CROPLAND).when(F.col("_crop").isNotNull(), OTHER).otherwise(UNKNOWN)
    return keyed.join(named, ["_tile", "_row", "_col"], "left").withColumn("land_class", kind).drop("_tile", "_row", "_col", "_crop")


def agricultural(classed: DataFrame, windows: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(kept, flagged): detections on cropland within a yearly window of burning are flagged; unknown land never is."""
    flag = in_any_window(F.col("acquired_at"), windows) & (F.col("land_class") == CROPLAND)
    return classed.where(~flag), classed.where(flag)
