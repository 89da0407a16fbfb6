"""Side tables of a plan and their exports: regions, chips, scenes, products, submissions and features for maps."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.operators import rle
from cinderlake.operators.evaluation import gated


def load_region(text: str) -> dict:
    """A region's configuration (TOML) with a box whose sides are in order."""
    region = tomllib.loads(text)
    w, s, e, n = region["bbox"]
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError(f"bbox must be west, south, east, north in order, not {region['bbox']}")
    return region


def chip_metadata(own: DataFrame | None, shared: DataFrame | None, kind: str) -> DataFrame:
    """A dataset's own metadata, or the shared table's rows of its kind; neither, or none of the kind, is an error."""
    if own is not None:
        return own
    if shared is None:
        raise ValueError("no metadata, own or shared")
    rows = shared.where(F.col("kind") == kind)
    gated(rows.agg(F.count("*").alias("n")), F.col("n") == 0, f"no metadata of kind {kind}")
    return rows


def scene_candidates(found: DataFrame) -> DataFrame:
    """Search results with a tile; a cloud cover that isn't told counts as all of it."""
    return found.where("tile is not null").withColumn("cloud", F.coalesce(F.col("cloud").cast("double"), F.lit(100.0)))


def product_windows(requests: DataFrame, product: DataFrame, key: list[str]) -> DataFrame:
    """requests with the product's values; a request that the product doesn't cover has nulls."""
    return requests.join(product, key, "left")


def first_day_with_data(journal: DataFrame) -> DataFrame:
    """Rows (source, first_day): the earliest day of a good poll that found something; a source whose polls failed only raises."""
    per = journal.groupBy("source").agg(F.count_if(F.col("status") == "ok").alias("good"), F.min(F.when((F.col("status") == "ok") & (F.col("detection_count") > 0), F.to_date("window_start"))).alias("first_day"))
    gated(per, F.col("good") == 0, "a source has no good poll")
    return per.select("source", "first_day")


def fire_start(kind: Column, ignition: Column, activation: Column, start: Column) -> Column:
    """The day a fire began, from what its dataset tells."""
    return F.when(kind == "perimeter", ignition).when(kind == "activation", activation).otherwise(start).cast("date")


def submission(pixels: DataFrame, classes: tuple[int, ...], key: str = "chip_id", value: str = "cls") -> DataFrame:
    """Rows (chip_id, class_id, rle), one for each chip and class; a class without pixels has the empty text."""
    spread = pixels.select(key, "pos", F.col(value), F.explode(F.array(*[F.lit(c) for c in classes])).alias("class_id"))
    return rle.encode(spread, [key, "class_id"], f"{value} = class_id").select(F.col(key).alias("chip_id"), "class_id", "rle")


def write_submission(rows: DataFrame, path: str) -> None:
    """As CSV of fixed columns in the order of chips and classes, in one file: a row per chip and class, no pixels."""
    rows.select("chip_id", "class_id", "rle").orderBy("chip_id", "class_id").coalesce(1).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def feature(geometry: Column, properties: Column) -> Column:
    """A map feature as JSON text. geometry: struct(type, coordinates)."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def box_polygon(w: Column, s: Column, e: Column, n: Column) -> Column:
    corner = lambda x, y: F.array(x, y)
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))).alias("coordinates"))


def write_features(rows: DataFrame, path: str, column: str = "feature") -> None:
    """Features as lines of JSON, a file per partition (newline-delimited, as no map of that size is one document)."""
    rows.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def events_between(events: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Events that overlap a span of time, ends included."""
    return events.where((F.col("last_seen") >= lo) & (F.col("first_seen") <= hi))


def burns_of_events(events: DataFrame, burns: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with a burn; those without are left out."""
    return events.join(burns, key)


def read_region(spark: SparkSession, path: str) -> dict:
    return load_region(spark.read.option("wholetext", True).text(path).first()[0])
