"""An append-only store of detections and polls, and snapshots of it, as Parquet tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.operators.points import KEY, event_id, first_of_key


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def unseen(batch: DataFrame, stored: DataFrame | None, key: tuple[str, ...] = KEY) -> DataFrame:
    """The batch's rows, first of each key, that the store doesn't hold."""
    first = first_of_key(batch, key)
    return first if stored is None else first.join(stored.select(*key), list(key), "left_anti")


def add_detections(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """Append what is new and return how many rows that was; the same batch again adds none.

    Two writers at once may both add a row; `once` reads each key's first."""
    stored = spark.read.option("mergeSchema", True).parquet(path) if _exists(spark, path) else None
    new = unseen(batch, stored).withColumn("acq_date", F.to_date("acquired_at")).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").partitionBy("acq_date").parquet(path)
        return n
    finally:
        new.unpersist()


def once(stored: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A store's rows, the first of each key."""
    return first_of_key(stored, key)


def journal_rows(polls: DataFrame, detections: DataFrame) -> DataFrame:
    """polls (source, requested_at, window_start, window_end, error) with status and the detections each source gave."""
    counts = detections.groupBy(F.col("sensor").alias("source")).agg(F.count("*").alias("detection_count"))
    failed = F.col("error").isNotNull()
    joined = polls.join(counts, "source", "left")
    return joined.withColumn("status", F.when(failed, "failed").otherwise("ok")).withColumn("detection_count", F.when(failed, 0).otherwise(F.coalesce("detection_count", F.lit(0))).cast("int"))


def record_polls(path: str, rows: DataFrame) -> None:
    if not rows.where(~F.coalesce(F.col("status").isin("ok", "failed"), F.lit(False))).isEmpty():
        raise ValueError("status must be ok or failed")
    rows.write.mode("append").parquet(path)


def between(stored: DataFrame, start, end, sensor: str | None = None) -> DataFrame:
    """Detections of a span, ends included, in order of time; whole days outside aren't read."""
    span = F.col("acquired_at").between(start, end)
    if "acq_date" in stored.columns:
        span = span & F.col("acq_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    rows = stored.where(span)
    return (rows if sensor is None else rows.where(F.col("sensor") == sensor)).orderBy("acquired_at", "ordinal")


def observed(journal: DataFrame, detections: DataFrame, source: str, start: Column, end: Column) -> DataFrame:
    """One row (observed, observations, detections, failures): polls of a source whose windows meet a span, and the source's
    detections in it. Overlapping polls see a detection more than once, so it is counted in the detections' own table."""
    looks = journal.where((F.col("source") == source) & (F.col("window_start") <= end) & (F.col("window_end") >= start))
    polls = looks.agg((F.count_if(F.col("status") == "ok") > 0).alias("observed"), F.count_if(F.col("status") == "ok").alias("observations"), F.count_if(F.col("status") != "ok").alias("failures"))
    seen = once(detections.where((F.col("sensor") == source) & F.col("acquired_at").between(start, end))).agg(F.count("*").alias("detections"))
    return polls.crossJoin(seen).select("observed", "observations", "detections", "failures")  # one row each


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, allow_nan=False, separators=(",", ":")).encode()).hexdigest()[:16]


VERSION = 2


def save_snapshot(spark: SparkSession, path: str, members: DataFrame, polls: DataFrame, config: dict) -> dict[str, int]:
    """members (event rows first, then the others, one per rounded key), polls and a row about the snapshot; returns bytes.

    A snapshot is a new folder below path; its row about itself is written last, so one that was cut off is never read."""
    folder = f"{path}/snapshot-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    key = ["sensor", "acquired_at", "_lat", "_lon"]
    rows = members.withColumn("_lat", F.round("latitude", 5)).withColumn("_lon", F.round("longitude", 5)).withColumn("_p", F.struct(F.col("event_id").isNull(), "ordinal"))
    first_of_key(rows, tuple(key), "_p").drop("_lat", "_lon", "_p").write.option("compression", "zstd").parquet(f"{folder}/detections")
    polls.write.option("compression", "zstd").parquet(f"{folder}/polls")
    spark.createDataFrame([(VERSION, fingerprint(config))], "version int, fingerprint string").coalesce(1).write.parquet(f"{folder}/meta")
    fs, p = _folder(spark, folder)
    return {t: fs.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}")).getLength() for t in ("detections", "polls")}


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Whole snapshots, the latest first."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = sorted((str(x.getPath().getName()) for x in fs.listStatus(p)), reverse=True)
    return [f"{path}/{n}" for n in names if n.startswith("snapshot-") and _exists(spark, f"{path}/{n}/meta/_SUCCESS")]


def load_snapshot(spark: SparkSession, path: str, config: dict) -> tuple[DataFrame, DataFrame] | None:
    """(members, polls) of the latest whole snapshot, or None if there is none, it is of another version or configuration, or
    an event's id isn't the one that its earliest detection gives."""
    found = _snapshots(spark, path)
    if not found:
        return None
    meta = spark.read.parquet(f"{found[0]}/meta").first()
    if meta is None or meta["version"] != VERSION or meta["fingerprint"] != fingerprint(config):
        return None
    members = spark.read.parquet(f"{found[0]}/detections")
    if not wrong_ids(members).isEmpty():
        return None
    return members, spark.read.parquet(f"{found[0]}/polls")


def wrong_ids(members: DataFrame) -> DataFrame:
    """Rows (event_id, expected) of events whose id can't be made again from their detections."""
    first = F.min_by(F.struct("latitude", "longitude", "acquired_at"), F.struct("acquired_at", "ordinal")).alias("f")
    each = members.where("event_id is not null").groupBy("event_id").agg(first)
    expected = event_id(F.col("f.latitude"), F.col("f.longitude"), F.col("f.acquired_at"))
    return each.select("event_id", expected.alias("expected")).where("event_id != expected")
