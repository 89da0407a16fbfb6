"""Summaries that the query entry points return: archives, sources' health and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.confidence import is_archive


def archive_summary(detections: DataFrame) -> DataFrame:
    """Rows (kind, name, n): counts by year, sensor, named fire type, and archive against near real time."""
    named = detections.select(
        F.explode(
            F.array(
                F.struct(F.lit("year").alias("kind"), F.year("acquired_at").cast("string").alias("name")),
                F.struct(F.lit("sensor").alias("kind"), F.col("sensor").alias("name")),
                F.struct(F.lit("fire_type").alias("kind"), F.col("fire_type").cast("string").alias("name")),
                F.struct(F.lit("origin").alias("kind"), F.when(is_archive(F.col("version")), "archive").otherwise("nrt").alias("name")),
            )
        ).alias("x")
    )
    return named.where("x.name is not null").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def health(sources: DataFrame, polls: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per configured source, polled or not: its last good poll, failures and detections."""
    good = polls.groupBy("source").agg(F.max(F.when(F.col("status") == "ok", F.col("requested_at"))).alias("last_ok"), F.count_if(F.col("status") == "failed").alias("failures"))
    seen = detections.groupBy(F.col("sensor").alias("source")).agg(F.max("acquired_at").alias("last_detection"), F.count("*").alias("detections"))
    return sources.join(good, "source", "left").join(seen, "source", "left").fillna(0, ["failures", "detections"])


def area_stats(burns: DataFrame) -> DataFrame:
    """One row, for no burns too: area of burns that are ok, how many counted, were unvalidated or something else."""
    ok = F.col("status") == "ok"
    out = burns.agg(
        F.coalesce(F.sum(F.when(ok, F.col("area_ha"))), F.lit(0.0)).alias("area_ha"), F.count_if(ok).alias("counted"),
        F.count_if(ok & ~F.col("validated")).alias("unvalidated"), F.count_if(~ok).alias("other"),
    )
    return out.withColumn("validated", (F.col("counted") > 0) & (F.col("unvalidated") == 0))
