"""Detections and polls as streams: deduplication of overlapping polls and silence by place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import geo
from cinderlake.operators.points import KEY
from cinderlake.sources.store import add_detections


def once_within(detections: DataFrame, lateness: str = "3 days") -> DataFrame:
    """A stream of detections, each key once as long as repeats come within the lateness; state is dropped after it."""
    return detections.withWatermark("acquired_at", lateness).dropDuplicatesWithinWatermark(list(KEY))


def appender(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends what the store at this path doesn't hold, so a repeated batch adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        add_detections(batch.sparkSession, path, batch)

    return run


def burning_cells(detections: DataFrame, cell_m: float = 3000.0, gap: str = "48 hours", lateness: str = "3 days") -> DataFrame:
    """Sessions of detections in one cell that no gap interrupts; it sees cells alone, so fronts that cross cells stay apart.

    Fire events as such need neighbours, and come from the batch operator."""
    at = geo.with_cell(detections.withWatermark("acquired_at", lateness), cell_m)
    return at.groupBy(F.session_window("acquired_at", gap).alias("w"), "cell_row", "cell_col").agg(F.count("*").alias("n"), F.max("frp").alias("max_frp")).select("cell_row", "cell_col", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_frp")


def settled_cells(detections: DataFrame, polls: DataFrame, silence: str = "7 days", cell_m: float = 3000.0, lateness: str = "3 days") -> DataFrame:
    """Cells that fell silent and were looked at since: sessions of detections that no shorter silence interrupts, joined with
    good polls of the time after. A session is told once the watermark has passed its silence; a poll completes it if its
    window begins after the last detection and within the silence. Sessions without such a poll aren't told.

    polls: window_start (a time), status."""
    at = geo.with_cell(detections.withWatermark("acquired_at", lateness), cell_m)
    sessions = at.groupBy(F.session_window("acquired_at", silence).alias("w"), "cell_row", "cell_col").agg(F.count("*").alias("n"), F.max("acquired_at").alias("last_seen"))
    sessions = sessions.select("cell_row", "cell_col", "n", "last_seen", F.col("w.end").alias("silent_until"))
    good = polls.where("status = 'ok'").select("window_start").withWatermark("window_start", lateness)
    after = (F.col("window_start") > F.col("last_seen")) & (F.col("window_start") <= F.col("silent_until"))
    # equal days bound what a session meets; the condition on times bounds the state
    days = good.withColumn("_day", F.to_date("window_start"))
    keyed = sessions.withColumn("_day", F.explode(F.sequence(F.to_date("last_seen"), F.to_date("silent_until"))))
    return keyed.join(days, "_day").where(after).select("cell_row", "cell_col", "n", "last_seen", "silent_until", "window_start")


def renamed_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (old_id, new_id) of events whose earliest detection came late: the detection that they share tells them.

    before, after: ordinal, event_id of two runs."""
    joined = before.select("ordinal", F.col("event_id").alias("old_id")).join(after.select("ordinal", F.col("event_id").alias("new_id")), "ordinal")
    return joined.where("old_id != new_id").select("old_id", "new_id").distinct()


def source_lag(detections: DataFrame, arrived: Column, lateness: str = "3 days") -> DataFrame:
    """A stream of each source's lag by hour of arrival: detections, mean and largest hours from taking to arrival."""
    hours = (F.unix_micros("arrived_at") - F.unix_micros("acquired_at")) / 3_600_000_000
    timed = detections.withColumn("arrived_at", arrived).withWatermark("arrived_at", lateness).withColumn("hours", hours)
    return timed.groupBy(F.window("arrived_at", "1 hour").alias("w"), "sensor").agg(F.count("*").alias("n"), F.avg("hours").alias("mean_h"), F.max("hours").alias("max_h")).select("sensor", F.col("w.start").alias("hour"), "n", "mean_h", "max_h")
