from pyspark.sql import functions as F

from cinderlake.plans.derived import Tables
from cinderlake.streaming import polls
from tests.compare import DATA


def test_overlapping_polls_and_sessions(spark, tmp_path):
    d = Tables(spark, str(DATA)).detections().where("ordinal < 300")
    d.write.parquet(str(tmp_path / "in"))
    d.where("ordinal >= 200").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain(writer, name):
        writer.option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start().awaitTermination(120)

    keys = d.select("sensor", "latitude", "longitude", "acquired_at").distinct().count()
    drain(polls.once_within(stream, "40 days").writeStream.format("memory").queryName("once"), "once")
    assert spark.table("once").count() == keys
    drain(stream.writeStream.foreachBatch(polls.appender(str(tmp_path / "store"))), "store")
    assert spark.read.parquet(str(tmp_path / "store")).count() == keys
    drain(polls.burning_cells(stream, lateness="40 days").writeStream.outputMode("complete").format("memory").queryName("cells"), "cells")
    got = spark.table("cells").groupBy().sum("n").first()[0]
    assert got == d.count() + d.where("ordinal >= 200").count()


def test_lag_silence_and_renames(spark, tmp_path):
    rows = [("A", 10.0, 20.0, f"2024-01-{d:02d} 06:00:00", f"2024-01-{d:02d} {6 + d % 3:02d}:30:00") for d in range(1, 6)] + [("A", 30.0, 20.0, "2024-02-20 06:00:00", "2024-02-20 07:00:00")]
    df = spark.createDataFrame(rows, "sensor string, latitude double, longitude double, a string, b string")
    df = df.select("sensor", "latitude", "longitude", F.col("a").cast("timestamp").alias("acquired_at"), F.col("b").cast("timestamp").alias("came"), F.lit(1.0).alias("frp"))
    looks = spark.createDataFrame([("2024-01-08 00:00:00", "ok"), ("2024-01-09 00:00:00", "failed"), ("2024-01-20 00:00:00", "ok"), ("2024-02-25 00:00:00", "ok")], "t string, status string").select(F.col("t").cast("timestamp").alias("window_start"), "status")
    for name, table in (("d", df), ("p", looks)):
        table.coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda name, table: spark.readStream.schema(table.schema).parquet(str(tmp_path / name))

    def drain(out, name, mode):
        out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    lag = drain(polls.source_lag(stream("d", df), F.col("came"), "40 days"), "lag", "complete")
    assert sum(r.n for r in lag) == 6 and max(r.max_h for r in lag) == 2.5
    settled = drain(polls.settled_cells(stream("d", df), stream("p", looks)), "settled", "append")
    assert [(r.n, str(r.last_seen), str(r.window_start)) for r in settled] == [(5, "2024-01-05 06:00:00", "2024-01-08 00:00:00")]
    before = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "ordinal long, event_id string")
    after = spark.createDataFrame([(1, "z"), (2, "z"), (3, "y"), (4, "z")], "ordinal long, event_id string")
    assert [tuple(r) for r in polls.renamed_events(before, after).collect()] == [("x", "z")]
