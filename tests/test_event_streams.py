"""Events, silence and status as streams against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cinderlake.operators import points
from cinderlake.operators.points import EventRules
from cinderlake.streaming import events

SCHEMA = "ordinal long, latitude double, longitude double, acquired_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RULES = EventRules(radius_m=3000.0, gap_hours=48.0, completion_days=7)


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def detections(n=220, seed=3):
    """Fronts that cross blocks (a block is 48 km wide), part and meet again, near the equator and far north."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        lat, lon = [(0.01, 0.0), (61.0, 93.0), (-35.2, 12.0)][k % 3]
        hours = rng.uniform(0, 24 * 30)
        step = hours / 24 * 0.02 * rng.choice([1, -1, 1])
        rows.append((k, lat + step + rng.uniform(0, 0.015), lon + step * 1.5 + rng.uniform(0, 0.015), start + dt.timedelta(hours=hours)))
    rows += [(n + k, 10.0, 20.0, start + dt.timedelta(hours=12 * k)) for k in range(30)]
    rows += [(1000, 10.0, 20.0, start), (1001, 10.0, 20.02, start), (1002, 10.0, 20.0269, start + dt.timedelta(hours=48))]
    return rows


def parts(rows):
    """Orders and splits: in time, one after another, and shuffled."""
    timed = sorted(rows, key=lambda r: r[3])
    mixed = rows[:]
    random.Random(8).shuffle(mixed)
    back = timed[::-1]
    return {"timed": [timed[k : k + 60] for k in range(0, len(timed), 60)], "mixed": [mixed[k : k + 90] for k in range(0, len(mixed), 90)], "back": [back[:130], back[130:]]}


def drain(df, sink, at):
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)


def as_stream(spark, folder, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def same_events(spark, rows, path):
    want = points.event_members(spark.createDataFrame(rows, SCHEMA), RULES).collect()
    got = events.told_members(spark, str(path)).collect()
    assert len(got) == len(rows)
    assert {r.ordinal: r.event_root for r in got} == {r.ordinal: r.event_root for r in want}
    assert 5 < len({r.event_root for r in want}) < len(rows)


@pytest.mark.parametrize("order, lateness", [("timed", "3 days"), ("mixed", "60 days"), ("back", "60 days")])
def test_events_of_any_order_are_the_batch_ones(spark, rocks, tmp_path, order, lateness):
    rows = detections()
    stream = as_stream(spark, tmp_path / "in", SCHEMA, parts(rows)[order])
    drain(events.event_links(stream, RULES, lateness), events.EventLog(str(tmp_path / "log"), 24 * (10 if order == "timed" else 100)), tmp_path / "at")
    same_events(spark, rows, tmp_path / "log")


def test_status_is_told_once_and_ends_as_in_batch(spark, rocks, tmp_path):
    rows = detections(150)
    polls = spark.createDataFrame([(dt.datetime(2024, 1, d, h), dt.datetime(2024, 1, d, h + 6), "ok" if d % 2 else "failed") for d in range(1, 20) for h in (0, 12)], "window_start timestamp, window_end timestamp, status string")
    newest = max(r[3] for r in rows)
    stream = as_stream(spark, tmp_path / "in", SCHEMA, parts(rows)["timed"])
    drain(events.event_links(stream, RULES), events.EventLog(str(tmp_path / "log")), tmp_path / "at")
    updates = spark.readStream.schema(events.UPDATE).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log/updates"))
    now = lambda: F.lit(newest - dt.timedelta(days=3))  # noqa: E731  where the watermark ends
    log = events.StatusLog(str(tmp_path / "status"), lambda _: polls, now, RULES)
    drain(events.silences(updates, RULES), log, tmp_path / "at-status")
    found = points.events(points.event_members(spark.createDataFrame([(*r, 1.0, "A") for r in rows], f"{SCHEMA}, frp double, sensor string"), RULES))
    want = points.completion(points.coverage(found.select("event_root", "last_seen"), polls, now()), now(), RULES)
    want = {r.event_root: r.status for r in want.collect()}
    assert {r.event_root: r.status for r in events.latest_status(spark, str(tmp_path / "status")).collect()} == want
    assert set(want.values()) == {"active", "complete", "unconfirmed"}
    # each change once: an event's last one is its status, and no two in a row are equal
    told = {}
    for k in events._folders(spark, str(tmp_path / "status/changes")):
        for r in spark.read.parquet(str(tmp_path / f"status/changes/batch={k}")).collect():
            told.setdefault(r.event_root, []).append(r.status)
    assert all(a != b for s in told.values() for a, b in zip(s, s[1:]))
    assert {k: s[-1] for k, s in told.items() if s[-1] != "merged"} == want
    merged = {k for k, s in told.items() if s[-1] == "merged"}
    assert merged.isdisjoint(want)
    # a batch that comes again changes nothing
    last = events._folders(spark, str(tmp_path / "status/status"))[-1]
    log(spark.createDataFrame([], "root long, last_us long, into long, status string"), last + 1)
    assert spark.read.parquet(str(tmp_path / f"status/changes/batch={last + 1}")).count() == 0


def test_an_event_that_burns_again_is_active_again(spark, rocks, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda days: start + dt.timedelta(days=days)
    us = lambda days: int((at(days) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    batches = [[(1, us(0), None, at(0)), (2, us(0), None, at(0))], [(3, us(12), None, at(12))], [(3, us(12.5), None, at(12.5))], [(1, us(11), None, at(13)), (2, None, 1, at(13))], [(3, us(40), None, at(40))]]
    stream = as_stream(spark, tmp_path / "in", events.UPDATE, batches)
    rows = []
    drain(events.silences(stream, RULES, "1 day"), lambda df, _: rows.extend((r.root, r.status) for r in df.collect()), tmp_path / "at")
    own = lambda k: [s for r, s in rows if r == k]
    assert own(1) == ["active", "silent", "active", "silent"]
    assert own(2) == ["active", "silent", "merged"]
    # a detection that comes with the batch counts before the timers do
    assert own(3) == ["active"] * 3
