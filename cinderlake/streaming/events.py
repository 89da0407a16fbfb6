"""Fire events as a stream: links found with state, events joined and told batch by batch, silence by timers.

Three steps, each a stream of its own, so that each recovers from its own checkpoint:

1. `event_links`: detections are dealt to coarse blocks of cells. One within reach of a block's border also goes to the
   blocks beyond it, so that each pair of neighbours meets in some block. A block's state holds the places of the last
   periods, and new detections are compared with it: what comes out is links (ordinal, ordinal) of one event. Detections of
   one half-radius cell and one period are near each other whatever their places, so they are one node, and only nodes are
   linked: links grow with the detections, not with their pairs. Timers by event time drop the periods that nothing can
   reach any more.
2. `EventLog`, for foreachBatch: joins links with the events so far. Members are appended, and so is what became of an event
   that another one took in; only the detections that may still be linked are read again. A repeated batch writes the
   same folder.
3. `silences`: a timer by event time for each event, set again by each update and dropped when another event takes it in.
   `StatusLog`, for foreachBatch, holds silent events against the polls, and appends each change of a status once.

Any order and any split into batches gives the same events as the batch operator, as long as no detection comes later than
the lateness; later ones are left out by the watermark. Streams with state need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).

Edge cases: repeated detections are members of the same event; detections without a place or time are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinderlake.functions import geo
from cinderlake.operators.graph import components
from cinderlake.operators.points import EventRules, _block, coverage
from cinderlake.staging import staged

#: Radii in the side of a block whose state is kept together.
BLOCK = 16
LINK = "u long, v long, us long"

_PLACE = np.dtype([("lat", "f8"), ("lon", "f8"), ("from", "i8"), ("to", "i8"), ("row", "i8"), ("col", "i8"), ("node", "i8")])


class Links(StatefulProcessor):
    """Of one block: a table of places for each period, as bytes by period."""

    def __init__(self, radius_m: float, gap_us: int):
        self.radius_m, self.gap_us = radius_m, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.periods = handle.getMapState("periods", "period long", "places binary")

    def _held(self, period: int) -> np.ndarray:
        found = self.periods.getValue((period,)) if self.periods.containsKey((period,)) else None
        return np.frombuffer(found[0], _PLACE).copy() if found else np.zeros(0, _PLACE)

    def _near(self, place: np.void, others: np.ndarray) -> np.ndarray:
        apart = np.maximum(others["from"] - place["to"], place["from"] - others["to"])
        cos = np.cos(np.radians((others["lat"] + place["lat"]) / 2))
        far = np.hypot((others["lon"] - place["lon"]) * geo.METRES * cos, (others["lat"] - place["lat"]) * geo.METRES)
        return (apart <= self.gap_us) & (far <= self.radius_m)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        out: list[tuple[int, int, int]] = []
        changed: set[int] = set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                period = int(r.period)
                for p in (period - 1, period, period + 1):
                    if p not in held:
                        held[p] = self._held(p)
                own = held[period]
                node = own["node"][(own["row"] == r.half_row) & (own["col"] == r.half_col)]
                node = int(node[0]) if len(node) else int(r.ordinal)
                if r.own:
                    out.append((int(r.ordinal), node, int(r.us)))
                at = np.flatnonzero((own["lat"] == r.latitude) & (own["lon"] == r.longitude))
                if len(at):
                    place = own[at[0]]
                    if place["from"] <= r.us <= place["to"]:
                        continue  # the place says no more than before
                    own["from"][at[0]], own["to"][at[0]] = min(place["from"], r.us), max(place["to"], r.us)
                    place = own[at[0]]
                else:
                    place = np.array([(r.latitude, r.longitude, r.us, r.us, r.half_row, r.half_col, node)], _PLACE)[0]
                    held[period] = np.append(own, place)
                changed.add(period)
                near: set[int] = set()
                for p in (period - 1, period, period + 1):
                    near |= set(held[p]["node"][self._near(place, held[p])].tolist())
                out += [(node, other, int(r.us)) for other in near - {node}]
        known = {int(k[0]) for k in self.periods.keys()}
        for p in changed:
            self.periods.updateValue((p,), (held[p].tobytes(),))
            if p not in known:
                # what comes a gap after the period's end can't reach it
                self.handle.registerTimer(((p + 2) * self.gap_us) // 1000 + 1)
        yield pd.DataFrame(sorted(set(out)), columns=["u", "v", "us"]).astype("int64")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        gone = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for (p,) in list(self.periods.keys()):
            if (p + 2) * self.gap_us <= gone:
                self.periods.removeKey((p,))
        yield pd.DataFrame({"u": [], "v": [], "us": []}).astype("int64")

    def close(self) -> None:
        pass


def _blocks(lat: Column, lon: Column, radius_m: float) -> Column:
    """The blocks that hold the place or lie within reach of it; the first is its own."""
    size = radius_m * BLOCK
    reach = radius_m * 1.001 / geo.METRES

    def block(y: Column, x: Column) -> Column:
        row, col = _block(geo.cell_row(y, size), y, x, size)
        return F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"))

    farthest = F.least(F.abs(lat) + reach, F.lit(89.9))
    wide = F.lit(reach) / F.cos(F.radians(farthest))
    return F.array_distinct(F.array(block(lat, lon), *[block(lat + dy, lon + dx) for dy in (F.lit(-reach), F.lit(0.0), F.lit(reach)) for dx in (-wide, F.lit(0.0), wide)]))


def event_links(detections: DataFrame, rules: EventRules = EventRules(), lateness: str = "3 days") -> DataFrame:
    """A stream of links (u, v, us): u, seen at us, belongs to the event of v. Every detection is told, with itself if alone."""
    gap_us = int(rules.gap_hours * 3_600_000_000)
    us = F.unix_micros("acquired_at")
    b_row, b_col = _block(geo.cell_row(F.col("latitude"), rules.radius_m / 2), F.col("latitude"), F.col("longitude"), rules.radius_m / 2)
    known = detections.where("ordinal is not null and latitude is not null and longitude is not null and acquired_at is not null").withWatermark("acquired_at", lateness)
    keyed = known.select(
        "ordinal", "latitude", "longitude", "acquired_at", us.alias("us"), F.floor(us / F.lit(gap_us)).alias("period"), b_row.cast("long").alias("half_row"), b_col.cast("long").alias("half_col"),
        F.posexplode(_blocks(F.col("latitude"), F.col("longitude"), rules.radius_m)).alias("at", "block"),
    )
    sent = keyed.select("ordinal", "latitude", "longitude", "acquired_at", "us", "period", "half_row", "half_col", (F.col("at") == 0).alias("own"), F.col("block.row").alias("block_row"), F.col("block.col").alias("block_col"))
    return sent.groupBy("block_row", "block_col").transformWithStateInPandas(Links(rules.radius_m, gap_us), LINK, "Append", "EventTime")


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [str(x.getPath().getName()) for x in fs.listStatus(p)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _before(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """The table that the last batch before this one wrote."""
    found = [k for k in _folders(spark, path) if k < batch]
    return spark.read.schema(schema).parquet(f"{path}/batch={found[-1]}") if found else spark.createDataFrame([], schema)


OPEN = "ordinal long, root long, us long"
UPDATE = "root long, last_us long, into long, at timestamp"


class EventLog:
    """For foreachBatch over `event_links`: tables below path, a folder for each batch.

    members: ordinal, root; renames: root, into; updates: events with a new last detection, and those that another took in;
    open: detections that may still be linked, with their event, so many hours back as `keep_hours` says (the lateness and
    two gaps at least)."""

    def __init__(self, path: str, keep_hours: float = 24 * 14):
        self.path, self.keep_us = path, int(keep_hours * 3_600_000_000)

    def __call__(self, links: DataFrame, batch: int) -> None:
        spark = links.sparkSession
        links = staged(links.distinct(), "links")
        old = _before(spark, f"{self.path}/open", batch, OPEN)
        held = old.select("ordinal", "root")
        told = lambda side: held.toDF(side, f"{side}_root")
        pairs = links.select("u", "v").join(told("u"), "u", "left").join(told("v"), "v", "left")
        edges = pairs.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u != v").distinct()
        joined = staged(components(edges).select(F.col("u").alias("was"), F.col("root").alias("now")), "joined")
        new = links.groupBy(F.col("u").alias("ordinal")).agg(F.max("us").alias("us")).join(held.select("ordinal"), "ordinal", "left_anti").select("ordinal", F.col("ordinal").alias("root"), "us")
        both = old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))).join(joined, F.col("root") == F.col("was"), "left")
        now = staged(both.select("ordinal", F.coalesce("now", "root").alias("root"), "us", "new", F.when(~F.col("new") & (F.col("now") != F.col("root")), F.col("root")).alias("old")), "now")
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        write(now.where("new").select("ordinal", "root"), "members")
        renames = now.where("old is not null").select(F.col("old").alias("root"), F.col("root").alias("into")).distinct()
        write(renames, "renames")
        newest = now.agg(F.max("us")).first()[0]
        at = F.timestamp_micros(F.lit(newest))
        # the events that a new detection or another event came to, with their last time
        touched = now.where("new or old is not null").select("root").distinct()
        last = now.join(touched, "root").groupBy("root").agg(F.max("us").alias("last_us"))
        write(last.select("root", "last_us", F.lit(None).cast("long").alias("into"), at.alias("at")).unionByName(renames.select("root", F.lit(None).cast("long").alias("last_us"), "into", at.alias("at"))), "updates")
        write(now.where(F.col("us") >= F.lit((newest or 0) - self.keep_us)).select("ordinal", "root", "us"), "open")


def told_members(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ordinal, event_root) of an EventLog: each detection with the event that it is in by now."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    final = components(read("renames", "root long, into long").select(F.col("root").alias("u"), F.col("into").alias("v"))).select(F.col("u").alias("root"), F.col("root").alias("now"))
    return read("members", "ordinal long, root long").join(final, "root", "left").select("ordinal", F.coalesce("now", "root").alias("event_root"))


class Silence(StatefulProcessor):
    """Of one event: its last detection, and whether it was told to be silent."""

    def __init__(self, silence_us: int):
        self.silence_us = silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("event", "last_us long, silent boolean")

    def _row(self, key: Any, last: int, into: int | None, status: str) -> pd.DataFrame:
        return pd.DataFrame({"root": pd.array([key[0]], "Int64"), "last_us": pd.array([last], "Int64"), "into": pd.array([into], "Int64"), "status": [status]})

    def _clear_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))
        held = self.state.get() if self.state.exists() else None
        if seen["into"].notna().any():
            self._clear_timers()
            self.state.clear()
            yield self._row(key, held[0] if held else 0, int(seen["into"].dropna().iloc[0]), "merged")
            return
        last = int(max(seen["last_us"].max(), held[0] if held else 0))
        if held and last == held[0]:
            return
        self._clear_timers()
        self.handle.registerTimer((last + self.silence_us) // 1000)
        self.state.update((last, False))
        yield self._row(key, last, None, "active")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, _ = self.state.get()
        self.state.update((last, True))
        yield self._row(key, last, None, "silent")

    def close(self) -> None:
        pass


def silences(updates: DataFrame, rules: EventRules = EventRules(), lateness: str = "3 days") -> DataFrame:
    """A stream of changes (root, last_us, into, status: active, silent or merged) from the stream of an EventLog's updates.

    An event is silent once the watermark has passed its last detection by the days of completion."""
    timed = updates.select("root", "last_us", "into", "at").withWatermark("at", lateness)
    return timed.groupBy("root").transformWithStateInPandas(Silence(rules.completion_days * 86_400_000_000), "root long, last_us long, into long, status string", "Append", "EventTime")


STATUS = "event_root long, last_us long, status string"


class StatusLog:
    """For foreachBatch over `silences`: the status of each event, and its changes, each told once.

    A silent event is complete if enough good polls overlap the time since its last detection, else unconfirmed, and looked
    at again with each batch. journal: gives the polls (window_start, window_end, status); now: gives the time they go up to."""

    def __init__(self, path: str, journal: Callable[[SparkSession], DataFrame], now: Callable[[], Column], rules: EventRules = EventRules()):
        self.path, self.journal, self.now, self.rules = path, journal, now, rules

    def __call__(self, changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        old = _before(spark, f"{self.path}/status", batch, STATUS)
        # of one event's changes in a batch the last counts: merged, then by time, silence after what broke it
        order = F.struct((F.col("status") == "merged").alias("m"), "last_us", (F.col("status") == "silent").alias("s"))
        latest = staged(changes.groupBy(F.col("root").alias("event_root")).agg(F.max_by(F.struct("last_us", "status"), order).alias("c")).select("event_root", "c.*"), "changes")
        kept = old.join(latest.select("event_root"), "event_root", "left_anti")
        settled = kept.where("status in ('active', 'complete')").unionByName(latest.where("status = 'active'"))
        silent = kept.where("status = 'unconfirmed'").unionByName(latest.where("status = 'silent'"))
        timed = silent.select("event_root", "last_us", F.timestamp_micros("last_us").alias("last_seen"))
        closed = coverage(timed, self.journal(spark), self.now())
        ended = F.when(F.col("ok_polls") >= self.rules.min_observations, "complete").otherwise("unconfirmed")
        status = staged(settled.unionByName(closed.select("event_root", "last_us", ended.alias("status"))), "status")
        was = old.select("event_root", F.col("status").alias("was"))
        told = status.join(was, "event_root", "left").where("was is null or was != status").select("event_root", "status")
        gone = latest.where("status = 'merged'").join(was, "event_root").select("event_root", "status")
        told.unionByName(gone).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        status.write.mode("overwrite").parquet(f"{self.path}/status/batch={batch}")


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    return _before(spark, f"{path}/status", 1 << 62, STATUS)
