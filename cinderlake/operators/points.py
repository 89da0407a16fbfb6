"""Detections to fire events: deduplication, persistent sources, clustering in space and time, completion."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions import geo
from cinderlake.operators import blocks
from cinderlake.operators.graph import components
from cinderlake.staging import discard, staged


@dataclass(frozen=True)
class EventRules:
    radius_m: float = 3000.0
    gap_hours: float = 48.0
    completion_days: int = 7
    min_observations: int = 1


@dataclass(frozen=True)
class PersistenceRules:
    window_days: int = 14
    radius_m: float = 500.0
    min_days: int = 10
    max_cv: float | None = 0.6


KEY = ("sensor", "latitude", "longitude", "acquired_at")


def first_of_key(rows: DataFrame, key: tuple[str, ...] = KEY, order: str = "ordinal") -> DataFrame:
    """One row per key: the first in order."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_of_key(rows: DataFrame, key: tuple[str, ...], order: str = "ordinal") -> DataFrame:
    return first_of_key(rows.withColumn("_o", -F.col(order)), key, "_o").drop("_o")


def _sent(points: DataFrame, carried: list[str], radius_m: float, gap_us: int, since: str, until: str) -> tuple[DataFrame, DataFrame]:
    """Points as a_* in all cells that they are sent to, and as b_* in their own.

    Cells are two radii and two gaps wide. A point is sent to its own and to the later ones, by row, column and slot of time,
    that the radius and the gap around it reach: four or five on average, of the 23 of half this size around it. A row's
    columns are as wide as its own latitude says. Times from since to until lie in one slot of each two gaps from 1970 on."""
    size, slot_us = max(2 * radius_m, 1e-3), max(2 * gap_us, 1)
    # a little more than the radius, so that no rounding leaves out what is exactly that far; no two longitudes are 720 apart
    reach = radius_m / geo.METRES * (1 + 1e-6) + 1e-12
    lat, lon = F.col("latitude"), F.col("longitude")
    up, down = F.cos(F.radians(lat + reach)), F.cos(F.radians(lat - reach))
    narrow = F.when(up * down > 0, F.greatest(F.least(F.abs(up), F.abs(down)), F.lit(1e-6))).otherwise(F.lit(1e-6))
    wide = F.least(reach / narrow, F.lit(720.0))
    slot = lambda us: F.floor(us / F.lit(slot_us))
    placed = geo.with_cell(points, size).withColumn("slot", slot(F.col(since)))
    keys = ["cell_row", "cell_col", "slot"]
    left = placed.select(
        *[F.col(c).alias(f"a_{c}") for c in carried], *[F.col(k).alias(f"own_{k}") for k in keys], (lon - wide).alias("west"), (lon + wide).alias("east"),
        slot(F.col(since) - gap_us).alias("first"), slot(F.col(until) + gap_us).alias("last"), F.explode(F.sequence("cell_row", geo.cell_row(lat + reach, size))).alias("cell_row"),
    )
    cols = F.sequence(geo.cell_col(F.col("west"), F.col("cell_row"), size), geo.cell_col(F.col("east"), F.col("cell_row"), size))
    left = left.withColumn("cell_col", F.explode(cols)).where("cell_row > own_cell_row or cell_col >= own_cell_col")
    left = left.withColumn("slot", F.explode(F.sequence("first", "last"))).where("cell_row > own_cell_row or cell_col > own_cell_col or slot >= own_slot")
    same = (F.col("cell_row") == F.col("own_cell_row")) & (F.col("cell_col") == F.col("own_cell_col")) & (F.col("slot") == F.col("own_slot"))
    left = left.select(*[f"a_{c}" for c in carried], same.alias("same"), *keys)
    right = placed.select(*[F.col(c).alias(f"b_{c}") for c in carried], *keys)
    return left, right


def _met(points: DataFrame, carried: list[str], radius_m: float, gap_us: int, since: str, until: str) -> DataFrame:
    """Pairs that may be within the radius and the gap, each once: columns a_* and b_* of what is carried, and whether both
    share a cell."""
    left, right = _sent(points, carried, radius_m, gap_us, since, until)
    return left.join(right.hint("merge"), ["cell_row", "cell_col", "slot"])


def near_pairs(detections: DataFrame, radius_m: float, gap_hours: float) -> DataFrame:
    """Pairs (u, v), u < v, of detections within the radius and the gap in time: as many as there are.

    Points are keyed by cells of two radii and two gaps; each is sent to its own and the later ones that it reaches. Points of
    a cell meet by blocks."""
    gap_us = int(gap_hours * 3_600_000_000)
    points = detections.select("ordinal", "latitude", "longitude", F.unix_micros("acquired_at").alias("us"))
    left, right = _sent(points, points.columns, radius_m, gap_us, "us", "us")
    columns = {"id": "bigint", "latitude": "double", "longitude": "double", "us": "bigint"}
    keys = ["cell_row", "cell_col", "slot"]

    def side(df: DataFrame, p: str, key: list[str], most: int) -> DataFrame:
        rows = df.select(*key, *[F.col(f"{p}_{c}").alias("id" if c == "ordinal" else c) for c in points.columns])
        # of one place and a quarter of the gap, ids lie together: most eights are of smaller ids than a detection's, or of larger
        return blocks.packed(rows.withColumn("quarter", F.floor(F.col("us") / max(gap_us // 4, 1))), p, key, ["latitude", "longitude", "quarter", "id"], list(columns), most)

    def close(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        # detections of one place lie together, and places are compared once
        (first, run), (b_first, b_run) = (blocks.rows_alike(x["latitude"], x["longitude"]) for x in (a, b))
        lat, lon, b_lat, b_lon = a["latitude"][first, None], a["longitude"][first, None], b["latitude"][b_first], b["longitude"][b_first]
        x = (lon - b_lon) * geo.METRES * np.cos(np.radians((lat + b_lat) / 2))
        met = (np.hypot(x, (lat - b_lat) * geo.METRES) <= radius_m)[run][:, b_run]
        met &= a["us"][:, None] - gap_us <= b["us"]
        met &= b["us"] <= a["us"][:, None] + gap_us
        return np.ascontiguousarray(met)

    c = F.col
    reach = radius_m / geo.METRES * (1 + 1e-6) + 1e-12
    may = lambda x, far: (c(f"a_{x}_low") - far <= c(f"b_{x}_high")) & (c(f"b_{x}_low") - far <= c(f"a_{x}_high"))
    met = blocks.joined(side(left, "a", [*keys, "same"], blocks.MOST_A), side(right, "b", keys, blocks.MOST_B), keys, may("latitude", F.lit(reach)) & may("us", F.lit(gap_us)) & (~c("same") | (c("a_id_low") < c("b_id_high"))))
    return blocks.pairs(met, columns, close, ordered=True, once="same").toDF("u", "v")


def _block(row: Column, lat: Column, lon: Column, size_m: float) -> tuple[Column, Column]:
    """Cell of at most size_m by size_m at any of its latitudes: columns are measured at the row's edge next the equator."""
    step = size_m / geo.METRES
    widest = F.when((row < 0) & (row + 1 > 0), F.lit(0.0)).otherwise(F.least(F.abs(row * step), F.abs((row + 1) * step)))
    return row, F.floor(lon * geo.METRES * F.greatest(F.cos(F.radians(widest)), F.lit(1e-6)) / size_m)


def event_members(detections: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """detections with event_root, the smallest ordinal of its component of near pairs.

    Pairs aren't listed. Detections of one place and one period of a gap's length are one unit with its first and last
    time, which say all that time can about its neighbours. Units of one block, half a radius wide, and one period are near
    each other whatever their places, so a block is one node, named by its smallest ordinal; only units of different
    blocks are compared, and what comes of it is links of blocks."""
    gap_us = int(rules.gap_hours * 3_600_000_000)
    us = F.unix_micros("acquired_at")
    keyed = detections.select("ordinal", "latitude", "longitude", us.alias("us"), F.floor(us / F.lit(gap_us)).alias("period"))
    units = keyed.groupBy("latitude", "longitude", "period").agg(F.min("us").alias("from"), F.max("us").alias("to"), F.min("ordinal").alias("least"))
    half = rules.radius_m / 2
    b_row, b_col = _block(geo.cell_row(F.col("latitude"), half), F.col("latitude"), F.col("longitude"), half)
    node = F.min("least").over(Window.partitionBy("b_row", "b_col", "period"))
    units = staged(units.withColumns({"b_row": b_row, "b_col": b_col}).withColumn("node", node).drop("b_row", "b_col", "least"), "units")
    met = _met(units, ["latitude", "longitude", "from", "to", "period", "node"], rules.radius_m, gap_us, "from", "to").where("a_node != b_node")
    # within one period all times are within a gap; of two periods in a row, the earlier's last and the later's first count
    apart = F.when(F.col("a_period") < F.col("b_period"), F.col("b_from") - F.col("a_to")).when(F.col("a_period") > F.col("b_period"), F.col("a_from") - F.col("b_to")).otherwise(F.lit(0))
    close = (apart <= gap_us) & (geo.distance_m(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")) <= rules.radius_m)
    links = met.where(close).select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct()
    roots = components(links)
    named = units.join(roots, units.node == roots.u, "left").select("latitude", "longitude", "period", F.coalesce("root", "node").alias("event_root"))
    dealt = detections.withColumn("_period", F.floor(us / F.lit(gap_us)))
    return dealt.join(named.withColumnRenamed("period", "_period").hint("merge"), ["latitude", "longitude", "_period"]).select(*detections.columns, "event_root")


def four_decimals(x: Column) -> Column:
    """A number with four decimals, rounded by its exact value (ties to even), as printf in C or Python does.

    The fraction is taken in two parts of few bits, whose products with 10 000 are exact."""
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole
    head = F.floor(part * (1 << 26)) / F.lit(float(1 << 26))
    up = F.floor(head * 10_000)
    rest = (head * 10_000 - up) + (part - head) * 10_000
    n = (up + F.floor(rest)).cast("long")
    rest = rest - F.floor(rest)
    n = n + F.when((rest > 0.5) | ((rest == 0.5) & (n % 2 == 1)), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, (whole + F.when(n == 10_000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))


def iso_utc(at: Column) -> Column:
    """A time as ISO 8601 in UTC, with microseconds if there are any; whatever the session's time zone."""
    us = F.unix_micros(at)
    day = F.floor(us / 86_400_000_000).cast("int")
    second, micros = F.pmod(F.floor(us / 1_000_000), F.lit(86_400)), F.pmod(us, F.lit(1_000_000))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    tail = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), two(second / 3600), F.lit(":"), two(second % 3600 / 60), F.lit(":"), two(second % 60), tail, F.lit("+00:00"))


def event_id(lat: Column, lon: Column, at: Column) -> Column:
    """FIRE- and twelve digits of the hash of an event's earliest detection: its place to four decimals and its time."""
    return F.concat(F.lit("FIRE-"), F.substring(F.sha2(F.concat_ws("|", four_decimals(lat), four_decimals(lon), iso_utc(at)), 256), 1, 12))


def events(members: DataFrame) -> DataFrame:
    """One row per event: times, box, centroid, power, sensors and the id of its earliest detection."""
    first = F.min_by(F.struct("latitude", "longitude", "acquired_at"), F.struct("acquired_at", "ordinal"))
    rows = members.groupBy("event_root").agg(
        F.count("*").alias("n"), F.min("acquired_at").alias("first_seen"), F.max("acquired_at").alias("last_seen"),
        F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.max("latitude").alias("north"),
        F.avg("longitude").alias("lon"), F.avg("latitude").alias("lat"),
        F.coalesce(F.sum("frp"), F.lit(0.0)).alias("total_frp"), F.max("frp").alias("max_frp"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"), first.alias("_first"),
    )
    days = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 86_400_000_000
    return rows.withColumn("duration_days", days).withColumn("event_id", event_id(F.col("_first.latitude"), F.col("_first.longitude"), F.col("_first.acquired_at"))).drop("_first")


def history(members: DataFrame) -> DataFrame:
    """Each event's detections in order of time, for the edge of an interface."""
    return members.groupBy("event_root").agg(F.array_sort(F.collect_list(F.struct("acquired_at", "ordinal", "latitude", "longitude", "frp"))).alias("history"))


def history_depth(detections: DataFrame, window_days: int) -> DataFrame:
    """One row: days between the first and the last detection, and whether they fill the window."""
    depth = (F.unix_micros(F.max("acquired_at")) - F.unix_micros(F.min("acquired_at"))) / 86_400_000_000
    return detections.agg(F.coalesce(depth, F.lit(0.0)).alias("depth_days")).withColumn("sufficient", F.col("depth_days") >= window_days)


def _leaders(radius_m: float):
    """One pass over each block of cells in order of time: a detection joins the nearest running centroid within the
    radius, or opens a cluster in its own cell. Clusters are found by the cell that they were opened in, in three
    runs of cells (codes that follow each other). What is held is the clusters of one block.

    Rows come sorted by block, with the clusters that it has so far (n > 0, sums of latitude and longitude) before its
    detections (n = 0), in batches that may cut a block. Out come the detections with their clusters, and after each block
    its clusters."""
    step = radius_m / geo.METRES

    def code(row: np.ndarray, lon: np.ndarray) -> np.ndarray:
        width = step / np.maximum(np.cos(np.radians(row * step)), 1e-6)
        return row * _ROW + np.floor(lon / width).astype(np.int64)

    class Block:
        def __init__(self) -> None:
            self.cells: list[int] = []  # of open clusters, in order, and beside them the clusters
            self.opened: list[int] = []
            self.centre = np.zeros((16, 3))  # sums of latitude and longitude, and their number
            self.leader: list[int] = []
            self.since: list[int] = []

        def open(self, ordinal: int, cell: int, since: int) -> int:
            new = len(self.leader)
            self.leader.append(ordinal)
            self.since.append(since)
            at = bisect_right(self.cells, cell)
            self.cells.insert(at, cell)
            self.opened.insert(at, new)
            if new == len(self.centre):
                self.centre = np.concatenate([self.centre, np.zeros_like(self.centre)])
            return new

        def state(self) -> pd.DataFrame:
            own = np.empty(len(self.leader), np.int64)
            own[self.opened] = self.cells
            c = self.centre[: len(self.leader)]
            return pd.DataFrame({"ordinal": self.leader, "cluster": self.leader, "u": own, "latitude": c[:, 0], "longitude": c[:, 1], "n": c[:, 2].astype(np.int64), "us": self.since})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, Block()
        for rows in batches:
            lat, lon, ordinal, us = rows.latitude.to_numpy(), rows.longitude.to_numpy(), rows.ordinal.to_numpy(), rows.us.to_numpy()
            row = np.floor(lat / step).astype(np.int64)
            codes = np.stack([code(row + k, lon) for k in (-1, 0, 1)], 1)
            many, own = rows.n.to_numpy(), rows.u.to_numpy()
            out = np.empty(len(rows), np.int64)
            for i, b in enumerate(rows.block):
                if b != block:
                    if held.leader:
                        yield held.state()
                    block, held = b, Block()
                if many[i]:
                    new = held.open(int(ordinal[i]), int(own[i]), int(us[i]))
                    held.centre[new] = (lat[i], lon[i], many[i])
                    continue
                found = []
                for c in codes[i].tolist():
                    found += held.opened[bisect_left(held.cells, c - 1) : bisect_right(held.cells, c + 1)]
                best = -1
                if found:
                    mine = held.centre[found]
                    y, x = mine[:, 0] / mine[:, 2], mine[:, 1] / mine[:, 2]
                    far = np.hypot((x - lon[i]) * geo.METRES * np.cos(np.radians((y + lat[i]) / 2)), (y - lat[i]) * geo.METRES)
                    last = len(far) - 1 - int(far[::-1].argmin())  # of equal ones the later
                    best = found[last] if far[last] <= radius_m else -1
                if best < 0:
                    best = held.open(int(ordinal[i]), int(codes[i, 1]), int(us[i]))
                held.centre[best] += (lat[i], lon[i], 1)
                out[i] = held.leader[best]
            fresh = many == 0
            yield pd.DataFrame({"ordinal": ordinal[fresh], "cluster": out[fresh], "u": 0, "latitude": 0.0, "longitude": 0.0, "n": 0, "us": 0})
        if held.leader:
            yield held.state()

    return run


#: Cells are told by one number: rows apart by more than any row has columns.
_ROW = 1 << 32
#: Detections of a slab of time, about.
SLAB = 2_000_000
_CLUSTERS = "ordinal long, u long, latitude double, longitude double, n long, us long"


def source_clusters(detections: DataFrame, radius_m: float = 500.0, slab: int = SLAB) -> DataFrame:
    """detections with cluster, the ordinal of the detection that opened its cluster.

    The pass depends on order: it goes through slabs of time, about `slab` detections each, one after another, and hands over
    the clusters' sums. Within a slab, a detection sees only the clusters of the cells around it, so blocks of cells that
    the slab's detections join (through a cell that both see, if it is in use) are clustered apart from each other, in
    parallel. A task holds a block's clusters, and works through one slab of it, however long the block burns. Slabs change
    nothing in the result."""
    code = lambda r, c: F.col(r) * F.lit(_ROW) + F.col(c)
    us = F.unix_micros("acquired_at").alias("us")
    points = geo.with_cell(detections.select("ordinal", "latitude", "longitude", us), radius_m).select("ordinal", "latitude", "longitude", "us", code("cell_row", "cell_col").alias("u"))
    points = staged(points, "cells")
    slabs = max(1, -(-points.count() // slab))
    shares = [k / slabs for k in range(1, slabs)]
    # equal times lie in one slab
    cuts = sorted(set(points.agg(F.percentile_approx("us", shares).alias("q")).first().q or [])) if shares else []
    spark = detections.sparkSession
    clusters = staged(spark.createDataFrame([], _CLUSTERS), "clusters")
    found: list[DataFrame] = []
    for k in range(len(cuts) + 1):
        now = points
        if k:
            now = now.where(F.col("us") > cuts[k - 1])
        if k < len(cuts):
            now = now.where(F.col("us") <= cuts[k])
        around = now.select("u", F.explode(geo.neighbour_cells(F.col("latitude"), F.col("longitude"), radius_m)).alias("n"))
        around = around.select("u", code("n.cell_row", "n.cell_col").alias("v")).where("u != v").distinct()
        used = now.select(F.col("u").alias("v")).union(clusters.select(F.col("u").alias("v"))).distinct()
        roots = components(around.join(used, "v"))
        seen = now.select("u").distinct().join(roots, "u", "left").select("u", F.coalesce("root", "u").alias("block"))
        # cells of clusters that the slab's detections see, though none lies there
        ends = roots.select("u", F.col("root").alias("block")).union(roots.select(F.col("root").alias("u"), F.col("root").alias("block")))
        blocks = staged(seen.union(ends).distinct(), "blocks")
        rows = now.select("ordinal", "u", "latitude", "longitude", F.lit(0).cast("long").alias("n"), "us").withColumns({"_s": F.col("us"), "_t": F.col("ordinal")})
        # of one cell's clusters the earlier first
        before = clusters.withColumns({"_s": F.col("us"), "_t": F.col("ordinal")})
        keyed = rows.unionByName(before).join(blocks.hint("merge"), "u").select("block", "ordinal", "u", "latitude", "longitude", "n", "us", "_s", "_t")
        sorted_ = keyed.repartition("block").sortWithinPartitions("block", F.col("n") == 0, "_s", "_t").drop("_s", "_t")
        told = staged(sorted_.mapInPandas(_leaders(radius_m), "ordinal long, cluster long, u long, latitude double, longitude double, n long, us long"), "told")
        found.append(told.where("n = 0").select("ordinal", "cluster"))
        if k < len(cuts):
            new = told.where("n > 0").select("ordinal", "u", "latitude", "longitude", "n", "us")
            old, clusters = clusters, staged(clusters.join(blocks.select("u").distinct(), "u", "left_anti").select(*new.columns).unionByName(new), "clusters")
            discard(old)
    return detections.join(reduce(lambda a, b: a.unionByName(b), found), "ordinal")


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Per cluster: centroid, detections, distinct UTC days and the variation of power (null for under two values)."""
    cv = F.when((F.count("frp") >= 2) & (F.avg("frp") != 0), F.stddev_samp("frp") / F.avg("frp"))
    return clustered.groupBy("cluster").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count("*").alias("n"), F.countDistinct(F.to_date("acquired_at")).alias("days"), cv.alias("cv"))


def is_persistent(rules: PersistenceRules) -> Column:
    steady = F.lit(True) if rules.max_cv is None else F.col("cv").isNull() | (F.col("cv") <= rules.max_cv)
    return (F.col("days") >= rules.min_days) & steady


def persistent_sources(detections: DataFrame, rules: PersistenceRules = PersistenceRules()) -> DataFrame:
    """Sources of heat that stay, from the last window of days; none if the history is shorter than the window."""
    depth = history_depth(detections, rules.window_days)
    last = detections.agg(F.max("acquired_at").alias("now"))
    recent = detections.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(depth)).where("sufficient")  # one row each
    recent = recent.where(F.unix_micros("acquired_at") >= F.unix_micros("now") - rules.window_days * 86_400_000_000).drop("now", "depth_days", "sufficient")
    return cluster_stats(source_clusters(recent, rules.radius_m)).where(is_persistent(rules))


def split_by_sources(detections: DataFrame, sources: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """(kept, near): detections that no source is within the radius of, and the others."""
    at = geo.with_cell(sources.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), radius_m, "s_lat", "s_lon")
    spread = detections.select("ordinal", "latitude", "longitude", F.explode(geo.neighbour_cells(F.col("latitude"), F.col("longitude"), radius_m)).alias("n"))
    met = spread.select("ordinal", "latitude", "longitude", "n.*").join(at, ["cell_row", "cell_col"])
    near = met.where(geo.distance_m(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon")) <= radius_m).select("ordinal").distinct()
    return detections.join(near, "ordinal", "left_anti"), detections.join(near, "ordinal", "left_semi")


def coverage(events_: DataFrame, journal: DataFrame, now: Column) -> DataFrame:
    """events with ok_polls and failed_polls: journal rows that overlap [last_seen, now], ends included."""
    e = events_.withColumn("_now", now)
    j = journal.select("window_start", "window_end", "status")
    # rows of the journal are polls: few by day, so each event meets those of the days it spans
    day = lambda c: F.to_date(c)
    e_days = e.select("event_root", "last_seen", "_now", F.explode(F.sequence(day(F.col("last_seen")), day(F.col("_now")))).alias("day"))
    j_days = j.withColumn("poll", F.monotonically_increasing_id()).withColumn("day", F.explode(F.sequence(day(F.col("window_start")), day(F.col("window_end")))))
    met = e_days.join(j_days, "day").where("window_start <= _now and window_end >= last_seen").select("event_root", "poll", "status").distinct()
    counts = met.groupBy("event_root").agg(F.count_if(F.col("status") == "ok").alias("ok_polls"), F.count_if(F.col("status") == "failed").alias("failed_polls"))
    return e.join(counts, "event_root", "left").fillna(0, ["ok_polls", "failed_polls"]).drop("_now")


def completion(covered: DataFrame, now: Column, rules: EventRules = EventRules()) -> DataFrame:
    """Status: active within the silence; then complete if polls saw nothing since, else unconfirmed."""
    silent = (F.unix_micros(now) - F.unix_micros("last_seen")) >= rules.completion_days * 86_400_000_000
    status = F.when(~silent, "active").when(F.col("ok_polls") >= rules.min_observations, "complete").otherwise("unconfirmed")
    return covered.withColumn("status", status)


def mappable(events_: DataFrame, now: Column, quiet_days: int = 35, most_km: float = 60.0) -> DataFrame:
    """Events old and small enough to map; all of them if none is."""
    old = (F.unix_micros(now) - F.unix_micros("last_seen")) >= quiet_days * 86_400_000_000
    small = geo.extent_km(F.col("west"), F.col("south"), F.col("east"), F.col("north")) <= most_km
    flagged = events_.withColumn("_ok", old & small)
    some = flagged.agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_some"))
    return flagged.crossJoin(F.broadcast(some)).where("_ok or not _some").drop("_ok", "_some")
