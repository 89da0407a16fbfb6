"""Order-dependent and iterative operators against plain versions, and checks at boundary values."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.functions import confidence, geo, indices
from cinderlake.operators import evaluation, graph, morphology, points, raster, rle, selection
from cinderlake.operators.graph import components
from cinderlake.operators.numbering import numbered


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    root = list(range(80))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(k, k) == root[k] for k in range(80))


def test_source_clusters_follow_the_order(spark):
    rng = random.Random(6)
    rows = [(k, 61 + rng.random() * 0.03, 93 + rng.random() * 0.06, f"2026-09-{1 + k % 20:02d} 12:00:00") for k in range(150)]
    df = spark.createDataFrame(rows, "ordinal long, latitude double, longitude double, at string").withColumn("acquired_at", F.col("at").cast("timestamp"))
    got = {r.ordinal: r.cluster for r in points.source_clusters(df, 500.0).collect()}
    # slabs of time hand over their clusters: any number of them gives the same
    for slab in (60, 11):
        assert {r.ordinal: r.cluster for r in points.source_clusters(df, 500.0, slab).collect()} == got
    clusters = {}
    for k, lat, lon, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        # a plain search over all clusters
        far = [(math.hypot((x / n - lon) * geo.METRES * math.cos(math.radians((y / n + lat) / 2)), (y / n - lat) * geo.METRES), name) for name, (y, x, n) in clusters.items()]
        d, name = min(far, default=(math.inf, None))
        name = name if d <= 500.0 else k
        y, x, n = clusters.get(name, (0.0, 0.0, 0))
        clusters[name] = (y + lat, x + lon, n + 1)
        assert got[k] == name


def test_event_ids_are_those_of_python(spark):
    at = [dt.datetime(2026, 9, 1, 12), dt.datetime(2026, 9, 1, 0, 0, 59, 7), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    rng = random.Random(8)
    places = [2.00015, 0.03125, -0.03125, -0.00001, 61.00005, 179.99995, -0.0, 99.99999, 7.0] + [rng.uniform(-180, 180) for _ in range(300)] + [round(rng.uniform(-90, 90), 4) + 0.00005 for _ in range(300)]
    rows = [(x, places[-1 - k], at[k % 3].replace(tzinfo=dt.timezone.utc)) for k, x in enumerate(places)]
    df = spark.createDataFrame(rows, "lat double, lon double, at timestamp")
    got = df.select("lat", "lon", points.event_id(F.col("lat"), F.col("lon"), F.col("at")).alias("id"), points.iso_utc(F.col("at")).alias("iso"), points.four_decimals(F.col("lat")).alias("four")).collect()
    for r, (lat, lon, when) in zip(got, rows):
        assert (r.iso, r.four) == (when.isoformat(), f"{lat:.4f}")
        assert r.id == "FIRE-" + hashlib.sha256(f"{lat:.4f}|{lon:.4f}|{when.isoformat()}".encode()).hexdigest()[:12]


def test_events_are_components_of_near_pairs(spark):
    rng = random.Random(9)
    centres = [(rng.uniform(50, 70), rng.uniform(80, 100)) for _ in range(4)] + [(0.001, 0.0), (-65.0, 179.9)]
    rows = []
    for k in range(400):
        y, x = centres[k % len(centres)]
        rows.append((k, y + rng.uniform(-0.08, 0.08), x + rng.uniform(-0.2, 0.2), dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=rng.uniform(0, 400))))
    rows += [(400 + k, *rows[k % 7][1:3], rows[k][3]) for k in range(100)]
    df = spark.createDataFrame(rows, "ordinal long, latitude double, longitude double, acquired_at timestamp")
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = set()
    for k, lat, lon, at in rows:
        for j, lat2, lon2, at2 in rows[:k]:
            d = math.hypot((lon - lon2) * geo.METRES * math.cos(math.radians((lat + lat2) / 2)), (lat - lat2) * geo.METRES)
            if d <= 3000 and abs(at - at2) <= dt.timedelta(hours=48):
                pairs.add((j, k))
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    assert {(r.u, r.v) for r in points.near_pairs(df, 3000.0, 48.0).collect()} == pairs and len(pairs) > 300
    got = {r.ordinal: r.event_root for r in points.event_members(df).collect()}
    assert got == {k: find(k) for k in root} and len(set(got.values())) > 20


def test_components_by_rounds(spark, monkeypatch):
    """Contraction with more edges than one partition may hold; a path, a hub and random edges."""
    monkeypatch.setattr(graph, "STEP", 16)
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.u: r.root for r in components(df).collect()}
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}


def test_numbers_follow_the_order(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(5), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = {(r.a, r.b): r.number for r in numbered(df, F.desc("a"), "b").collect()}
    assert got == {x: k + 1 for k, x in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert numbered(df.where("a > 9"), "b").count() == 0


def test_labels_and_distances():
    rng = np.random.default_rng(12)
    for eight in (False, True):
        for shape in ((1, 1), (1, 9), (9, 1), (23, 17), (64, 64)):
            mask = rng.random(shape) < 0.55
            want, n = np.zeros(shape, int), 0
            for start in zip(*np.nonzero(mask), strict=True):
                if want[start]:
                    continue
                n += 1
                stack = [start]
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < shape[0] and 0 <= x < shape[1] and mask[y, x] and not want[y, x]:
                        want[y, x] = n
                        stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if eight or not dy or not dx]
            assert (raster.labelled(mask, eight) == want).all()
            if mask.any():
                at = np.argwhere(mask)
                far = raster.distance_to(mask)
                for y, x in np.ndindex(*shape):
                    assert abs(far[y, x] - np.sqrt(((at - (y, x)) ** 2).sum(1).min())) < 1e-9


def test_confidence_at_its_boundaries(spark):
    rows = [("MODIS_NRT", "29", 0), ("MODIS_NRT", "30", 1), ("MODIS_NRT", "79", 1), ("MODIS_NRT", "80", 2), ("MODIS_NRT", "-1", None), ("MODIS_NRT", "101", None), ("MODIS_NRT", "abc", None), ("MODIS_NRT", "", None), ("MODIS_NRT", "7.5", None), ("viirs_x", " L ", 0), ("VIIRS", "h", 2), ("VIIRS", "x", None), ("OTHER", "n", None)]
    got = spark.createDataFrame(rows, "s string, c string, want int").select("want", confidence.level(F.col("s"), F.col("c")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    with pytest.raises(Exception, match="unknown confidence"):
        spark.createDataFrame(rows[4:5], "s string, c string, want int").select(confidence.strict_level(F.col("s"), F.col("c"))).collect()
    with pytest.raises(ValueError):
        confidence.check_thresholds(80, 30)


def test_severity_edges(spark):
    df = spark.createDataFrame([(0.1, 0), (0.1001, 1), (0.27, 1), (0.28, 2), (0.44, 2), (0.45, 3), (0.66, 3), (0.67, 4), (-1.0, 0)], "d double, want int")
    assert all(r.got == r.want for r in df.select("want", indices.severity(F.col("d")).alias("got")).collect())


def test_masks(spark):
    mask = ["##...#", "......", "..####", "..####", "#.....", "##...."]
    rows = [(1, r, c, ch == "#") for r, line in enumerate(mask) for c, ch in enumerate(line)]
    px = spark.createDataFrame(rows, "chip_id long, row int, col int, m boolean")
    near = {(r.row, r.col) for r in raster.drop_far(px, "m", 2.1).where("m").collect()}
    assert near == {(0, 5)} | {(r, c) for r in (2, 3) for c in (2, 3, 4, 5)}
    grown = raster.grow(px.withColumns({"core": (F.col("row") == 2) & (F.col("col") == 2), "near": F.col("m")}), "core", "near", "g").where("g").count()
    assert grown == 8
    back = raster.rescue(px.withColumn("p", F.lit(False)), "m", "p", "o", 2).where("o").count()
    assert back == 3


def test_runs_that_are_bad_raise(spark):
    df = spark.createDataFrame([(1, "1 2 7 1"), (2, "")], "k int, rle string")
    assert sorted(r.pos for r in rle.decode(df, ["k"]).collect()) == [1, 2, 7]
    for bad in ("3", "0 1", "a 1"):
        with pytest.raises(Exception, match="bad runs"):
            rle.decode(spark.createDataFrame([(1, bad)], "k int, rle string"), ["k"]).collect()


def test_bootstrap_verdict(spark):
    rows = [(f"g{g}", m, 10 if m == "y" else 1, 5, 5) for g in range(6) for m in ("x", "y")]
    df = spark.createDataFrame(rows, "group_id string, model string, tp long, fp long, fn long")
    r = evaluation.paired_bootstrap(df, "x", "y", draws=50).first()
    assert r.verdict == "better" and r.groups == 6 and r.low <= r.delta <= r.high
    with pytest.raises(Exception, match="two groups"):
        evaluation.paired_bootstrap(df.where("group_id = 'g1'"), "x", "y")


def test_isolate_goes_in_order(spark):
    rng = random.Random(18)
    box = lambda: (x := rng.uniform(0, 20), y := rng.uniform(0, 20), x + rng.uniform(0.5, 3), y + rng.uniform(0.5, 3))
    cand = [(k, rng.randrange(40), *box()) for k in range(80)]
    prior = [box() for _ in range(5)]
    used = {3, 7}
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    want, chosen = {}, []
    for k, event, *b in cand:
        if event in used:
            want[k] = "used_event"
        elif any(meets(b, p) for p in prior):
            want[k] = "prior_overlap"
        elif event in {c[1] for c in chosen}:
            want[k] = "event_taken"
        elif any(meets(b, c[2:]) for c in chosen):
            want[k] = "chosen_overlap"
        elif len(chosen) >= 6:
            want[k] = "enough"
        else:
            want[k] = "chosen"
            chosen.append((k, event, *b))
    df = spark.createDataFrame(cand, "ordinal long, event long, w double, s double, e double, n double").repartition(5)
    got = selection.isolate(df, spark.createDataFrame(prior, "w double, s double, e double, n double"), spark.createDataFrame([(e,) for e in used], "event long"), 6, 2.0)
    assert {r.ordinal: r.reason for r in got.collect()} == want and len(set(want.values())) == 6


def test_median_and_nearest_of_a_chip(spark):
    rng = np.random.default_rng(19)
    grid, fine = rng.integers(0, 5, (9, 11)), rng.random((9, 11)) < 0.3
    rows = [(1, r, c, int(grid[r, c]), bool(fine[r, c])) for r in range(9) for c in range(11)] + [(2, r, c, 3, False) for r in range(3) for c in range(3)]
    px = spark.createDataFrame(rows, "chip_id long, row int, col int, v int, ok boolean")
    got = {(r.row, r.col): r for r in morphology.nearest_valid(morphology.median_filter(px, "v", 3, "m"), "v", "ok", "near").where("chip_id = 1").collect()}
    at = np.argwhere(fine)
    for r, c in np.ndindex(9, 11):
        around = sorted(grid[min(max(r + y, 0), 8), min(max(c + x, 0), 10)] for y in (-1, 0, 1) for x in (-1, 0, 1))
        assert got[r, c].m == around[4]
        near = min(map(tuple, at), key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))
        assert got[r, c].near == (grid[r, c] if fine[r, c] else grid[near])
    assert {r.near for r in morphology.nearest_valid(px, "v", "ok", "near").where("chip_id = 2").collect()} == {3}


def test_greedy_members(spark):
    rng = random.Random(20)
    truth = {k: rng.random() < 0.5 for k in range(200)}
    scores = {(m, k): min(1.0, max(0.0, truth[k] * 0.4 + 0.3 + rng.gauss(0, s))) for m, s in (("a", 0.2), ("b", 0.25), ("c", 0.6)) for k in truth}
    acc = lambda ms: sum((sum(scores[m, k] for m in ms) / len(ms) >= 0.5) == truth[k] for k in truth) / len(truth)
    want, best = [], 0.0
    while len(want) < 3:
        value, m = max((acc([*want, m]), m) for m in "abc" if m not in want)
        if value - best <= 1e-4:
            break
        want, best = [*want, m], value
    df = spark.createDataFrame([(m, k, p) for (m, k), p in scores.items()], "member string, key long, p double")
    assert selection.greedy_members(df, "member", "key", "p", spark.createDataFrame(list(truth.items()), "key long, truth boolean")) == want


def test_persistent_sources_of_a_history(spark):
    at = lambda day, hour=6: dt.datetime(2026, 9, day, hour, tzinfo=dt.timezone.utc)
    rows = [(k, 61.0, 93.0, at(1 + k), 10.0 + k % 2) for k in range(15)]  # steady, on many days
    rows += [(100 + k, 62.0, 93.0, at(1 + k), 1.0 + 99 * (k % 5 == 0)) for k in range(15)]  # of varying power
    rows += [(200 + k, 63.0, 93.0, at(10 + k % 2, k), 5.0) for k in range(12)]  # on two days
    df = spark.createDataFrame(rows, "ordinal long, latitude double, longitude double, acquired_at timestamp, frp double")
    got = points.persistent_sources(df).collect()
    assert [(r.lat, r.days) for r in got] == [(61.0, 15)]
    assert points.persistent_sources(df.where("acquired_at < '2026-09-12'")).count() == 0
