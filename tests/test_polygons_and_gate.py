"""Polygons, projection and the chip gate against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from cinderlake.functions import projection
from cinderlake.operators import gate, polygons

RINGS = "array<array<struct<x:double,y:double>>>"


def star(rng, x, y, r, n, hole=False):
    angles = np.sort(np.random.default_rng(rng.randrange(1 << 30)).uniform(0, 2 * np.pi, n))
    out = [(x + r * rng.uniform(0.5, 1) * np.cos(a), y + r * rng.uniform(0.5, 1) * np.sin(a)) for a in angles]
    rings = [[(float(p), float(q)) for p, q in out]]
    if hole:
        rings.append([(x - 0.1, y - 0.1), (x + 0.1, y - 0.1), (x + 0.1, y + 0.1), (x - 0.1, y + 0.1), (x - 0.1, y - 0.1)])
    return rings


def plain_inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def test_area_and_points(spark):
    rng = random.Random(3)
    shapes = [(k, star(rng, rng.uniform(-5, 5), rng.uniform(-5, 5), 2.0, rng.randint(3, 30), k % 3 == 0)) for k in range(30)]
    shapes += [(100, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]), (101, [[(1e7, 1e7), (1e7 + 1, 1e7), (1e7 + 1, 1e7 + 1)]]), (102, [[(0.0, 0.0), (1.0, 1.0)]])]
    df = spark.createDataFrame(shapes, f"id long, rings {RINGS}")
    got = {r.id: r.a for r in df.select("id", polygons.area(F.col("rings")).alias("a")).collect()}
    shoelace = lambda r: abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]))) / 2
    assert all(abs(got[k] - shoelace(r[0]) + sum(map(shoelace, r[1:]))) < 1e-9 for k, r in shapes[:31]) and got[100] == 11.0 and got[101] == 0.5 and got[102] == 0.0
    points = [(k, rng.uniform(-8, 8), rng.uniform(-8, 8)) for k in range(150)] + [(900, 1.5, 1.5), (901, 0.5, 0.5), (902, 0.0, 0.0), (903, 4.0, 1.0)]
    met = df.crossJoin(spark.createDataFrame(points, "p long, x double, y double")).where(polygons.contains(F.col("rings"), F.col("x"), F.col("y"))).select("id", "p").collect()
    assert {(r.id, r.p) for r in met} == {(k, p) for k, r in shapes for p, x, y in points if plain_inside(r, x, y)}
    assert {(100, 901), (100, 902)} <= {(r.id, r.p) for r in met} and not {(100, 900), (100, 903)} & {(r.id, r.p) for r in met}


def plain_distance(a, b):
    if plain_inside(a, *b[0][0]) or plain_inside(b, *a[0][0]):
        return 0.0
    best = np.inf
    for r in a:
        for s in b:
            for p, q in zip(r, r[1:] + r[:1]):
                t = np.linspace(0, 1, 60)[:, None]
                line = np.array(p) + t * (np.array(q) - p)
                for u, v in zip(s, s[1:] + s[:1]):
                    d = np.array(v) - u
                    k = np.clip(((line - u) @ d) / max(d @ d, 1e-12), 0, 1)
                    best = min(best, np.linalg.norm(line - (u + k[:, None] * d), axis=1).min())
    return best


def test_chains_of_polygons(spark):
    rng = random.Random(8)
    shapes = [(k, star(rng, rng.uniform(0, 40), rng.uniform(0, 40), 1.0, rng.randint(3, 9))) for k in range(40)]
    # one inside the hole of another, too far from its edge; one inside another; two that cross; a long one
    shapes += [(50, [[(60.0, 0.0), (80.0, 0.0), (80.0, 20.0), (60.0, 20.0)], [(62.0, 2.0), (78.0, 2.0), (78.0, 18.0), (62.0, 18.0)]]), (51, [[(69.0, 9.0), (71.0, 9.0), (70.0, 11.0)]]), (52, [[(60.5, 0.5), (61.0, 0.5), (61.0, 1.0)]])]
    shapes += [(60, [[(100.0, 0.0), (110.0, 0.0), (110.0, 1.0), (100.0, 1.0)]]), (61, [[(105.0, -5.0), (106.0, -5.0), (106.0, 5.0), (105.0, 5.0)]]), (62, [[(0.0, 50.0), (120.0, 50.0), (120.0, 50.5), (0.0, 50.5)]])]
    df = spark.createDataFrame(shapes, f"id long, rings {RINGS}")
    found = {(r.a_id, r.b_id): r.distance for r in polygons.near_polygons(df, df, 2.0).where("a_id < b_id").collect()}
    want = {(i, j): plain_distance(a, b) for i, a in shapes for j, b in shapes if i < j}
    assert {p for p, d in want.items() if d <= 1.9} <= set(found) <= {p for p, d in want.items() if d <= 2.1}
    # the plain one looks at points of a line, so it may come out larger
    assert all(-1e-9 < want[p] - d < 0.2 for p, d in found.items()) and found[50, 52] == found[60, 61] == 0.0 and (50, 51) not in found
    roots = {r.id: r.root for r in polygons.polygon_clusters(df, 2.0).collect()}
    parent = {k: k for k, _ in shapes}
    for i, j in sorted(found):
        a, b = i, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    top = lambda k: k if parent[k] == k else top(parent[k])
    assert roots == {k: top(k) for k, _ in shapes}


def test_shares_inside_polygons(spark):
    shapes = [(1, [[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]]), (1, [[(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]]), (2, [[(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 30.0)], [(22.0, 22.0), (28.0, 22.0), (28.0, 28.0), (22.0, 28.0)]])]
    spots = [(s, float(x) + 0.5, float(y) + 0.5) for s, lo in ((7, 0), (8, 20)) for x in range(lo, lo + 10) for y in range(lo, lo + 10)]
    got = {(r.sample, r.event): r.share for r in polygons.covered_shares(spark.createDataFrame(spots + spots[:3], "sample long, x double, y double"), spark.createDataFrame(shapes, f"event long, rings {RINGS}"), 4.0).collect()}
    want = {(s, e): sum(any(plain_inside(r, x, y) for k, r in shapes if k == e) for t, x, y in spots if t == s) / 100 for s, e in ((7, 1), (8, 2))}
    assert got == want and got[8, 2] == 0.64


def test_projection_goes_both_ways(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-179, 179), rng.uniform(-79, 83)) for _ in range(400)] + [(3.0, 0.0), (9.0, 60.0), (-177.0, -45.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", F.floor((F.col("lon") + 180) / 6) + 1)
    at = df.withColumn("m", projection.to_metres(F.col("lon"), F.col("lat"), F.col("zone")))
    back = at.withColumn("d", projection.to_degrees(F.col("m.x"), F.col("m.y"), F.col("zone"), F.col("lat") < 0)).collect()
    # a millionth of a millimetre is 1e-14 degrees of the earth's radius; a tenth of a millimetre is asked for
    assert max(abs(r.d.lon - r.lon) * np.cos(np.radians(r.lat)) for r in back) < 1e-9 and max(abs(r.d.lat - r.lat) for r in back) < 1e-9
    own = {(r.lon, r.lat): r.m for r in back}
    # on a meridian the northing is the scaled arc, by integration; on the equator it is 0 and the scale is 0.9996
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    t = np.linspace(0, np.radians(60), 200_001)
    arc = np.trapezoid(projection.AXIS * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5, t)
    assert abs(own[9.0, 60.0].y - 0.9996 * arc) < 1e-4 and abs(own[9.0, 60.0].x - 500_000) < 1e-6 and abs(own[3.0, 0.0].y) < 1e-9
    # it keeps angles: a step north and a step east are at right angles and of one length
    near = spark.createDataFrame([(1.2, 52.0), (1.2, 52.00001), (1.20001, 52.0)], "lon double, lat double").select(projection.to_metres(F.col("lon"), F.col("lat"), F.lit(31)).alias("m")).collect()
    o, north, east = (np.array([r.m.x, r.m.y]) for r in near)
    n, e = north - o, east - o
    phi = np.radians(52.0)
    scale = [np.linalg.norm(n) / (1e-5 * np.pi / 180 * projection.AXIS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5), np.linalg.norm(e) / (1e-5 * np.pi / 180 * projection.AXIS * np.cos(phi) / np.sqrt(1 - e2 * np.sin(phi) ** 2))]
    assert abs(n @ e) / (n @ n) < 1e-4 and abs(scale[0] - scale[1]) < 1e-5 and 0.9996 <= scale[0] < 1.001


def test_novelty_and_information(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 100
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(99, [1.0])], "k long, v array<double>")
    ref = df.where("k < 40")
    got = {r.k: r.novelty for r in gate.novelty(df, ref).collect()}
    cov = np.cov(x[:40].T)
    whole = cov + 1e-3 * np.eye(5) * np.trace(cov) / 5
    want = [np.sqrt((r - x[:40].mean(0)) @ np.linalg.solve(whole, r - x[:40].mean(0))) for r in x]
    assert all(abs(got[k] - want[k]) < 1e-8 for k in range(60)) and got[99] is None
    assert {r.novelty for r in gate.novelty(df, ref.limit(1)).collect()} == {None} == {r.novelty for r in gate.novelty(df, ref.where("k < 0")).collect()}
    p = rng.uniform(size=(2, 50, 3))
    p[0, :4, 0] = [0, 1, 0, 1]
    px = spark.createDataFrame([(c, bool(i % 3), *map(float, p[c, i]), bool(p[c, i, 0] > 0.5)) for c in range(2) for i in range(50)] + [(5, False, 0.1, 0.2, 0.3, False)], "chip_id long, valid boolean, a double, b double, m double, hit boolean")
    rows = {r.chip_id: r for r in gate.disagreement(px, "a", "b", ["a", "b", "m"], "hit").collect()}
    h = lambda q: -(np.clip(q, 1e-6, 1 - 1e-6) * np.log(np.clip(q, 1e-6, 1 - 1e-6)) + (1 - np.clip(q, 1e-6, 1 - 1e-6)) * np.log(1 - np.clip(q, 1e-6, 1 - 1e-6)))
    for c in range(2):
        d, ok, hit = np.abs(p[c, :, 0] - p[c, :, 1]), np.arange(50) % 3 > 0, p[c, :, 0] > 0.5
        mi = h(p[c].mean(1)) - h(p[c]).mean(1)
        want = [d[ok].mean(), (d > 0.3)[ok].mean(), np.percentile(d[ok], 95), ((d > 0.3) & hit).sum() / max((d > 0.3).sum(), 1), mi[ok].mean(), mi[hit].mean()]
        assert np.allclose([rows[c][k] for k in ("mean_gap", "high_share", "gap_95", "high_marked", "information", "information_marked")], want)
    assert rows[5].mean_gap == rows[5].information == rows[5].information_marked == 0.0
    s = {r.chip_id: r.v for r in gate.summaries(px, ["a", "b"], least=10).collect()}
    ok = np.arange(50) % 3 > 0
    assert np.allclose(s[0], [*np.median(p[0][ok][:, :2], 0), *(np.percentile(p[0][ok][:, :2], 90, 0) - np.percentile(p[0][ok][:, :2], 10, 0))]) and np.allclose(s[5], [0.1, 0.2, 0, 0])
