import numpy as np
from pyspark.sql import functions as F

from cinderlake.operators import graph, joins, planning, polygons


def plain_roots(ids, near):
    root = {k: k for k in ids}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {k: top(k) for k in ids}


def test_chains_by_blocks_agree_with_all_pairs(spark):
    """Dense places, strays, boxes of many sizes, and distances that are just the limit."""
    rng = np.random.default_rng(5)
    x, y = np.concatenate([rng.integers(0, 30, (150, 2)), rng.integers(0, 400, (150, 2)), 300 + rng.normal(size=(100, 2)).round()]).T
    w, h = rng.choice([0, 1, 3, 40], (2, 400), p=[0.3, 0.4, 0.27, 0.03])
    ids = [int(k) for k in rng.permutation(1000)[:400]]
    rows = [(k, float(a), float(b), float(a + c), float(b + d)) for k, a, b, c, d in zip(ids, x, y, w, h, strict=True)]
    df = spark.createDataFrame([*rows, (2000, None, 0.0, 1.0, 1.0)], "id long, w double, s double, e double, n double")
    gap = lambda a, b, lo, hi: max(a[lo] - b[hi], b[lo] - a[hi], 0.0)
    for within in (5.0, 13.0):
        near = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if np.hypot(gap(a, b, 1, 3), gap(a, b, 2, 4)) <= within]
        want = plain_roots([*ids, 2000], near)
        got = {}
        for r in planning.clusters(df, within).collect():
            got.setdefault(r.cluster, set()).add(r.id)
        assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in want if want[k] == r) for r in set(want.values()))
        point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
        shapes = df.where("w is not null").select("id", F.array(F.array(point("w", "s"), point("e", "s"), point("e", "n"), point("w", "n"))).alias("rings"))
        assert {r.id: r.root for r in polygons.polygon_clusters(shapes, within).collect()} == {k: want[k] for k in ids}


def test_dense_places_are_not_paired(spark):
    """A place of 70 000 boxes has 2 450 million pairs, and the sum of its members' hashes is no long."""
    here = spark.range(70_000).select("id", *[F.lit(v).alias(c) for c, v in (("w", 10.0), ("s", 10.0), ("e", 11.0), ("n", 11.0))])
    there = spark.createDataFrame([(70_000, 500.0, 500.0, 501.0, 501.0)], here.schema)
    found = planning.clusters(here.unionByName(there), 5.0).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [1, 70_000]
    given = []

    def near(a, b):
        given.append((a.count(), b.count()))
        return a.crossJoin(b.limit(1)).select(F.lit(0).alias("a_root"), F.lit(0).alias("b_root")).where("false")

    graph.chained(here.unionByName(there), F.col("w"), F.col("s"), 5.0, near).count()
    assert given == [(1, 70_001)]


def test_a_place_meets_polygons_once_for_all_samples(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def counted(rings, x, y):
        seen = F.udf(lambda r, a, b: met.add(1) or True, "boolean")
        return seen(rings, x, y)

    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    shape = F.array(F.array(point(0.0, 0.0), point(3.0, 0.0), point(3.0, 3.0), point(0.0, 3.0)))
    polys = spark.range(5).select(F.col("id").alias("event"), shape.alias("rings"))
    spots = spark.range(400).select(F.col("id").alias("sample"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    want = {(s, e): 1.0 for s in range(400) for e in range(5)}
    assert {(r.sample, r.event): r.share for r in polygons.covered_shares(spots, polys, 2.0).collect()} == want
    monkeypatch.setattr(polygons, "contains", counted)
    assert polygons.covered_shares(spots, polys, 2.0).count() == 2000
    assert met.value == 5


def test_pairs_of_boxes_are_dealt_to_many_tasks(spark):
    """All boxes lie in one cell: few bytes, many pairs; and of one partition none is paired."""
    boxes = spark.range(600).select("id", *[F.lit(v).alias(c) for c, v in (("w", 0.1), ("s", 0.1), ("e", 0.9), ("n", 0.9))], F.when(F.col("id") < 3, "test").otherwise("train").alias("partition"))
    tasks = joins.overlapping(boxes, boxes, 1.0).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 360_000
    assert joins.leaks(boxes, 1.0).count() == 3 * 597
