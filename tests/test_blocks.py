"""Pairs by blocks: all of them, once each, from few candidates, and in an order that files keep small."""

import numpy as np
from pyspark.sql import functions as F

from cinderlake.operators import joins

BOX = "w double, s double, e double, n double"


def tenths(rng, n, first, side):
    w, s = rng.integers(0, side * 10, n) / 10, rng.integers(0, side * 10, n) / 10
    ids = first + rng.permutation(n)
    return [(int(k), *map(float, x)) for k, *x in zip(ids, w, s, w + rng.integers(5, 14, n) / 10, s + rng.integers(4, 11, n) / 10, strict=True)]


def test_files_of_overlapping_boxes_are_small(spark, tmp_path):
    """Rows by rows a pair took 1.8 bytes, so that pairs of 1 GB of tables filled the disk."""
    rng = np.random.default_rng(8)
    a, b = (spark.createDataFrame(tenths(rng, 8000, first, 4), f"id long, {BOX}") for first in (0, 10_000))
    joins.overlapping(a, b, 2.0).write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n > 5_000_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.9 * n


def test_leaks_are_all_pairs_of_different_partitions(spark):
    """Blocks that are no multiple of eight, equal and very large boxes, and three partitions."""
    rng = np.random.default_rng(9)
    rows = tenths(rng, 700, 0, 3) + [(700, -50.0, -50.0, 50.0, 50.0), (701, 0.0, 0.0, 6.0, 6.0), (702, 1.0, 1.0, 1.0, 1.0), (703, None, 0.0, 1.0, 1.0)]
    rows = [(*r, (None, "test", "train", "val")[int(rng.integers(0, 12)) and int(rng.integers(1, 4))]) for r in rows]
    inside = lambda p, q: p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
    whole = [r for r in rows if None not in r]
    want = sorted((p[0], q[0], p[5], q[5]) for p in whole for q in whole if p[0] < q[0] and p[5] != q[5] and inside(p, q))
    got = joins.leaks(spark.createDataFrame(rows, f"id long, {BOX}, partition string"), 2.0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20_000


def test_leaks_compare_each_pair_once(spark, monkeypatch):
    """Of 500 boxes and 100 of another partition in one cell, 50 000 pairs are looked at, of all 360 000."""
    met = []
    pairs = joins.blocks.pairs
    monkeypatch.setattr(joins.blocks, "pairs", lambda blocks, *rest: met.append(blocks) or pairs(blocks, *rest))
    boxes = spark.range(600).select("id", *[F.lit(v).alias(c) for c, v in (("w", 0.1), ("s", 0.1), ("e", 0.9), ("n", 0.9))], F.when(F.col("id") % 6 == 0, "test").otherwise("train").alias("partition"))
    assert joins.leaks(boxes, 1.0).count() == 50_000
    assert sum(b.agg(F.sum(F.length("a_id") * F.length("b_id") / 64)).first()[0] for b in met) == 50_000
