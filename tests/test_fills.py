"""Fills along an order whatever a key's share of the rows, and small rules of choice and coverage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cinderlake.functions import dates
from cinderlake.operators import evaluation, joins, raster, selection
from cinderlake.operators.numbering import filled
from cinderlake.sources import store


@pytest.mark.parametrize("hot", [True, False])
def test_values_are_carried_over_partitions(spark, hot):
    rng = random.Random(2)
    rows = [(k, None if k % 11 == 0 else 1 if hot and k % 3 else rng.randrange(30), rng.randrange(500), rng.randrange(100) if rng.random() < (0.02 if hot else 0.3) else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, key int, t int, v int").repartition(9)
    got = {r.id: r.out for r in filled(df, ["key"], [F.col("t"), F.col("id")], "v", "out").collect()}
    want, last = {}, {}
    for k, key, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        last[key] = v if v is not None else last.get(key)
        want[k] = last[key]
    assert got == want
    assert filled(df.where("id < 0"), ["key"], [F.col("t")], "v", "out").count() == 0


def test_as_of_joins_with_a_hot_key(spark):
    rng = random.Random(4)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(4000))
    left = [(k, "hot" if k % 3 else f"k{k % 7}", at()) for k in range(600)]
    right = [(k, "hot" if k % 3 else f"k{k % 9}", at()) for k in range(300)]
    l, r = spark.createDataFrame(left, "id long, key string, at timestamp").repartition(5), spark.createDataFrame(right, "other long, key string, other_at timestamp").repartition(5)
    nxt = {x.id: x.next for x in joins.first_after(l, r, ["key"], "at", "other_at").collect()}
    assert nxt == {k: min((b for _, q, b in right if q == key and b >= a), default=None) for k, key, a in left}
    near = {x.id: (x.other, x.gap_us) for x in joins.nearest_in_time(l, r, ["key"], "id", "at", "other", "other_at").collect()}
    want = {}
    for k, key, a in left:
        found = [(abs((a - b).total_seconds()) * 1e6, o) for o, q, b in right if q == key]
        if found:
            want[k] = (min(found)[1], int(min(found)[0]))
    assert near == want


def test_the_anchor_names_the_main_component(spark):
    rows = [(1, 0, c, c not in (4, 8, 9), c in (6,)) for c in range(14)] + [(2, 0, c, c != 4, False) for c in range(7)]
    px = spark.createDataFrame(rows, "chip_id long, row int, col int, m boolean, a boolean")
    told = lambda anchor: {(r.chip_id, r.component): (r.main, r.distance) for r in raster.component_distances(px, "m", anchor=anchor).collect()}
    assert told(None) == {(1, 1): (True, 0.0), (1, 2): (False, 2.0), (1, 3): (False, 7.0), (2, 1): (True, 0.0), (2, 2): (False, 2.0)}
    assert told("a") == {(1, 1): (False, 2.0), (1, 2): (True, 0.0), (1, 3): (False, 3.0), (2, 1): (True, 0.0), (2, 2): (False, 2.0)}
    kept = raster.drop_far(px, "m", 2.0, anchor="a").where("m and chip_id = 1").collect()
    assert {r.col for r in kept} == {0, 1, 2, 3, 5, 6, 7}


def test_half_of_the_hardest(spark):
    rows = [(g, k, float(k * 37 % 50)) for g, n in ((1, 5), (2, 50)) for k in range(n)]
    got = selection.half_hard(spark.createDataFrame(rows, "g int, k int, score double"), "g", "score", "k", 9, "salt").collect()
    assert sum(r.g == 1 for r in got) == 5 and sum(r.g == 2 for r in got) == 9
    own = {r.k for r in got if r.g == 2}
    assert set(sorted((k for g, k, _ in rows if g == 2), key=lambda k: -(k * 37 % 50))[:4]) <= own


def test_coverage_counts_each_detection_once(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    journal = spark.createDataFrame([("A", day(1), day(3), "ok"), ("A", day(2), day(4), "ok"), ("A", day(3), day(5), "failed"), ("B", day(1), day(9), "ok"), ("A", day(8), day(9), "ok")], "source string, window_start timestamp, window_end timestamp, status string")
    found = spark.createDataFrame([(1, "A", 1.0, 2.0, day(2)), (2, "A", 1.0, 2.0, day(2)), (3, "A", 1.0, 2.0, day(4)), (4, "A", 1.0, 2.0, day(6)), (5, "B", 1.0, 2.0, day(2))], "ordinal long, sensor string, latitude double, longitude double, acquired_at timestamp")
    row = store.observed(journal, found, "A", F.lit(day(2)), F.lit(day(5))).first()
    assert tuple(row) == (True, 2, 2, 1)
    assert tuple(store.observed(journal, found, "C", F.lit(day(2)), F.lit(day(5))).first()) == (False, 0, 0, 0)


def test_products_and_codes(spark):
    d = spark.createDataFrame([("2018-12-31",), ("2019-01-01",), ("2025-01-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [r[0] for r in d.select(dates.product_covers(F.col("d"), "FireCCIS311")).collect()] == [False, True, False, None]
    with pytest.raises(ValueError, match="unknown product"):
        dates.product_covers(F.col("d"), "other")
    with pytest.raises(ValueError, match="raw code"):
        evaluation.attribute(spark.createDataFrame([(1, 0, 4)], "raw int, truth int, pred int"))
