"""Copies and pairs of near detections."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from cinderlake.operators import points

SCHEMA = "ordinal long, latitude double, longitude double, acquired_at timestamp"


def spread(n=600):
    rng = random.Random(4)
    start = dt.datetime(1969, 12, 28, tzinfo=dt.timezone.utc)
    # around the equator, the date line, a pole, and steps of the radius and the gap exactly
    centres = [(0.0, 0.0), (-0.01, 179.99), (55.0, -0.01), (89.98, 10.0), (-65.0, -179.99)]
    rows = [(k, centres[k % 5][0] + rng.uniform(-0.06, 0.06) * (k % 5 != 3 or -0.3), centres[k % 5][1] + rng.uniform(-0.1, 0.1) * (k % 5 != 3 or 300), start + dt.timedelta(hours=rng.uniform(0, 300))) for k in range(n)]
    return rows + [(n + k, k % 4 * 3000 / 111_320, 20.0, start + dt.timedelta(hours=48 * (k // 4))) for k in range(24)]


def test_near_pairs_are_all_pairs_within_reach(spark):
    rows = spread()

    def near(a, b):
        x = (a[2] - b[2]) * 111_320.0 * math.cos(math.radians((a[1] + b[1]) / 2))
        return abs(a[3] - b[3]) <= dt.timedelta(hours=48) and math.hypot(x, (a[1] - b[1]) * 111_320.0) <= 3000

    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b))
    assert sorted(map(tuple, points.near_pairs(spark.createDataFrame(rows, SCHEMA), 3000.0, 48.0).collect())) == want and len(want) > 500


def test_a_detection_is_sent_to_few_cells(spark):
    """Spread evenly, each goes to its own cell and to the later ones within reach: 23 before."""
    rng = random.Random(5)
    start = dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc)
    rows = [(k, rng.uniform(50, 60), rng.uniform(80, 100), start + dt.timedelta(hours=rng.uniform(0, 4000))) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = df.select("ordinal", "latitude", "longitude", F.unix_micros("acquired_at").alias("us"))
    sent = points._sent(plain, ["ordinal"], 3000.0, 48 * 3_600_000_000, "us", "us")[0].count()
    assert 2000 < sent < 6 * 2000


def test_files_of_near_pairs_are_small(spark, tmp_path):
    """Ids that don't follow time: pairs one by one took 1.5 bytes each."""
    rng = random.Random(6)
    start = dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc)
    rows = [(k, 55.0 + k % 2 * 0.012, 90.0 + k % 3 * 0.02, start + dt.timedelta(hours=rng.uniform(0, 200))) for k in range(6000)]
    points.near_pairs(spark.createDataFrame(rows, SCHEMA), 3000.0, 48.0).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    n = pairs.count()
    assert n == pairs.where("u < v").distinct().count() > 5_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.9 * n
