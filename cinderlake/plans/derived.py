"""Detections, pixels, counts and scenes derived from the shared tables, by integer arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions import indices

DETECTIONS = """
SELECT event_id AS ordinal,
  (51000000 + (user_id % 20) * 500000 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE (event_id % 7) * 12000 END) / CAST(1000000 AS DOUBLE) AS latitude,
  (82000000 + (user_id % 25) * 1000000 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE (event_id % 5) * 20000 END) / CAST(1000000 AS DOUBLE) AS longitude,
  CAST(ts AS TIMESTAMP) AS acquired_at,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 6 = 0 THEN CAST(100 AS DOUBLE) + value * CAST(0.1 AS DOUBLE) ELSE value END AS frp,
  CASE WHEN user_id % 4 = 0 THEN 'MODIS_NRT' WHEN user_id % 4 = 1 THEN 'VIIRS_SNPP_NRT' ELSE 'VIIRS_NOAA20_NRT' END AS sensor,
  CASE WHEN user_id % 4 = 0 THEN CAST(event_id % 101 AS STRING) WHEN event_id % 3 = 0 THEN 'l' WHEN event_id % 3 = 1 THEN ' N' ELSE 'h' END AS confidence,
  CASE WHEN event_id % 11 = 0 THEN '2.0' ELSE '2.0NRT' END AS version,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS fire_type
FROM {events}
"""

COUNTS = """
SELECT l_orderkey * 10 + l_linenumber AS sample_id, o_custkey % 50 AS group_id,
  CASE WHEN l_returnflag = 'A' THEN 'first' ELSE 'second' END AS model,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS tp, CAST(l_partkey % 13 AS BIGINT) AS fp, CAST(l_suppkey % 11 AS BIGINT) AS fn
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

SCENES = """
SELECT p_partkey AS ordinal, CONCAT('T', CAST(p_partkey % 40 AS STRING)) AS tile, CAST(p_size * 2 AS DOUBLE) AS cloud,
  CAST(p_partkey * 7919 % 365 AS INT) AS day_no, CAST((p_partkey * 31 % 100) AS DOUBLE) / 100 AS valid
FROM {part}
"""

BOXES = """
SELECT o_orderkey AS id, CAST(o_custkey * 37 % 300 AS DOUBLE) / 10 AS w, CAST(o_orderkey * 61 % 300 AS DOUBLE) / 10 AS s,
  CAST(o_custkey * 37 % 300 + 5 + o_orderkey % 9 AS DOUBLE) / 10 AS e, CAST(o_orderkey * 61 % 300 + 4 + o_custkey % 7 AS DOUBLE) / 10 AS n,
  CASE WHEN o_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS partition
FROM {orders}
"""

# the pixels' form in SQL: four vectors are a tile of 8 x 8, 64 tiles a chip of 64 x 64; in Spark the vectors are put side by
# side before they are spread. Truth shares a part of what is measured and has a part of its own
PIXELS = """
SELECT chip_id, tile, label, CAST(floor(k / 8) * 8 + floor(i / 8) AS INT) AS r, CAST(k % 8 * 8 + i % 8 AS INT) AS c, CAST((floor(k / 8) * 8 + floor(i / 8)) * 64 + k % 8 * 8 + i % 8 + 1 AS BIGINT) AS pos,
  a, b, u, v, (i + k) % 7 <> 0 AS valid, (a - b) * 2 AS dnbr, (a - b) * 1.4::DOUBLE + (u - v) * 0.8::DOUBLE AS tnbr
FROM (SELECT CAST(floor(x.vec_id / 256) AS BIGINT) AS chip_id, CAST(floor(x.vec_id / 4) AS BIGINT) AS tile, CAST(floor(x.vec_id % 256 / 4) AS BIGINT) AS k, x.label, t.i,
        1::DOUBLE + x.embedding[t.i + 1]::DOUBLE AS a, 1::DOUBLE + y.embedding[t.i + 1]::DOUBLE AS b, 1::DOUBLE + z.embedding[t.i + 1]::DOUBLE AS u, 1::DOUBLE + w.embedding[t.i + 1]::DOUBLE AS v
      FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 AND x.vec_id % 4 = 0 JOIN embeddings z ON z.vec_id = x.vec_id + 2 JOIN embeddings w ON w.vec_id = x.vec_id + 3, range(64) t(i))
"""
#: Pixels in a row of a chip.
SIDE = 64


def duck(text: str) -> str:
    """A derivation as DuckDB reads it, over views of the tables' names."""
    return text.format(events="events", lineitem="lineitem", orders="orders", part="part")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def detections(self) -> DataFrame:
        return self.spark.sql(DETECTIONS, events=self.read("events"))

    def counts(self) -> DataFrame:
        return self.spark.sql(COUNTS, lineitem=self.read("lineitem"), orders=self.read("orders"))

    def scenes(self) -> DataFrame:
        return self.spark.sql(SCENES, part=self.read("part")).withColumn("taken", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_no")))

    def boxes(self) -> DataFrame:
        return self.spark.sql(BOXES, orders=self.read("orders"))

    def pixels(self) -> DataFrame:
        """chip_id, tile, label, row, col, pos (from 1), a, b, u, v, valid, dnbr, severity, truth, pred."""
        vectors = self.read("embeddings").select("vec_id", "label", "embedding")
        of = lambda k, name: vectors.where(F.col("vec_id") % 4 == k).select(F.floor(F.col("vec_id") / 4).alias("tile"), F.col("embedding").alias(name))
        first = vectors.where(F.col("vec_id") % 4 == 0).select(F.floor(F.col("vec_id") / 4).alias("tile"), "label", F.col("embedding").alias("a"))
        four = first.join(of(1, "b"), "tile").join(of(2, "u"), "tile").join(of(3, "v"), "tile")
        spread = four.select("tile", "label", F.posexplode(F.arrays_zip("a", "b", "u", "v")).alias("i", "x"))
        spread = spread.withColumns({"chip_id": F.floor(F.col("tile") / SIDE), "k": F.col("tile") % SIDE})
        row, col = F.floor(F.col("k") / 8) * 8 + F.floor(F.col("i") / 8), F.col("k") % 8 * 8 + F.col("i") % 8
        px = spread.select(
            "chip_id", "tile", "label", row.cast("int").alias("row"), col.cast("int").alias("col"), (row * SIDE + col + 1).cast("long").alias("pos"),
            *[(F.lit(1.0) + F.col(f"x.{n}").cast("double")).alias(n) for n in "abuv"], ((F.col("i") + F.col("k")) % 7 != 0).alias("valid"),
        ).withColumn("dnbr", (F.col("a") - F.col("b")) * 2)
        guess = F.col("dnbr") * 1.25 - 0.05
        truth = (F.col("a") - F.col("b")) * 1.4 + (F.col("u") - F.col("v")) * 0.8
        return px.withColumns({"severity": indices.severity(F.col("dnbr")), "truth": indices.severity(truth), "pred": indices.severity(guess)})
