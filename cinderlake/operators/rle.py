"""Run-length encoding of masks ("start length ..." from 1, by rows) and checks of submitted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode(pixels: DataFrame, key: list[str], on: str, position: str = "pos") -> DataFrame:
    """Rows (key, rle): runs of the positions where `on` holds; keys without any have the empty text."""
    w = Window.partitionBy(*key).orderBy(position)
    runs = pixels.where(on).withColumn("_g", F.col(position) - F.row_number().over(w)).groupBy(*key, "_g").agg(F.min(position).alias("s"), F.count("*").alias("n"))
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda r: F.array(r["s"].cast("string"), r["n"].cast("string")))), " ")
    found = runs.groupBy(*key).agg(text.alias("rle"))
    return pixels.select(*key).distinct().join(found, key, "left").fillna("", ["rle"])


def runs(rle: Column) -> Column:
    """array<struct<start, length>> of a text; odd numbers or values below 1 raise."""
    numbers = F.transform(F.filter(F.split(F.trim(rle), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("long"))
    fine = (F.size(numbers) % 2 == 0) & F.forall(numbers, lambda x: F.coalesce(x >= 1, F.lit(False)))
    pairs = F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, i * 2).alias("start"), F.get(numbers, i * 2 + 1).alias("length")))
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return F.when(F.size(numbers) == 0, empty).when(fine, pairs).otherwise(F.raise_error(F.concat(F.lit("bad runs: "), rle)).cast("array<struct<start:bigint,length:bigint>>"))


def decode(rows: DataFrame, key: list[str], rle: str = "rle") -> DataFrame:
    """Rows (key, pos), one per pixel of a run."""
    spread = rows.select(*key, F.explode(runs(F.col(rle))).alias("r"))
    return spread.select(*key, F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.length") - 1)).alias("pos"))


def faults(submitted: DataFrame, template: DataFrame, size: int) -> DataFrame:
    """Rows (chip_id, class_id, fault): duplicates, pairs that are extra or missing, null texts, bad runs, runs
    beyond the chip, and pixels that two classes of a chip claim."""
    key = ["chip_id", "class_id"]
    tell = lambda df, what: df.select(*key, F.lit(what).alias("fault"))
    twice = submitted.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    numbers = F.filter(F.split(F.trim("rle"), r"\s+"), lambda x: x != "")
    fine = (F.size(numbers) % 2 == 0) & F.forall(numbers, lambda x: F.coalesce(x.try_cast("long") >= 1, F.lit(False)))
    good = submitted.where(F.col("rle").isNotNull() & fine)
    spread = good.select(*key, F.explode(runs(F.col("rle"))).alias("r")).select(*key, F.col("r.start").alias("a"), (F.col("r.start") + F.col("r.length") - 1).alias("z"))
    # runs of a chip in order of their start: one that starts before the largest end so far of another class overlaps
    w = Window.partitionBy("chip_id").orderBy("a", "z", "class_id").rowsBetween(Window.unboundedPreceding, -1)
    crossed = spread.withColumn("before", F.max("z").over(w)).where("a <= before")
    return (
        tell(twice, "duplicate")
        .unionByName(tell(submitted.join(template, key, "left_anti"), "extra"))
        .unionByName(tell(template.join(submitted, key, "left_anti"), "missing"))
        .unionByName(tell(submitted.where("rle is null"), "null"))
        .unionByName(tell(submitted.where(F.col("rle").isNotNull() & ~fine), "bad_runs"))
        .unionByName(tell(spread.where(F.col("z") > size), "out_of_chip"))
        .unionByName(tell(crossed, "overlap"))
        .distinct()
    )
