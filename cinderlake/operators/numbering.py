"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.staging import staged


def numbered(rows: DataFrame, *order: Column | str, out: str = "number") -> DataFrame:
    """rows with their number from 1 in this order, which should be total.

    Spark's sort deals ranges of the order to partitions; the sorted rows are staged with their place in their
    partition, and each partition's first number is the sum of the rows before it. Only one row per partition
    is numbered in one task and sent to the others."""
    place = f"_{out}_at"
    ranged = staged(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "sorted")
    # an increasing id has the partition in its upper 31 bits and the place in the lower 33
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(counts.select("_part", before.alias("_before")))  # one row per partition
    return ranged.withColumn("_part", part).join(first, "_part").withColumn(out, (F.col("_before") + at + 1).cast("long")).drop("_part", "_before", place)


def filled(rows: DataFrame, key: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """rows with the last value that isn't null, up to the row itself, among those of its key in this order.

    A key's rows may be any share of the table: Spark's sort deals ranges of key and order to partitions, each fills its own
    part of a key, and what a part begins with comes from the parts before it. Only keys that lie in several partitions, two
    for each partition at most, are looked at for that. A null key is a key."""
    place = f"_{out}_at"
    ranged = staged(rows.orderBy(*key, *order).withColumn(place, F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright(place, 33))
    parts = ranged.groupBy("_part", *key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(place))).alias("_end"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key])
    several = parts.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    spread = staged(parts.alias("p").join(F.broadcast(several.alias("s")), same("p", "s"), "left_semi"), "ends")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = spread.withColumn("_carried", before).where("_carried is not null").drop("_end")
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", *key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    met = ranged.withColumn("_own", own).alias("r").join(F.broadcast(carried.alias("c")), same("r", "c") & (F.col("r._part") == F.col("c._part")), "left")
    return met.select(*[F.col(f"r.`{c}`") for c in rows.columns], F.coalesce("r._own", "c._carried").alias(out))
