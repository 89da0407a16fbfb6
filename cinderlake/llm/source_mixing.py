"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source's target is its share, by weight, of `share` times all words; no target exceeds `most` times the
source's words, and what is above goes to the others by weight. A document's expected copies are its source's
target over the source's words. Within a source, documents are put in order of size and id, the expected copies
are summed along that order, one offset that is fixed by the source's name is added, and a document is taken
once for each integer that the sum crosses. Order by size makes the words taken follow the target closely.

Ranks come from one sort of all documents by source, size, id and row, whose partitions are ranges of that order: a source
or a size of any number of rows is spread among tasks, whatever the ids are.

Edge cases: null text has size 0; null sources are one source, last in order; null ids come first among equal
sizes; equal rows are ranked in any order, which gives the same rows; ids may be any longs; very long texts are
counted whole; a source without words takes nothing; an empty table gives an empty one; of input columns, `mix`
reads doc_id, source and text only, and `mixed` returns all as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import WORD, free, staged, with_row_id
from cinderlake.operators.numbering import numbered

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def sizes(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """stats: source, source_size, one row per source. Adds `target`.

    The sources are few by nature (a weight is set for each), so their table is ordered as a whole."""
    weighed = stats.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(most))
    whole = Window.partitionBy(F.lit(1))
    fullest = Window.partitionBy(F.lit(1)).orderBy((F.col("cap") / F.col("w")).asc(), F.asc_nulls_last("source"))
    # level: words per unit of weight if the sources before this one, and no others, are at their caps
    level = (F.sum("source_size").over(whole) * F.lit(share) - (F.sum("cap").over(fullest) - F.col("cap"))) / (F.sum("w").over(whole) - (F.sum("w").over(fullest) - F.col("w")))
    leveled = weighed.withColumn("level", level)
    # the level rises while sources fill up and falls after that, so the largest is the one that settles
    settled = F.max("level").over(whole)
    return leveled.withColumn("target", F.least(F.col("cap"), settled * F.col("w"))).select("source", "source_size", "target")


def plan(light: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """light: row (a different number in each row), doc_id, source, size. Adds source_size, target, copies and taken."""
    light = light.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    stats = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_source = targets(stats.select("source", "source_size"), weights, share, most)
    # sources are few by nature, see targets()
    before = F.sum("rows").over(Window.orderBy(F.asc_nulls_last("source"))) - F.col("rows")
    named = lambda df: df.withColumns({"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull()}).drop("source")
    by_source = staged(named(by_source).join(named(stats.select("source", before.alias("before"))), ["_s", "_n"]), "sources")
    ranked = numbered(light, F.asc_nulls_last("source"), "size", F.asc_nulls_first("doc_id"), "row", out="rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "_s")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    placed = ranked.join(by_source, ["_s", "_n"]).withColumns({"rank": F.col("rank") - F.col("before"), "_rate": rate, "_u": offset})
    copies = F.floor(F.col("rank") * F.col("_rate") + F.col("_u")) - F.floor((F.col("rank") - 1) * F.col("_rate") + F.col("_u"))
    placed = placed.withColumn("copies", F.least(copies, F.lit(int(most))).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, size, source_size, target, copies, taken) for each row of docs."""
    light = staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", sizes(F.col("text")).alias("size")), "sizes")
    return plan(light, **options).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or more)."""
    row, copies = free("_row", docs), free("_copies", docs)
    keyed = with_row_id(docs, row)
    light = staged(keyed.select(F.col(row).alias("row"), "doc_id", "source", sizes(F.col("text")).alias("size")), "sizes")
    taken = plan(light, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(copies))
    rows = keyed.join(taken, row)
    return rows.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
