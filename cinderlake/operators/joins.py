"""Joins by range, by time and by footprint, as equal keys with a condition on what meets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions.dates import doy_gap
from cinderlake.operators import blocks
from cinderlake.operators.numbering import filled


def select_pairs(scenes: DataFrame, fire_start: Column, fire_end: Column, gap_days: int = 30, probed: int = 8, least_valid: float = 0.8) -> DataFrame:
    """The best (before, after) scenes of each tile.

    Of a tile's scenes after the fire, the first `probed` by cloud are looked at, and those of enough valid pixels
    kept; each takes, of the scenes before that fit its day of the year, again the first `probed` by cloud, the
    first of enough valid pixels. The pair of largest validity wins; of equal ones the earlier."""
    by_cloud = lambda *p: F.row_number().over(Window.partitionBy(*p).orderBy("cloud", "ordinal"))
    after = scenes.where(F.col("taken") > fire_end).withColumn("rank", by_cloud("tile")).where((F.col("rank") <= probed) & (F.col("valid") >= least_valid))
    after = after.select("tile", F.col("ordinal").alias("after_id"), F.col("taken").alias("after_taken"), F.col("valid").alias("after_valid"), F.col("rank").alias("after_rank"))
    before = scenes.where(F.col("taken") < fire_start)
    met = before.join(after, "tile").where(doy_gap(F.col("taken"), F.col("after_taken")) <= gap_days)
    met = met.withColumn("rank", by_cloud("tile", "after_id")).where((F.col("rank") <= probed) & (F.col("valid") >= least_valid))
    first = F.row_number().over(Window.partitionBy("tile", "after_id").orderBy("rank"))
    pairs = met.withColumn("_k", first).where("_k = 1").select("tile", F.col("ordinal").alias("before_id"), "after_id", (F.col("valid") + F.col("after_valid")).alias("score"), "after_rank")
    best = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("score"), "after_rank"))
    return pairs.withColumn("_k", best).where("_k = 1").drop("_k")


def best_pair(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "tile", "after_rank").limit(1)


def overlapping(a: DataFrame, b: DataFrame, cell: float, kept: tuple[str, ...] = (), apart: str | None = None, ordered: bool = False) -> DataFrame:
    """Pairs (a_id, b_id) of boxes (id, w, s, e, n) whose insides meet; touching edges don't.

    Pairs keep the named columns of both, as a_ and b_; with `apart`, one of these, only boxes that differ in it are paired.
    With `ordered`, for a and b of the same boxes and some `apart`, each pair is told once, the smaller id first.

    Grids of cells twice as wide each lie above each other. A box belongs to the first whose cells are as wide as the box, and
    reaches four cells of it at most, however large it is. It is also listed in the coarser grids that some box of the other
    side belongs to, so that two boxes meet in the grid of the larger one, and only those of a common cell. Boxes that lack
    an edge meet none."""
    width = lambda level: F.pow(F.lit(2.0), level) * cell

    def leveled(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("w", "s", "e", "n", *kept)])
        extent = F.greatest(F.col(f"{p}_e") - F.col(f"{p}_w"), F.col(f"{p}_n") - F.col(f"{p}_s"))
        level = F.when(extent <= cell, F.lit(0)).otherwise(F.least(F.ceil(F.log2(extent / cell)), F.lit(60)).cast("int"))
        return named.where(" and ".join(f"{p}_{c} is not null" for c in "wsen")).withColumn(f"{p}_level", level)

    def keyed(df: DataFrame, p: str, level: Column) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width(F.col("level"))), F.floor(F.col(hi) / width(F.col("level")))))
        return df.withColumn("level", level).withColumn("x", span(f"{p}_w", f"{p}_e")).withColumn("y", span(f"{p}_s", f"{p}_n"))

    boxes = {p: leveled(df, p) for p, df in (("a", a), ("b", b))}
    # some tens of levels at most
    used = {p: sorted(r[0] for r in df.select(f"{p}_level").distinct().collect()) for p, df in boxes.items()}

    def listed(p: str, others: list[int], strictly: bool) -> DataFrame:
        """Rows of the grids that the other side's boxes belong to, from the box's own grid up."""
        own = F.col(f"{p}_level")
        above = F.filter(F.lit(others), lambda k: k > own if strictly else k >= own)
        return keyed(boxes[p], p, F.explode(above))

    sides = [(keyed(boxes["a"], "a", F.col("a_level")), listed("b", used["a"], False))] if used["a"] and used["b"] else []
    # boxes of b that are larger than those of a
    if used["a"] and used["b"] and used["a"][0] < used["b"][-1]:
        sides.append((listed("a", used["b"], True), keyed(boxes["b"], "b", F.col("b_level"))))
    told = [f"{p}_{c}" for c in ("id", *kept) for p in "ab"]
    if not sides:
        return boxes["a"].where("false").join(boxes["b"].where("false"), F.lit(True)).select(*told)
    kinds = [(boxes[p].schema[f"{p}_{c}"].dataType.simpleString(), "bigint" if c == "id" else "double") for p in "ab" for c in ("id", "w", "s", "e", "n")]
    if set(kept) <= {apart} and all(x == y for x, y in kinds) and all(boxes[p].schema[f"{p}_{c}"].dataType.simpleString() == "string" for p in "ab" for c in kept):
        found = [_met_by_blocks(a, b, width, apart if kept else None, ordered) for a, b in sides]
    else:
        found = [_met_by_rows(a, b, width, apart, ordered) for a, b in sides]
    return reduce(DataFrame.unionByName, [m.select(*told) for m in found])


def _met_by_rows(a: DataFrame, b: DataFrame, width: Callable[[Column], Column], apart: str | None, ordered: bool) -> DataFrame:
    """Rows of boxes of a common cell that meet, with all of their columns."""
    # pairs are many more than boxes, so tasks are dealt out by their number, not by the size of what they read; a cell's
    # rows of a are dealt to SALTS tasks, each of which has its rows of b
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * a.sparkSession.sparkContext.defaultParallelism)
    key = ["level", "x", "y", "salt"]
    left = a.withColumn("salt", F.pmod(F.xxhash64("a_id"), F.lit(blocks.SALTS)).cast("int"))
    right = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(blocks.SALTS - 1))))
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key)
    inside = (F.col("a_w") < F.col("b_e")) & (F.col("b_w") < F.col("a_e")) & (F.col("a_s") < F.col("b_n")) & (F.col("b_s") < F.col("a_n"))
    # two boxes may share several cells; the cell of the lower left corner of their common part tells of them once
    at = lambda p, q: F.floor(F.greatest(p, q) / width(F.col("level")))
    corner = (F.col("x") == at("a_w", "b_w")) & (F.col("y") == at("a_s", "b_s"))
    differ = F.lit(True) if apart is None else F.col(f"a_{apart}") != F.col(f"b_{apart}")
    return met.where(inside & corner & differ & (F.col("a_id") < F.col("b_id") if ordered else F.lit(True)))


def _insides_meet(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Which boxes of a (rows) meet those of b; equal boxes lie together and are compared once."""
    first, run = blocks.rows_alike(*[a[c] for c in "wsen"])
    w, s, e, n = (a[c][first, None] for c in "wsen")
    met = w < b["e"]
    met &= b["w"] < e
    met &= s < b["n"]
    met &= b["s"] < n
    return met[run] if len(first) < len(run) else met


def _met_by_blocks(a: DataFrame, b: DataFrame, width: Callable[[Column], Column], apart: str | None, ordered: bool) -> DataFrame:
    """Ids of boxes of a common cell that meet, by blocks of boxes; with what they are apart in."""
    columns = {"id": "bigint", "w": "double", "s": "double", "e": "double", "n": "double"}

    def side(df: DataFrame, p: str, most: int) -> DataFrame:
        part = lambda c: F.floor(F.col(f"{p}_{c}") / width(F.col("level")))
        # boxes of like corners lie together: an eighth of a cell each
        eighth = lambda c, k: F.floor((F.col(f"{p}_{c}") / width(F.col("level")) - F.col(k)) * 8) + 8
        lot = ((eighth("w", "x") * 32 + eighth("s", "y")) * 32 + eighth("e", "x")) * 32 + eighth("n", "y")
        # two boxes may share several cells; that of the lower left corner of their common part tells of them once, which is
        # where one of them begins from the left, and one from below
        rows = df.select("level", "x", "y", (part("w") == F.col("x")).alias(f"{p}_left"), (part("s") == F.col("y")).alias(f"{p}_low"), lot.alias("lot"), *[F.col(f"{p}_{c}").alias(c) for c in columns], *([f"{p}_{apart}"] if apart else []))
        key = ["level", "x", "y", f"{p}_left", f"{p}_low", *([f"{p}_{apart}"] if apart else [])]
        # where the smaller id comes first, like ids lie together too: most eights are of smaller ids than a box's, or of larger
        return blocks.packed(rows, p, key, ["lot", "id"] if ordered else ["lot", "w", "s", "e", "n", "id"], list(columns), most)

    c = F.col
    inside = (c("a_w_low") < c("b_e_high")) & (c("b_w_low") < c("a_e_high")) & (c("a_s_low") < c("b_n_high")) & (c("b_s_low") < c("a_n_high"))
    corner = (c("a_left") | c("b_left")) & (c("a_low") | c("b_low"))
    # an ordered pair is met once, whichever of its ids is the smaller
    differ = F.lit(True) if apart is None else c(f"a_{apart}") < c(f"b_{apart}") if ordered else c(f"a_{apart}") != c(f"b_{apart}")
    met = blocks.joined(side(a, "a", blocks.MOST_A), side(b, "b", blocks.MOST_B), ["level", "x", "y"], inside & corner & differ)
    return blocks.pairs(met, columns, _insides_meet, (apart,) if apart else (), ordered)


def leaks(samples: DataFrame, cell: float) -> DataFrame:
    """Pairs of samples of different partitions whose boxes overlap."""
    pairs = overlapping(samples, samples, cell, ("partition",), "partition", ordered=True)
    return pairs.select("a_id", "b_id", F.col("a_partition").alias("a_part"), F.col("b_partition").alias("b_part"))


def without_bad_groups(rows: DataFrame, bad: DataFrame, group: str) -> DataFrame:
    """rows of groups without any bad sample."""
    return rows.join(bad.select(group).distinct(), group, "left_anti")


def first_after(left: DataFrame, right: DataFrame, key: list[str], at: str, taken: str) -> DataFrame:
    """left with the first row of right (same key) that isn't earlier: an as-of join forward.

    Both sides are put in one order by time, and each row of left takes the next row of right that follows."""
    l_rows = left.withColumn("_t", F.col(at)).withColumn("_r", F.lit(None).cast(right.schema[taken].dataType))
    r_rows = right.select(*key, F.col(taken).alias("_t"), F.col(taken).alias("_r"))
    both = l_rows.withColumn("_left", F.lit(1)).unionByName(r_rows.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    # from the end on, so that what follows a row comes before it
    return filled(both, key, [F.desc("_t"), F.col("_left")], "_r", "next").where("_left = 1").drop("_t", "_r", "_left")


def nearest_in_time(left: DataFrame, right: DataFrame, key: list[str], id_: str, at: str, other: str, other_at: str) -> DataFrame:
    """left's ids with the id of right's row nearest in time; of equal ones the smaller id. Rows without any are left out.

    Both sides are put in one order by time, and each row of left takes the last row of right that isn't later and the
    first that isn't earlier: no row of left meets more than two."""
    per_time = right.groupBy(*key, F.col(other_at).alias("_t")).agg(F.min(other).alias("_id"))
    right_rows = per_time.withColumn("_r", F.struct("_t", "_id")).drop("_id")
    left_rows = left.select(*key, id_, F.col(at).alias("_t"))
    both = left_rows.withColumn("_left", F.lit(1)).unionByName(right_rows.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    gap = lambda r: F.when(r.isNotNull(), F.struct(F.abs(F.unix_micros(r["_t"]) - F.unix_micros("_t")).alias("gap"), r["_id"].alias("id")))
    met = filled(filled(both, key, [F.col("_t"), F.col("_left")], "_r", "_b"), key, [F.desc("_t"), F.col("_left")], "_r", "_a").where("_left = 1").withColumn("_n", F.least(gap(F.col("_b")), gap(F.col("_a"))))
    return met.where("_n is not null").select(id_, F.col("_n.id").alias(other), F.col("_n.gap").alias("gap_us"))


def violations(pairs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """pairs with the names of the rules that each breaks: order of dates, tiles, grids, availability, boxes.

    grid and pre_grid: crs, transform (six numbers), width, height. A pair lies on one grid, of some size and with a transform
    that can be undone; inputs were available after they were taken and, where as_of is given, by then."""
    grid, t = F.col("grid"), F.col("grid.transform")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sized = (F.length("grid.crs") > 0) & (F.col("grid.width") > 0) & (F.col("grid.height") > 0) & (F.size(t) == 6) & F.forall(t, finite)
    by_then = F.lit(True) if as_of is None else (F.col("pre_available_at") <= as_of) & (F.col("post_available_at") <= as_of)
    rules = {
        "pre_before_start": F.col("pre_at") < F.col("start_at"),
        "post_from_start": F.col("start_at") <= F.col("post_at"),
        "same_tile": F.col("tile") == F.col("pre_tile"),
        "same_grid": F.col("pre_grid") == grid,
        "grid": sized,
        "affine": F.get(t, F.lit(0)) * F.get(t, F.lit(4)) - F.get(t, F.lit(1)) * F.get(t, F.lit(3)) != 0,
        "available": (F.col("pre_available_at") >= F.col("pre_at")) & (F.col("post_available_at") >= F.col("post_at")) & by_then,
        "box": F.col("w").between(-180, 180) & F.col("e").between(-180, 180) & F.col("s").between(-90, 90) & F.col("n").between(-90, 90) & (F.col("w") < F.col("e")) & (F.col("s") < F.col("n")),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return pairs.withColumn("violations", broken)


def template_diff(template: DataFrame, submitted: DataFrame, key: list[str]) -> DataFrame:
    extra = submitted.join(template, key, "left_anti").select(*key, F.lit("extra").alias("side"))
    return extra.unionByName(template.join(submitted, key, "left_anti").select(*key, F.lit("missing").alias("side")))


def same_population(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (extra, missing): rows of a that b lacks and the reverse, counting repeats."""
    extra = a.exceptAll(b).agg(F.count("*").alias("extra"))
    return extra.crossJoin(b.exceptAll(a).agg(F.count("*").alias("missing")))  # one row each


def clearest_twin(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each frame with the scene of its tile and day that has the least cloud."""
    best = scenes.groupBy("tile", "day").agg(F.min(F.struct("cloud", "scene_id")).alias("s"))
    met = frames.select("frame_id", "tile", "day").join(best, ["tile", "day"]).groupBy("frame_id").agg(F.min("s").alias("s"))
    return met.select("frame_id", "s.scene_id", "s.cloud")
