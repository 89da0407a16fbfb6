"""Neighbourhoods of masks and class maps: rings, medians, distances and rules over components.

Maxima and minima over squares are two passes of row windows; what needs a whole chip takes one, which is of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.operators import raster
from cinderlake.operators.evaluation import burn_score


def _square(pixels: DataFrame, value: Column, reach: int, out: str, take, by: str) -> DataFrame:
    across = Window.partitionBy(by, "row").orderBy("col").rowsBetween(-reach, reach)
    along = Window.partitionBy(by, "col").orderBy("row").rowsBetween(-reach, reach)
    return pixels.withColumn("_s", take(value).over(across)).withColumn(out, take("_s").over(along)).drop("_s")


def dilated(pixels: DataFrame, mask: str, reach: int, out: str, by: str = "chip_id") -> DataFrame:
    """Pixels with one of the mask in the square around them; beyond the chip there is nothing."""
    return _square(pixels, F.col(mask).cast("int"), reach, out, F.max, by).withColumn(out, F.col(out) == 1)


def eroded(pixels: DataFrame, mask: str, reach: int, out: str, by: str = "chip_id") -> DataFrame:
    """Pixels whose whole square is in the mask; a chip's edge doesn't count against it."""
    return _square(pixels, F.col(mask).cast("int"), reach, out, F.min, by).withColumn(out, F.col(out) == 1)


def ring(pixels: DataFrame, mask: str, outer: int, inner: int, out: str, by: str = "chip_id") -> DataFrame:
    """Pixels within `outer` of the mask's edge outside of it, or within `inner` inside."""
    both = eroded(dilated(pixels, mask, outer, "_d", by), mask, inner, "_e", by)
    return both.withColumn(out, F.col("_d") & ~F.col("_e")).drop("_d", "_e")


def median_filter(pixels: DataFrame, value: str, k: int, out: str, by: str = "chip_id") -> DataFrame:
    """The middle value of each k x k square, with edges repeated. Chips are of bounded size and whole rectangles."""

    def run(chip: pd.DataFrame) -> dict:
        grid = np.pad(raster._grid(chip, value), k // 2, mode="edge")
        squares = np.lib.stride_tricks.sliding_window_view(grid, (k, k)).reshape(*(n - 2 * (k // 2) for n in grid.shape), -1)
        return {out: np.partition(squares, k * k // 2, axis=-1)[..., k * k // 2][chip.row, chip.col]}

    return raster._per_chip(pixels.drop(out), f"{out} {dict(pixels.dtypes)[value]}", run, by)


def with_distance(pixels: DataFrame, mask: str, out: str, pixel_m: float = 1.0, none: float = 1e9, by: str = "chip_id") -> DataFrame:
    """Each pixel's distance to the nearest one of the mask, `none` where a chip has none of it."""

    def run(chip: pd.DataFrame) -> dict:
        far = raster.distance_to(raster._grid(chip, mask).astype(bool))[chip.row, chip.col] * pixel_m
        return {out: np.where(np.isfinite(far), far, none)}

    return raster._per_chip(pixels.drop(out), f"{out} double", run, by)


def nearest_of(mask: np.ndarray) -> np.ndarray:
    """For each pixel the number, in reading order, of the nearest one of the mask, the first of equally near ones.

    Along columns first: the nearest of each column, above before below. Then by columns farther and farther away, until
    none can be nearer. One number tells of the distance and, after it, of the order."""
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -4 * (h + w)), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, 5 * (h + w))[::-1], axis=0)[::-1]
    row = np.where(rows - above <= below - rows, above, below)
    gap = (rows - row) ** 2
    place = row * w + np.arange(w)
    none = ~mask.any(0)
    best = np.full((h, w), np.iinfo(np.int64).max)
    for d in range(w):
        if d and d * d > best.max() // (h * w):
            break
        key = np.where(none, np.iinfo(np.int64).max, (gap + d * d) * (h * w) + place)
        np.minimum(best[:, d:], key[:, : w - d], out=best[:, d:])
        np.minimum(best[:, : w - d], key[:, d:], out=best[:, : w - d])
    return best % (h * w)


def nearest_valid(pixels: DataFrame, value: str, valid: str, out: str, by: str = "chip_id") -> DataFrame:
    """value, and on pixels that aren't valid that of the nearest valid one: of equally near ones the first in reading order.

    A chip without any valid pixel keeps its values."""

    def run(chip: pd.DataFrame) -> dict:
        grid, fine = raster._grid(chip, value), raster._grid(chip, valid).astype(bool)
        own = grid[chip.row, chip.col]
        if fine.any():
            near = nearest_of(fine)[chip.row, chip.col]
            own = grid.ravel()[near]
        return {out: own}

    return raster._per_chip(pixels.drop(out), f"{out} {dict(pixels.dtypes)[value]}", run, by)


def drop_relatively_small(pixels: DataFrame, class_column: str, share: float, least_px: int = 0, by: str = "chip_id") -> DataFrame:
    """Classes of components below a share of the chip's largest, or below least_px, become 0; a lone component stays."""
    marked = raster.mask_components(pixels.withColumn("_m", F.col(class_column) > 0), "_m", by=by)
    chip = Window.partitionBy(by)
    small = (F.col("component_px") < F.max("component_px").over(chip) * share) | (F.col("component_px") < least_px)
    gone = small & (F.max("component").over(chip) > 1)
    return marked.withColumn("_g", gone).withColumn(class_column, F.when(F.col("_g"), 0).otherwise(F.col(class_column))).drop("_m", "_g", "component", "component_px")


def override(pixels: DataFrame, burned: str, background: str, tau: float, least_px: int, out: str, by: str = "chip_id") -> DataFrame:
    """burned, and components of at least so many pixels that aren't burned but whose background is less likely than 1 - tau."""
    sure = ~F.col(burned) & (1 - F.col(background) > tau)
    marked = raster.mask_components(pixels.withColumn("_o", sure), "_o", by=by)
    return marked.withColumn(out, F.col(burned) | (F.col("_o") & (F.col("component_px") >= least_px))).drop("_o", "component", "component_px")


def accepted_components(pixels: DataFrame, candidate: str, chosen: str, first: str, second: str, least_px: int, s: float, t: float, out: str, by: str = "chip_id") -> DataFrame:
    """chosen, and candidate components that it misses wholly, of at least so many pixels, whose means of both signals exceed s and t."""
    marked = raster.mask_components(pixels, candidate, by=by)
    own = Window.partitionBy(by, "component")
    fine = F.col(candidate) & (F.col("component_px") >= least_px) & ~F.max(chosen).over(own) & (F.avg(first).over(own) > s) & (F.avg(second).over(own) > t)
    return marked.withColumn(out, F.col(chosen) | fine).drop("component", "component_px")


def component_table(pixels: DataFrame, mask: str, probability: str, by: str = "chip_id") -> DataFrame:
    """Per component: pixels, distance to the main one and mean probability."""
    far = raster.component_distances(pixels, mask, by)
    mean = raster.mask_components(pixels, mask, by=by).where("component > 0").groupBy(by, "component").agg(F.avg(probability).alias("mean_probability"))
    return far.join(mean, [by, "component"])


def far_grid(pixels: DataFrame, class_column: str, truth: str, probability: str, hard: list[float], soft: list[float], least: list[float], classes: int = 4, by: str = "chip_id") -> DataFrame:
    """Rows (hard, soft, tau, burn_iou, severity_miou, weighted): the score over valid pixels for each choice of thresholds.

    A component other than its chip's main one goes if it is farther away than `hard`, or farther than `soft` with a mean
    probability below tau. Components are looked at once: their pixels are summed up by where distance and probability lie
    between thresholds, and every choice is a sum over these few cells, whose number the thresholds bound."""
    cuts = sorted({*hard, *soft})
    marked = raster.mask_components(pixels.withColumn("_m", F.col(class_column) > 0), "_m", by=by)
    table = component_table(pixels.withColumn("_m", F.col(class_column) > 0), "_m", probability, by).select(by, "component", "main", "distance", "mean_probability")
    rows = marked.join(table, [by, "component"], "left").where("valid")
    count = lambda values, test: sum((F.when(test(F.lit(float(v))), 1).otherwise(0) for v in values), F.lit(0))
    fixed = F.coalesce(F.col("main"), F.lit(True))
    # how many cuts the distance exceeds, and how many probabilities are reached
    cells = rows.select(fixed.alias("_fixed"), count(cuts, lambda v: F.col("distance") > v).alias("_beyond"), count(sorted(least), lambda v: F.col("mean_probability") >= v).alias("_reached"), F.col(truth).alias("truth"), F.col(class_column).alias("_class"))
    cells = cells.groupBy(*cells.columns).agg(F.count("*").alias("n"))
    choices = [(float(h), float(s), float(t), cuts.index(h), cuts.index(s), sorted(least).index(t)) for h in hard for s in soft for t in least]
    # as many rows as there are choices, with cells that the thresholds bound
    grid = pixels.sparkSession.createDataFrame(choices, "hard double, soft double, tau double, _h int, _s int, _t int")
    kept = F.col("_fixed") | (F.col("_beyond") <= F.col("_h")) & ((F.col("_beyond") <= F.col("_s")) | (F.col("_reached") > F.col("_t")))
    met = cells.join(F.broadcast(grid), F.lit(True)).withColumn("pred", F.when(kept, F.col("_class")).otherwise(0))
    key = ["hard", "soft", "tau"]
    every = [F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.lit(0).cast("long").alias("n")) for t in range(classes) for p in range(classes)]
    dense = grid.select(*key, F.inline(F.array(*every))).unionByName(met.select(*key, "truth", "pred", "n"))
    return burn_score(dense.groupBy(*key, "truth", "pred").agg(F.sum("n").alias("n")), key)


def object_rings(pixels: DataFrame, mask: str, bands: list[str], reach: float = 5.0, by: str = "chip_id") -> DataFrame:
    """Rows (by, component, px, ring_px and, for each band, <band>_contrast and <band>_texture).

    A component's own ring is the pixels outside of the mask that are nearest to it (of equally near ones, to the pixel that
    is first in reading order) and no farther away than `reach`, so rings of neighbours share no pixel. The contrast is the
    mean inside less the ring's, null for a component without a ring; the texture is the deviation inside."""

    def run(chip: pd.DataFrame) -> dict:
        own = raster._grid(chip, mask).astype(bool)
        number = raster.labelled(own)
        if own.any():
            at = nearest_of(own)
            row, col = np.divmod(at, own.shape[1])
            far = (np.arange(own.shape[0])[:, None] - row) ** 2 + (np.arange(own.shape[1]) - col) ** 2
            near = np.where(far <= reach * reach, number.ravel()[at], 0)
        else:
            near = number
        return {"component": near[chip.row, chip.col], "_inside": own[chip.row, chip.col]}

    told = raster._per_chip(pixels.select(by, "row", "col", mask, *bands), "component int, _inside boolean", run, by).where("component > 0")
    inside = F.col("_inside")
    mean = lambda b, where: F.avg(F.when(where, F.col(b)))
    return told.groupBy(by, "component").agg(
        F.count_if(inside).alias("px"), F.count_if(~inside).alias("ring_px"), *[(mean(b, inside) - mean(b, ~inside)).alias(f"{b}_contrast") for b in bands],
        *[F.stddev_pop(F.when(inside, F.col(b))).alias(f"{b}_texture") for b in bands],
    )


# fixed values: unequal rings around a chip's centre, in pixels
RADII = (0, 64, 128, 192, 256, 400)


def radial_histogram(pixels: DataFrame, truth: str, wrong: str, height: int, width: int, radii: tuple[int, ...] = RADII) -> DataFrame:
    """Rows (ring, truth_share, wrong_share, area_share) by distance to the chip's centre."""
    r = F.hypot(F.col("row") - height / 2, F.col("col") - width / 2)
    ring = F.lit(None).cast("int")
    for k in range(len(radii) - 1, 0, -1):
        ring = F.when((r >= radii[k - 1]) & (r < radii[k]), k - 1).otherwise(ring)
    sums = pixels.withColumn("ring", ring).groupBy("ring").agg(F.count_if(truth).alias("t"), F.count_if(wrong).alias("w"), F.count("*").alias("n"))
    whole = sums.agg(F.sum("t").alias("all_t"), F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    joined = sums.crossJoin(F.broadcast(whole)).where("ring is not null")  # one row
    return joined.select("ring", share("t", "all_t").alias("truth_share"), share("w", "all_w").alias("wrong_share"), share("n", "all_n").alias("area_share"))


def error_profile(pixels: DataFrame, truth: str, pred: str, by: str = "chip_id") -> DataFrame:
    """Rows (zone, false_positives, false_negatives): errors by their distance to the truth's edge, up to 2, up to 10, beyond."""
    inner = with_distance(pixels.withColumn("_not", ~F.col(truth)), "_not", "_in", by=by)
    both = with_distance(inner, truth, "_out", by=by)
    edge = F.when(F.col(truth), F.col("_in")).otherwise(F.col("_out"))
    zone = F.when(edge <= 2, "edge").when(edge <= 10, "near").otherwise("far")
    return both.withColumn("zone", zone).groupBy("zone").agg(F.count_if(F.col(pred) & ~F.col(truth)).alias("false_positives"), F.count_if(~F.col(pred) & F.col(truth)).alias("false_negatives"))


def lost(pixels: DataFrame, truth: str, pred: str, least: float = 0.3, by: str = "chip_id") -> DataFrame:
    """Chips with truth whose IoU is below `least`."""
    t, p = F.col(truth), F.col(pred)
    sums = pixels.groupBy(by).agg(F.count_if(t & p).alias("i"), F.count_if(t | p).alias("u"), F.count_if(t).alias("n"))
    return sums.where("n > 0").withColumn("iou", F.col("i") / F.col("u")).where(F.col("iou") < least).select(by, "iou")
