"""Rasters: burned area, masks and components. Pixels come as rows (chip_id, row, col, ...) where relations
express the work, and as one row per chip with arrays where neighbourhoods do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions import indices
from cinderlake.operators.graph import spanning
from cinderlake.operators.numbering import numbered


def area_by_class(pixels: DataFrame, pixel_ha: float, by: str = "chip_id") -> DataFrame:
    """Hectares of each severity class over valid pixels; columns by, severity and a struct's five numbers."""
    names = indices.SEVERITY_NAMES
    sums = [(F.count_if(F.col("valid") & (F.col("severity") == k)) * F.lit(pixel_ha)).alias(n) for k, n in enumerate(names)]
    return pixels.groupBy(by).agg(*sums, F.count_if("valid").alias("valid_pixels"), F.count("*").alias("seen_pixels"))


def burned_ha() -> Column:
    return sum((F.col(n) for n in indices.SEVERITY_NAMES[1:]), F.lit(0.0))


def masked_fraction(valid: Column, requested: Column) -> Column:
    """Share of the requested pixels that carry no valid value; all of it where nothing was requested."""
    return F.when(requested > 0, 1.0 - valid / requested).otherwise(1.0)


def enrichment(pixels: DataFrame, points: DataFrame, by: str = "chip_id") -> DataFrame:
    """Share of points inside that hit burned pixels over the burned share of valid pixels; null without either."""
    base = pixels.where("valid").groupBy(by).agg(F.count("*").alias("n_valid"), F.count_if(F.col("severity") > 0).alias("n_burned"))
    inside = points.join(pixels.where("valid").select(by, "row", "col", "severity"), [by, "row", "col"])
    hits = inside.groupBy(by).agg(F.count("*").alias("n_inside"), F.count_if(F.col("severity") > 0).alias("n_hits"))
    both = base.join(hits, by, "left").fillna(0, ["n_inside", "n_hits"])
    rate = F.when((F.col("n_inside") > 0) & (F.col("n_burned") > 0), (F.col("n_hits") / F.col("n_inside")) / (F.col("n_burned") / F.col("n_valid")))
    return both.withColumn("enrichment", rate)


def compare_area(own_ha: Column, product_ha: Column, least_ha: float = 1000.0) -> Column:
    """struct(status, ratio): no_data without a product, not_comparable when small, else ok."""
    status = F.when(product_ha.isNull(), "no_data").when(own_ha < least_ha, "not_comparable").otherwise("ok")
    ratio = F.when((status == "ok") & (product_ha != 0), own_ha / product_ha)
    return F.struct(status.alias("status"), ratio.alias("ratio"))


def product_area(pixels: DataFrame, burn_day: str, by: str = "chip_id", pixel_ha: float = 25.0) -> DataFrame:
    """Hectares of a product's pixels with a day of burning; negative values are no data, 0 is unburned."""
    return pixels.groupBy(by).agg((F.count_if(F.col(burn_day) > 0) * F.lit(pixel_ha)).alias("product_ha"))


def packed(pixels: DataFrame, mask: str, key: list[str], position: str = "pos") -> DataFrame:
    """Rows (key, byte, bits): the mask in bytes of eight positions (from 1), the first in the lowest bit."""
    at = F.col(position) - 1
    bit = F.when(F.col(mask), F.pow(F.lit(2.0), at % 8).cast("int")).otherwise(0)
    return pixels.groupBy(*key, F.floor(at / 8).alias("byte")).agg(F.bit_or(bit).alias("bits"))


def unpacked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, pos, on) of packed masks."""
    spread = rows.select(*key, "byte", "bits", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return spread.select(*key, (F.col("byte") * 8 + F.col("k") + 1).alias("pos"), (F.floor(F.col("bits") / F.pow(F.lit(2.0), F.col("k"))) % 2 == 1).alias("on"))


def incidence_cosine(slope_deg: Column, aspect_deg: Column, sun_zenith: float, sun_azimuth: float) -> Column:
    z, s = F.radians(F.lit(sun_zenith)), F.radians(slope_deg)
    return F.cos(z) * F.cos(s) + F.sin(z) * F.sin(s) * F.cos(F.radians(F.lit(sun_azimuth) - aspect_deg))


def terrain_corrected(pixels: DataFrame, band: str, cosine: str, sun_zenith: float, out: str, by: str = "chip_id") -> DataFrame:
    """C-correction: band times (cos z + c) / (cos i + c), the factor within 0.5 and 2; c is intercept over slope of the band
    on cos i in the chip, and the band stays where there is no such line."""
    fit = pixels.where("valid").groupBy(by).agg(F.regr_slope(band, cosine).alias("_k"), F.regr_intercept(band, cosine).alias("_i"))
    c = F.col("_i") / F.col("_k")
    factor = F.least(F.greatest((F.cos(F.radians(F.lit(sun_zenith))) + c) / (F.col(cosine) + c), F.lit(0.5)), F.lit(2.0))
    return pixels.join(fit, by, "left").withColumn(out, F.when(F.col("_k") != 0, F.col(band) * factor).otherwise(F.col(band))).drop("_k", "_i")


def ratio_summary(compared: DataFrame) -> DataFrame:
    """Smallest, upper median, largest and mean ratio of comparable rows; no row if there are none."""
    rows = numbered(compared.where("status = 'ok' and ratio is not null and ratio != 0").select("ratio"), "ratio")
    sums = rows.agg(F.count("*").alias("n"), F.min("ratio").alias("smallest"), F.max("ratio").alias("largest"), F.avg("ratio").alias("mean"), F.count_if(F.col("ratio") > 1).alias("above"), F.count_if(F.col("ratio") < 1).alias("below"))
    joined = rows.select("number", F.col("ratio").alias("median")).join(F.broadcast(sums)).where(F.col("number") == F.floor(F.col("n") / 2) + 1)  # one row
    return joined.select("n", "smallest", "median", "largest", "mean", "above", "below")


def focal_mean(pixels: DataFrame, value: str, k: int, out: str, by: str = "chip_id") -> DataFrame:
    """Mean over a k x k square with replicated edges, as two passes of row windows.

    A replicated edge is a weight on the border's value, so nothing is padded: each pass adds the border's value as
    often as the window reaches beyond it."""
    half = k // 2

    def one(df: DataFrame, source: str, target: str, along: str, across: str) -> DataFrame:
        w = Window.partitionBy(by, across).orderBy(along)
        whole = Window.partitionBy(by, across)
        size, at = F.max(along).over(whole), F.col(along)
        inner = F.sum(source).over(w.rowsBetween(-half, half))
        low = F.greatest(F.lit(half) - at, F.lit(0)) * F.first(source).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        high = F.greatest(at + half - size, F.lit(0)) * F.last(source).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumn(target, (inner + low + high) / k)

    return one(one(pixels, value, "_pass", "col", "row"), "_pass", out, "row", "col").drop("_pass")


def focal_std(pixels: DataFrame, value: str, k: int, out: str, by: str = "chip_id") -> DataFrame:
    squared = pixels.withColumn("_sq", F.col(value) * F.col(value))
    both = focal_mean(focal_mean(squared, value, k, "_m", by), "_sq", k, "_m2", by)
    return both.withColumn(out, F.sqrt(F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0)))).drop("_sq", "_m", "_m2")


def local_z(pixels: DataFrame, value: str, k: int, out: str, by: str = "chip_id") -> DataFrame:
    both = focal_std(focal_mean(pixels, value, k, "_mu", by), value, k, "_sd", by)
    return both.withColumn(out, (F.col(value) - F.col("_mu")) / (F.col("_sd") + 1e-3)).drop("_mu", "_sd")


def scene_median(pixels: DataFrame, value: str, out: str, by: str = "chip_id") -> DataFrame:
    """pixels with the median of each chip's valid values, 0 where it has none."""
    medians = pixels.where("valid").groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias(out))
    return pixels.join(medians, by, "left").fillna(0.0, [out])


def normalise_post(pixels: DataFrame, pre: str, post: str, stable: Column, least: int = 500, by: str = "chip_id") -> DataFrame:
    """post fitted to pre over stable pixels, by a line per chip; unchanged where too few are stable."""
    fit = pixels.where(stable).groupBy(by).agg(F.count("*").alias("_n"), F.regr_slope(pre, post).alias("_a"), F.regr_intercept(pre, post).alias("_b"))
    joined = pixels.join(fit, by, "left")
    line = F.least(F.greatest(F.col(post) * F.col("_a") + F.col("_b"), F.lit(0.0)), F.lit(65535.0))
    return joined.withColumn("post_fitted", F.when((F.col("_n") >= least) & F.col("_a").isNotNull(), line).otherwise(F.col(post))).drop("_n", "_a", "_b")


def neighbour_max(pixels: DataFrame, value: str, out: str, by: str = "chip_id") -> DataFrame:
    """Largest value of the 3 x 3 square around each pixel."""
    across = Window.partitionBy(by, "row").orderBy("col").rowsBetween(-1, 1)
    along = Window.partitionBy(by, "col").orderBy("row").rowsBetween(-1, 1)
    return pixels.withColumn("_r", F.max(value).over(across)).withColumn(out, F.max("_r").over(along)).drop("_r")


def slope(pixels: DataFrame, height: str, cell_m: float, by: str = "chip_id") -> DataFrame:
    """Slope in degrees from central differences, one-sided at the edges."""

    def gradient(across: str, along: str) -> Column:
        w = Window.partitionBy(by, across).orderBy(along)
        before, after, own = F.lag(height).over(w), F.lead(height).over(w), F.col(height)
        return F.coalesce((after - before) / 2, after - own, own - before, F.lit(0.0)) / cell_m

    return pixels.withColumn("slope", F.degrees(F.atan(F.hypot(gradient("row", "col"), gradient("col", "row")))))


# --- one row per chip -------------------------------------------------------------------------------------------


def labelled(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Component numbers from 1 in reading order, 0 outside the mask.

    Runs of a row are nodes, runs that touch in the next row are edges; both come from whole-array steps."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), bool)
    wide[:, 1:-1] = mask
    edge = np.diff(wide.astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)  # one past the run's last pixel
    out = np.zeros(mask.shape, np.int32)
    if not len(row):
        return out
    reach = 1 if eight else 0
    # of the next row, the runs that end after this one's start and start before its end
    place = row * (2 * w + 4)
    low = np.searchsorted(place + end, place + 2 * w + 4 + start - reach, side="right")
    high = np.searchsorted(place + start, place + 2 * w + 4 + end + reach, side="left")
    # a row's runs stay within its own band of places
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + low[a]
    node, root = spanning(a, b, len(row))
    of = np.arange(len(row))
    of[node] = root
    # the root is a component's first run, so numbers follow the reading order
    number = np.unique(of, return_inverse=True)[1] + 1
    size = end - start
    at = np.repeat(row * w + start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out.ravel()[at] = np.repeat(number, size)
    return out


def _grid(chip: pd.DataFrame, column: str) -> np.ndarray:
    shape = (int(chip.row.max()) + 1, int(chip.col.max()) + 1)
    out = np.zeros(shape, chip[column].to_numpy().dtype)
    out[chip.row, chip.col] = chip[column]
    return out


def _per_chip(pixels: DataFrame, added: str, run, by: str) -> DataFrame:
    """pixels with the columns that run(chip) gives, whole chips at once: a chip is of bounded size."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema)
    return pixels.groupBy(by).applyInPandas(lambda chip: chip.assign(**run(chip)), f"{fields}, {added}")


def mask_components(pixels: DataFrame, mask: str, eight: bool = False, by: str = "chip_id") -> DataFrame:
    """pixels with component (0 outside the mask) and its size. A chip is of bounded size, so it is one group."""

    def run(chip: pd.DataFrame) -> dict:
        number = labelled(_grid(chip, mask).astype(bool), eight)
        size = np.bincount(number.ravel())
        size[0] = 0
        own = number[chip.row, chip.col]
        return {"component": own, "component_px": size[own]}

    return _per_chip(pixels.drop("component", "component_px"), "component int, component_px long", run, by)


def drop_small(pixels: DataFrame, class_column: str, least_px: int, by: str = "chip_id") -> DataFrame:
    """Classes of components (of any class) with fewer pixels become 0."""
    marked = mask_components(pixels.withColumn("_m", F.col(class_column) > 0), "_m", by=by)
    return marked.withColumn(class_column, F.when(F.col("component_px") >= least_px, F.col(class_column)).otherwise(0)).drop("_m", "component", "component_px")


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Each pixel's distance to the nearest one of the mask (infinite if it is empty): along columns first, then by
    rows the least of squares, which is exact."""
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -h * 2 - w), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, h * 3 + w)[::-1], axis=0)[::-1]
    column = np.minimum(rows - above, below - rows).astype(np.float64)
    column[:, ~mask.any(0)] = np.inf
    square = np.full((h, w), np.inf)
    for d in range(w):
        if d * d > square.max():
            break  # no column farther away is nearer
        shift = column[:, : w - d] ** 2 + d * d
        np.minimum(square[:, d:], shift, out=square[:, d:])
        np.minimum(square[:, : w - d], column[:, d:] ** 2 + d * d, out=square[:, : w - d])
    return np.sqrt(square)


def component_distances(pixels: DataFrame, mask: str, by: str = "chip_id", anchor: str | None = None) -> DataFrame:
    """Per component: pixels, whether it is the main one (the largest, first on ties), distance to the main one.

    With an anchor, a mask of its own, the main one is that with most of its pixels, if any has one."""
    schema = f"{by} long, component int, px long, main boolean, distance double"

    def run(chip: pd.DataFrame) -> pd.DataFrame:
        number = labelled(_grid(chip, mask).astype(bool))
        size = np.bincount(number.ravel())[1:]
        if not len(size):
            return pd.DataFrame({by: [], "component": [], "px": [], "main": [], "distance": []})
        held = np.bincount(number[_grid(chip, anchor).astype(bool)], minlength=len(size) + 1)[1:] if anchor else size
        main = int((held if held.any() else size).argmax()) + 1
        far = distance_to(number == main)
        far = np.array([far[number == k].min() for k in range(1, len(size) + 1)])
        ids = np.arange(1, len(size) + 1)
        return pd.DataFrame({by: chip[by].iloc[0], "component": ids, "px": size, "main": ids == main, "distance": far})

    return pixels.select(by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *dict.fromkeys([mask, anchor or mask])).groupBy(by).applyInPandas(run, schema)


def drop_far(pixels: DataFrame, mask: str, most_px: float = 125.0, by: str = "chip_id", anchor: str | None = None) -> DataFrame:
    """pixels whose mask keeps the main component (with an anchor, that which holds most of it) and those near it."""
    near = component_distances(pixels, mask, by, anchor).where(F.col("distance") <= most_px).select(by, "component", F.lit(True).alias("_near"))
    marked = mask_components(pixels, mask, by=by).join(near, [by, "component"], "left")
    return marked.withColumn(mask, F.col(mask) & F.coalesce("_near", F.lit(False))).drop("_near", "component", "component_px")


def rescue(pixels: DataFrame, baseline: str, predicted: str, out: str, most_px: int = 64, by: str = "chip_id") -> DataFrame:
    """predicted plus whole small components (eight neighbours) of the baseline that it misses entirely."""
    marked = mask_components(pixels, baseline, eight=True, by=by)
    touched = F.max(F.col(predicted).cast("int")).over(Window.partitionBy(by, "component"))
    back = F.col(baseline) & (F.col("component_px") <= most_px) & (touched == 0)
    return marked.withColumn(out, F.col(predicted) | back).drop("component", "component_px")


def component_features(pixels: DataFrame, mask: str, by: str = "chip_id") -> DataFrame:
    """Per component: log area, compactness 4 pi a / p^2, fill of its box."""
    marked = mask_components(pixels, mask, by=by).where("component > 0")
    key = [by, "component"]
    sides = marked.select(*key, F.explode(F.array(*[F.struct((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("n")).select(*key, "n.*")
    edge = sides.join(marked.select(*key, "row", "col"), [*key, "row", "col"], "left_anti").groupBy(*key).agg(F.count("*").alias("perimeter"))
    box = marked.groupBy(*key).agg(F.count("*").alias("px"), ((F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)).alias("box"))
    both = box.join(edge, key)
    return both.select(*key, "px", "perimeter", F.ln("px").alias("log_area"), (4 * np.pi * F.col("px") / (F.col("perimeter") * F.col("perimeter"))).alias("compactness"), (F.col("px") / F.col("box")).alias("fill"))


def grow(pixels: DataFrame, core: str, candidate: str, out: str, by: str = "chip_id") -> DataFrame:
    """core plus whole components of the candidates that touch it (share a pixel or a side)."""
    union = mask_components(pixels.withColumn("_u", F.col(core) | F.col(candidate)), "_u", by=by)
    seeded = F.max(F.col(core).cast("int")).over(Window.partitionBy(by, "component"))
    return union.withColumn(out, F.col("_u") & (seeded == 1)).drop("_u", "component", "component_px")
