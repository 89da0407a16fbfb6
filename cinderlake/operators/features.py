"""Feature tables of pixels by name, and decisions over them. Pixels are rows; what needs neighbours is a focal window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import indices
from cinderlake.operators import raster

# fixed values: the names of the feature sets, in the order that models expect
BASE = (
    "dnbr", "rbr", "nbr_pre", "nbr_post", "ndvi_pre", "ndvi_post", "dndvi", "nbr2_post", "b12_post", "b8a_post",
    "dnbr_win5", "dnbr_win15", "dnbr_std5", "dnbr_chip", "landcover", "slope", "dem", "vv", "vh",
)
WITH_RADAR_CHANGE = (*BASE, "vv_post", "vh_post", "dvv", "dvh")
WITH_SWIR = (*BASE, "mirbi_pre", "mirbi_post", "dmirbi", "nbr2_pre", "dnbr2", "b11_post")
ACTIVE_FIRE = ("i1", "i2", "i3", "i4", "i5", "dt", "i4_anom", "dt_anom", "i4_bg", "solar_zenith", "sensor_zenith", "landcover", "dem", "t2m", "rh2m", "wind")
# fixed values: scale of stored reflectance, heights and radar
REFLECTANCE, THOUSAND = 10_000.0, 1_000.0


def burn_features(pixels: DataFrame, names: Sequence[str] = BASE, by: str = "chip_id") -> DataFrame:
    """pixels with the named features.

    pixels: chip, row, col, valid; red, nir, swir1, swir2 with _pre and (null without a second date) _post; dem, slope,
    landcover; vv, vh and (null without a second pass) vv_after, vh_after. Only what the names need is computed."""
    pre = {b: F.col(f"{b}_pre").cast("double") for b in ("red", "nir", "swir1", "swir2")}
    post = {b: F.coalesce(F.col(f"{b}_post").cast("double"), pre[b]) for b in pre}
    zero = indices.nbr_or_zero
    nbr_pre, nbr_post = zero(pre["nir"], pre["swir2"]), zero(post["nir"], post["swir2"])
    mirbi = lambda d: indices.mirbi(d["swir1"] / REFLECTANCE, d["swir2"] / REFLECTANCE)
    radar = {b: F.col(b) / THOUSAND for b in ("vv", "vh")}
    after = {b: F.coalesce(F.col(f"{b}_after"), F.col(b)) / THOUSAND for b in ("vv", "vh")}
    plain: dict[str, Column] = {
        "dnbr": nbr_pre - nbr_post, "rbr": indices.rbr(nbr_pre - nbr_post, nbr_pre), "nbr_pre": nbr_pre, "nbr_post": nbr_post,
        "ndvi_pre": zero(pre["nir"], pre["red"]), "ndvi_post": zero(post["nir"], post["red"]), "dndvi": zero(pre["nir"], pre["red"]) - zero(post["nir"], post["red"]),
        "nbr2_pre": zero(pre["swir1"], pre["swir2"]), "nbr2_post": zero(post["swir1"], post["swir2"]), "dnbr2": zero(pre["swir1"], pre["swir2"]) - zero(post["swir1"], post["swir2"]),
        "mirbi_pre": mirbi(pre), "mirbi_post": mirbi(post), "dmirbi": mirbi(post) - mirbi(pre),
        "b8a_post": post["nir"] / REFLECTANCE, "b11_post": post["swir1"] / REFLECTANCE, "b12_post": post["swir2"] / REFLECTANCE,
        "landcover": F.col("landcover").cast("double"), "slope": F.col("slope").cast("double"), "dem": F.col("dem") / THOUSAND,
        **radar, **{f"{b}_post": after[b] for b in after}, **{f"d{b}": after[b] - radar[b] for b in radar},
    }
    focal = {
        "dnbr_win5": lambda df: raster.focal_mean(df, "_dnbr", 5, "f_dnbr_win5", by), "dnbr_win15": lambda df: raster.focal_mean(df, "_dnbr", 15, "f_dnbr_win15", by),
        "dnbr_std5": lambda df: raster.focal_std(df, "_dnbr", 5, "f_dnbr_std5", by), "dnbr_chip": lambda df: raster.scene_median(df, "_dnbr", "f_dnbr_chip", by),
    }
    unknown = [n for n in names if n not in plain and n not in focal]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    out = pixels.withColumns({f"f_{n}": plain[n] for n in names if n in plain} | {"_dnbr": plain["dnbr"]})
    for n in names:
        if n in focal:
            out = focal[n](out)
    return out.drop("_dnbr", *[n for n in names if n in pixels.columns]).withColumnsRenamed({f"f_{n}": n for n in names})


def active_fire_features(pixels: DataFrame, window: int = 15, by: str = "chip_id") -> DataFrame:
    """pixels (i1 to i5, angles, land cover, height, weather) with dt, the backgrounds of i4 and dt, and the anomalies."""
    both = pixels.withColumn("dt", F.col("i4") - F.col("i5"))
    both = raster.focal_mean(raster.focal_mean(both, "i4", window, "i4_bg", by), "dt", window, "dt_bg", by)
    return both.withColumns({"i4_anom": F.col("i4") - F.col("i4_bg"), "dt_anom": F.col("dt") - F.col("dt_bg")})


def active_fire(pixels: DataFrame, window: int = 15, by: str = "chip_id") -> DataFrame:
    """pixels with fire, by the contextual threshold over the window's background; pixels with quality 0 never burn."""
    f = active_fire_features(pixels, window, by)
    rule = indices.af_candidate(F.col("i4"), F.col("i5"), F.col("i4_bg"), F.col("dt_bg"), F.col("landcover"), F.col("quality") > 0)
    return f.withColumn("fire", F.coalesce(rule, F.lit(False)))


def decided(scored: DataFrame, probability: str, valid: Column, cutoff: float = 0.5, out: str = "pred") -> DataFrame:
    """scored with out: a probability that reaches the cutoff, on valid pixels."""
    return scored.withColumn(out, F.coalesce((F.col(probability) >= cutoff) & valid, F.lit(False)))


def fallback(chips: DataFrame, ranked: list[tuple[str, DataFrame]], key: list[str], value: str) -> DataFrame:
    """chips with the value of the first source that has one, and which source that was; null without any.

    ranked: names and tables, best first. A chip's value may come from any source, so a lower one is told by its name."""
    out = chips
    for k, (_, table) in enumerate(ranked):
        out = out.join(table.select(*key, F.col(value).alias(f"_v{k}")), key, "left")
    source = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(name)) for k, (name, _) in enumerate(ranked)])
    return out.withColumns({value: F.coalesce(*[F.col(f"_v{k}") for k in range(len(ranked))]), "source": source}).drop(*[f"_v{k}" for k in range(len(ranked))])
