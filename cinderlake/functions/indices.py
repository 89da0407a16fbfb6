"""Spectral indices, validity of pixels and severity classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scene classes that hide the ground, and those that a chip's label treats as zero
SCL_INVALID = (0, 1, 3, 8, 9, 10, 11)
SCL_LABEL_ZERO = (0, 1, 3, 9, 11)
# fixed values: severity edges of dNBR and their class names
SEVERITY_EDGES = (0.10, 0.27, 0.44, 0.66)
SEVERITY_NAMES = ("unburnt", "low", "moderate_low", "moderate_high", "high")

CHIP_EDGES = (0.10, 0.27, 0.66)
TWO_DATE_LEAST = 0.27
# fixed values: the contextual threshold for active fire (kelvin), and land cover that never burns (built-up, water)
I4_LEAST, I4_ABOVE, DELTA_LEAST = 300, 20, 5
NEVER_BURNS = (50, 80)
# fixed values: a mapping programme's classes as training targets and as evaluation labels; others are unknown, -1
TARGETS = {2: 0, 3: 1, 4: 2}
EVALUATION_LABELS = {0: 0, 1: 0, 5: 0, 2: 1, 3: 2, 4: 3}
UNKNOWN_LABEL = -1
#: What scenes hold where they have no value.
NO_DATA = -9999


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.when(a + b != 0, (a - b) / (a + b))


def nbr(nir: Column, swir: Column) -> Column:
    """Undefined is null, as in a service's tables."""
    return ratio(nir, swir)


def nbr_or_zero(nir: Column, swir: Column) -> Column:
    """Undefined is 0, as in a chip's features."""
    return F.coalesce(ratio(nir, swir), F.lit(0.0))


def rbr(dnbr: Column, nbr_pre: Column) -> Column:
    return dnbr / (nbr_pre + 1.001)


def ndvi(nir: Column, red: Column) -> Column:
    return ratio(nir, red)


def nbr2(swir1: Column, swir2: Column) -> Column:
    return ratio(swir1, swir2)


def ndwi(green: Column, nir: Column) -> Column:
    return ratio(green, nir)


def ndre(nir: Column, red_edge: Column) -> Column:
    return ratio(nir, red_edge)


def mirbi(swir1: Column, swir2: Column) -> Column:
    return swir2 * 10.0 - swir1 * 9.8 + 2.0


def valid_pixel(scl: Column, nir: Column, swir: Column) -> Column:
    return ~scl.isin(*SCL_INVALID) & (nir > 0) & (swir > 0)


def chip_valid(scl_pre: Column, scl_post: Column) -> Column:
    """Clear on both dates; a chip without a second date counts its first alone."""
    return ~scl_pre.isin(*SCL_INVALID) & F.coalesce(~scl_post.isin(*SCL_INVALID), F.lit(True))


def label_zero(scl_pre: Column, scl_post: Column) -> Column:
    return scl_pre.isin(*SCL_LABEL_ZERO) | F.coalesce(scl_post.isin(*SCL_LABEL_ZERO), F.lit(False))


def severity(dnbr: Column, edges: tuple[float, ...] = SEVERITY_EDGES) -> Column:
    """Class 0 to 4: how many edges lie strictly below."""
    return sum((F.when(dnbr > e, 1).otherwise(0) for e in edges), F.lit(0))


def severity_chip(dnbr: Column, valid: Column, edges: tuple[float, ...] = CHIP_EDGES) -> Column:
    """Chips' class 0 to 3: how many edges are reached; invalid pixels are 0."""
    return F.when(valid, sum((F.when(dnbr >= e, 1).otherwise(0) for e in edges), F.lit(0))).otherwise(0)


def water_bit(fmask: Column) -> Column:
    return (fmask != 255) & (F.getbit(fmask, F.lit(5)) == 1)


def hls_bad(fmask: Column) -> Column:
    return (fmask == 255) | (F.getbit(fmask, F.lit(1)) == 1) | (F.getbit(fmask, F.lit(3)) == 1)


def af_candidate(i4: Column, i5: Column, bg4: Column, bg_delta: Column, landcover: Column, valid: Column) -> Column:
    """Contextual threshold for active fire; water and built-up land never burn."""
    return (i4 > I4_LEAST) & (i4 - bg4 > I4_ABOVE) & (i4 - i5 > DELTA_LEAST) & ((i4 - i5) - bg_delta > 0) & ~landcover.isin(*NEVER_BURNS) & valid


def two_date(model: Column, dnbr: Column, clean: Column) -> Column:
    return model | ((dnbr > TWO_DATE_LEAST) & clean)


def within_boundary(severity_class: Column, boundary: Column, valid: Column) -> Column:
    return F.when(boundary & valid, severity_class).otherwise(0)


def reflectance(raw: Column, scale: float, offset: float, nodata: float) -> Column:
    return F.when(raw != nodata, raw * scale + offset)


def harmonised_dn(raw: Column, baseline: Column) -> Column:
    """Digital numbers from processing baseline 04.00 on carry an offset of 1000."""
    parts = F.split(baseline, r"\.")
    late = F.get(parts, F.lit(0)).cast("int") * 100 + F.get(parts, F.lit(1)).cast("int") >= 400
    return F.when(late, F.greatest(raw - 1000, F.lit(0))).otherwise(raw)


def scene_valid(bands: Column, scl: Column, label: Column) -> Column:
    """All bands finite and present, a scene class that shows the ground, and a known label."""
    fine = F.forall(bands, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")) & (x != NO_DATA), F.lit(False)))
    return fine & ~scl.isin(*SCL_INVALID) & (label >= 0)


def scene_water(green: Column, nir: Column, scl: Column) -> Column:
    return (scl == 6) & ((green - nir) / (green + nir + 1e-6) > 0)


def relabelled(raw: Column, valid: Column, table: dict[int, int]) -> Column:
    """A class by a table, unknown for other classes and pixels that aren't valid."""
    out = F.lit(UNKNOWN_LABEL)
    for source, target in table.items():
        out = F.when((raw == source) & valid, target).otherwise(out)
    return out


def with_additions(reference: Column, paired: Column, observed: Column, least: float = 0.5, sure: float = 0.95) -> Column:
    """struct(kept, added, positive): what the reference has from `least` on, and what the pair adds when it is sure."""
    kept = (reference >= least) & observed
    added = (paired >= sure) & observed & ~kept
    return F.struct(kept.alias("kept"), added.alias("added"), (kept | added).alias("positive"))
