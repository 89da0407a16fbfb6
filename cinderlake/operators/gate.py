"""What decides whether a chip's members are trusted: their disagreement, their information, and how new the chip's input is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 in entropies.
EDGE = 1e-6


def binary_entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def mutual_information(members: list[Column]) -> Column:
    """Entropy of the members' mean less the mean of their entropies: what members disagree on, beyond each one's own doubt."""
    total = lambda xs: sum(xs[1:], xs[0])
    return binary_entropy(total(members) / len(members)) - total([binary_entropy(m) for m in members]) / len(members)


def disagreement(pixels: DataFrame, first: str, second: str, members: list[str], any_: str, valid: str = "valid", by: str = "chip_id", high: float = 0.3) -> DataFrame:
    """By chip: mean, share above `high` and 95 % of |first - second| over valid pixels, the share of high ones that some
    member marks (any_), and the members' mean information over valid and over marked pixels; 0 where there are none."""
    d = F.abs(F.col(first) - F.col(second))
    rows = pixels.withColumns({"_d": d, "_high": d > high, "_mi": mutual_information([F.col(m) for m in members])})
    ok, marked = F.col(valid), F.col(any_)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.groupBy(by).agg(
        zero(F.avg(F.when(ok, F.col("_d"))), "mean_gap"), zero(F.avg(F.when(ok, F.col("_high").cast("double"))), "high_share"), zero(F.expr(f"percentile(CASE WHEN `{valid}` THEN _d END, 0.95)"), "gap_95"),
        (F.count_if(F.col("_high") & marked) / F.greatest(F.count_if("_high"), F.lit(1))).alias("high_marked"), zero(F.avg(F.when(ok, F.col("_mi"))), "information"), zero(F.avg(F.when(marked, F.col("_mi"))), "information_marked"),
    )


def summaries(pixels: DataFrame, bands: list[str], valid: str = "valid", by: str = "chip_id", least: int = 100) -> DataFrame:
    """Rows (by, v): the medians of the bands and their spans from 10 to 90 %, over valid pixels, or all where too few are."""
    enough = pixels.groupBy(by).agg((F.count_if(valid) >= least).alias("_enough"))
    used = pixels.join(enough, by).where(F.col(valid) | ~F.col("_enough"))
    q = lambda b, p: F.expr(f"percentile(`{b}`, {p})")
    return used.groupBy(by).agg(F.array(*[q(b, 0.5) for b in bands], *[q(b, 0.9) - q(b, 0.1) for b in bands]).alias("v"))


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (divisor n - 1) of rows (v) of one length.

    Means first, then sums of products of what is left, by place in the matrix: its size is the vectors' alone, and so is
    what reaches the driver."""
    each = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).orderBy("i").collect()
    mean = np.array([r["mean"] for r in each])
    n = each[0].n if each else 0
    centred = vectors.select(F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m).alias("d")).select("d", F.posexplode("d").alias("i", "x"))
    pairs = centred.select("i", F.posexplode(F.transform("d", lambda y: y * F.col("x"))).alias("j", "p"))
    table = np.zeros((len(mean), len(mean)))
    for r in pairs.groupBy("i", "j").agg(F.sum("p").alias("s")).collect():
        table[r.i, r.j] = r.s
    return n, mean, table / max(n - 1, 1)


def novelty(vectors: DataFrame, reference: DataFrame, ridge: float = 1e-3, out: str = "novelty") -> DataFrame:
    """vectors (v and others) with the Mahalanobis distance from the reference's vectors (v).

    The covariance gets a share of its mean variance on its diagonal; with its Cholesky factor L, the distance is the length
    of what L takes to v less the mean, solved column by column forward. Null for vectors of another length, and where the
    reference has under two rows or doesn't vary."""
    n, mean, cov = covariance(reference)
    size = len(mean)
    whole = cov + ridge * np.eye(size) * (np.trace(cov) / max(size, 1))
    if n < 2 or not np.trace(cov) > 0:
        return vectors.withColumn(out, F.lit(None).cast("double"))
    lower = np.linalg.cholesky(whole)

    def forward(d: Column) -> Column:
        rows = F.lit(lower.tolist())
        step = lambda z, row, k: (F.get(d, k) - F.aggregate(F.zip_with(z, F.slice(row, F.lit(1), k), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)) / F.get(row, k)
        start = F.array().cast("array<double>")
        return F.aggregate(rows, start, lambda z, row: F.concat(z, F.array(step(z, row, F.size(z)))))

    centred = F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m)
    square = F.aggregate(forward(F.col("_d")), F.lit(0.0), lambda s, x: s + x * x)
    return vectors.withColumn("_d", centred).withColumn(out, F.when(F.size("v") == size, F.sqrt(square))).drop("_d")
