"""Fusing, averaging and deciding over class probabilities held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(p: Column) -> Column:
    return F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.concat(F.lit("probability out of range: "), F.coalesce(p.cast("string"), F.lit("null")))).cast("double"))


def noisy_or(p: Column, q: Column) -> Column:
    return p + (1 - p) * q


def equal_odds(p: Column, q: Column) -> Column:
    """The probability whose odds are the geometric mean of both odds."""
    a, b = F.sqrt(p * q), F.sqrt((1 - p) * (1 - q))
    return F.when(a + b > 0, a / (a + b))


def argmax(values: Column) -> Column:
    """Index of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def weighted_argmax(values: Column, weights: list[float]) -> Column:
    return argmax(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda p, w: p * w))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column) -> Column:
    return F.transform(values, lambda x: x / total(values))


def geometric_mean(members: list[Column], floor: float = 1e-4) -> Column:
    """Per-class geometric mean of several members' probabilities, summing to one."""
    logs = [F.transform(m, lambda x: F.ln(F.greatest(x, F.lit(floor)))) for m in members]
    out = logs[0]
    for other in logs[1:]:
        out = F.zip_with(out, other, lambda a, b: a + b)
    return normalised(F.transform(out, lambda x: F.exp(x / len(members))))


def trimmed_mean(values: Column) -> Column:
    """Mean without the smallest and the largest of at least three values."""
    inner = F.slice(F.array_sort(values), F.lit(2), F.size(values) - 2)
    return total(inner) / F.size(inner)


def entropy(values: Column) -> Column:
    return -total(F.transform(values, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)))
