"""Deterministic ranks and partitions by salted hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)


def hex_mod(digest: Column, modulus: int) -> Column:
    """A hexadecimal number of any length modulo a small one, digit by digit."""
    return F.aggregate(F.split(digest, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(F.pmod(a * 16 + F.conv(c, 16, 10).cast("long"), F.lit(modulus))))
