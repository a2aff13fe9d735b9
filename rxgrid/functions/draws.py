"""Keyed deterministic draws (F1, F2).

A draw is a pure function of (seed, key): the first 16 hex digits of
sha256("seed|key") read as an unsigned 64-bit integer, divided by 2^64 - 1.
Being a column expression it is partition-, retry- and order-invariant, and
equals the Python and DuckDB formulations bit for bit (T14).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_U64_MAX = 18446744073709551615.0


def stable_fraction(key: Column, seed: int = 42) -> Column:
    """keyed pseudo-random fraction in [0, 1]."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)
    as_int = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return as_int.cast("double") / F.lit(_U64_MAX)


def stable_uniform(key: Column, low: Column | float, high: Column | float, seed: int = 42) -> Column:
    """keyed uniform value in [low, high]; ``low`` when the range is empty."""
    low = F.lit(float(low)) if isinstance(low, (int, float)) else low
    high = F.lit(float(high)) if isinstance(high, (int, float)) else high
    return F.when(high <= low, low.cast("double")).otherwise(low + (high - low) * stable_fraction(key, seed))


def hash_order_key(key: Column, seed: int = 42) -> Column:
    """Portable sort key for deterministic samples: sha256 hex of key||seed."""
    return F.sha2(F.concat(key.cast("string"), F.lit(str(seed))), 256)
