"""Deterministic pseudo-random keys from a seed and a stored row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 4
BUCKETS = 16**HEX_DIGITS


def shuffle_key(seed: int | str, *ids: Column | str) -> Column:
    """Hex digest of ``seed:id[:id...]``; ordering by it is a seeded shuffle."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def key_bucket(key: Column, digits: int = HEX_DIGITS) -> Column:
    """Leading hex digits of a key: evenly filled and ordered like the key."""
    return F.substring(key, 1, digits)


def hash_uniform(seed: int | str, *ids: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the key."""
    head = F.conv(F.substring(shuffle_key(seed, *ids), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)
