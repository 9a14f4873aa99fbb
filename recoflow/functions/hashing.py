"""Deterministic pseudo-randomness.

Randomised operators order rows by ``md5(concat_ws('|', seed, keys...))``.
The hex string is identical in Spark and in ANSI engines, so sampled results
do not depend on partition layout or on the engine, and can be re-checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first 15 hex digits of the md5 are read as an unsigned 60-bit number.
_DIGITS = 15
TWO_60 = float(1 << 60)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed: int, *cols) -> Column:
    """md5 hex of ``seed|k1|k2...`` (keys cast to string)."""
    parts = [F.lit(str(seed))] + [_as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(seed: int, *cols) -> Column:
    """An integer in [0, 2^60) from the md5 key."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, _DIGITS), 16, 10).cast("bigint")


def hash_uniform(seed: int, *cols) -> Column:
    """A number in [0, 1) derived from the md5 key."""
    return hash_int(seed, *cols) / F.lit(TWO_60)


def hash_bucket(seed: int, n: int, *cols) -> Column:
    return F.pmod(hash_int(seed, *cols), F.lit(n))


# SQL text of the same expressions, for oracles.
def sql_hash_key(seed: int, *cols: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5(concat_ws('|', {parts}))"


def sql_hash_int(seed: int, *cols: str) -> str:
    return f"CAST('0x' || substr({sql_hash_key(seed, *cols)}, 1, {_DIGITS}) AS BIGINT)"


def sql_hash_uniform(seed: int, *cols: str) -> str:
    return f"({sql_hash_int(seed, *cols)} / {TWO_60!r})"
