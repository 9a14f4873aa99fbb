"""Array expressions: dot products, norms and padding, all higher-order built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Σ a[i]*b[i] (arrays of equal length)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def pad_right(arr, length: int, fill=0) -> Column:
    """Keep the last ``length`` elements, then pad ``fill`` on the right."""
    a = _c(arr)
    kept = F.when(F.size(a) > length, F.slice(a, -length, length)).otherwise(a)
    return F.concat(kept, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(kept))))


def pad_left(arr, length: int, fill=0) -> Column:
    """Keep the last ``length`` elements, then pad ``fill`` on the left."""
    a = _c(arr)
    kept = F.when(F.size(a) > length, F.slice(a, -length, length)).otherwise(a)
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(kept))), kept)


def mask_for(arr, length: int) -> Column:
    """1.0 for kept positions, 0.0 for padding (right padding)."""
    n = F.least(F.size(_c(arr)), F.lit(length))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= n, 1.0).otherwise(0.0))


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 of a wall-clock timestamp, independent of the session zone."""
    t = _c(ts)
    return (F.unix_date(F.to_date(t)).cast("bigint") * 86400
            + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("bigint")
