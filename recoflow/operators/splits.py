"""Splitters: random, stratified, chronological, global-time, ratio rows, holdouts.

Every splitter returns the input rows tagged with an integer ``split``
column (0 = first part). ``parts(tagged, n)`` gives the list of DataFrames
the reference returns. Cut rule of the Spark variant: a row belongs to split
``i`` when ``bound[i-1] < rank/count <= bound[i]``; the last bound is pinned
to 1 so rounding in the cumulative sum can never drop rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols, require
from recoflow.functions.hashing import hash_key, hash_uniform
from recoflow.operators.clean import min_rating_filter
from recoflow.operators.ordering import global_rank, hex_digits, number_digits, rank_within, time_digits

SPLIT = "split"


def split_bounds(ratio) -> list[float]:
    """Upper bounds of the parts: one share in (0, 1) makes two parts, positive weights one part each.

    The last bound is 1 exactly.
    """
    if isinstance(ratio, bool) or not isinstance(ratio, (float, list, tuple)):
        raise TypeError(f"a share or a list of weights is needed, not {type(ratio).__name__}")
    weights = [ratio, 1 - ratio] if isinstance(ratio, float) else [float(w) for w in ratio]
    if not weights or min(weights) <= 0:
        raise ValueError(f"every part needs a positive share: {ratio!r}")
    whole = math.fsum(weights)
    running = [b if whole == 1 else b / whole for b in accumulate(weights)]
    return [*running[:-1], 1.0]


def _case(frac: Column, bounds: list[float], upper_inclusive: bool = True) -> Column:
    expr = None
    for i, b in enumerate(bounds[:-1]):
        cond = frac <= F.lit(b) if upper_inclusive else frac < F.lit(b)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    last = len(bounds) - 1
    return (expr.otherwise(last) if expr is not None else F.lit(last)).cast("int")


def parts(tagged: DataFrame, n: int) -> list[DataFrame]:
    return [tagged.where(F.col(SPLIT) == i).drop(SPLIT) for i in range(n)]


def random_split(df: DataFrame, ratio=0.75, seed: int = 42, cols: Cols = DEFAULT) -> DataFrame:
    """Row-wise split by an md5-derived uniform number: layout independent."""
    require(df, cols.user, cols.item)
    u = hash_uniform(seed, cols.user, cols.item)
    return df.withColumn(SPLIT, _case(u, split_bounds(ratio), upper_inclusive=False))


def _stratified(df: DataFrame, ratio, by: str, order: list, bucket: list[Column]) -> DataFrame:
    bounds = split_bounds(ratio)
    ranked = rank_within(df, [by], order, bucket)
    frac = F.col("_rn") / F.col("_cnt")
    return ranked.withColumn(SPLIT, _case(frac, bounds)).drop("_rn", "_cnt")


def stratified_split(df: DataFrame, ratio=0.75, min_rating: int = 1, filter_by: str = "user",
                     seed: int = 42, cols: Cols = DEFAULT) -> DataFrame:
    """Per user (or item), random order, cut by cumulative ratio."""
    if filter_by not in ("user", "item"):
        raise ValueError(f"rows are split per 'user' or per 'item', not per {filter_by!r}")
    require(df, cols.user, cols.item)
    if min_rating > 1:
        df = min_rating_filter(df, min_rating, filter_by, cols)
    by = cols.user if filter_by == "user" else cols.item
    key = hash_key(seed, cols.user, cols.item)
    return _stratified(df.withColumn("_hk", key), ratio, by, ["_hk", cols.item], hex_digits("_hk")).drop("_hk")


def chrono_split(df: DataFrame, ratio=0.75, min_rating: int = 1, filter_by: str = "user",
                 cols: Cols = DEFAULT, bucket_seconds: int = 86400) -> DataFrame:
    """Per user (or item), in time order (ties by item), cut by cumulative ratio."""
    if filter_by not in ("user", "item"):
        raise ValueError(f"rows are split per 'user' or per 'item', not per {filter_by!r}")
    require(df, cols.user, cols.item, cols.timestamp)
    if min_rating > 1:
        df = min_rating_filter(df, min_rating, filter_by, cols)
    by = cols.user if filter_by == "user" else cols.item
    other = cols.item if by == cols.user else cols.user
    digits = time_digits(cols.timestamp, bucket_seconds) + number_digits(df, other)
    return _stratified(df, ratio, by, [cols.timestamp, other], digits)


def timestamp_split(df: DataFrame, ratio=0.75, cols: Cols = DEFAULT) -> DataFrame:
    """Global time cut over all rows (order ts, user, item), exact rank, no single-task window."""
    require(df, cols.user, cols.item, cols.timestamp)
    bounds = split_bounds(ratio)
    ranked = global_rank(df, [cols.timestamp, cols.user, cols.item], total_col="_n")
    frac = F.col("_grank") / F.col("_n")
    return ranked.withColumn(SPLIT, _case(frac, bounds)).drop("_grank", "_n")


def ratio_split_rows(df: DataFrame, ratio, order: list[str]) -> DataFrame:
    """pandas-style cut of one ordered frame at ``round(cum_ratio * n)`` (half to even)."""
    bounds = split_bounds(ratio)
    out = global_rank(df, order, total_col="_n")
    expr = None
    for i, b in enumerate(bounds[:-1]):
        cond = F.col("_grank") <= F.bround(F.lit(b) * F.col("_n"), 0)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    last = len(bounds) - 1
    split = expr.otherwise(last) if expr is not None else F.lit(last)
    return out.withColumn(SPLIT, split.cast("int")).drop("_grank", "_n")


def per_user_holdout(df: DataFrame, test_pct: float = 20.0, seed: int = 42,
                     cols: Cols = DEFAULT) -> DataFrame:
    """Per user, ``round(n_rated * pct / 100)`` random ratings go to test (split 1)."""
    key = hash_key(seed, cols.user, cols.item)
    ranked = rank_within(df.withColumn("_hk", key), [cols.user], ["_hk", cols.item], hex_digits("_hk"))
    n_test = F.bround(F.col("_cnt") * F.lit(test_pct) / 100.0, 0)
    return (ranked.withColumn(SPLIT, F.when(F.col("_rn") <= n_test, 1).otherwise(0).cast("int"))
            .drop("_rn", "_cnt", "_hk"))


def leave_last_two(df: DataFrame, cols: Cols = DEFAULT, bucket_seconds: int = 86400,
                   order: list[str] | None = None) -> DataFrame:
    """Per user in time order: last → test (2), last-but-one → valid (1), rest → train (0).

    ``order`` is the full sort key (default: timestamp, item); it must start with the timestamp."""
    order = order or [cols.timestamp, cols.item]
    digits = time_digits(cols.timestamp, bucket_seconds) + [d for c in order[1:2] for d in number_digits(df, c)]
    ranked = rank_within(df, [cols.user], order, digits)
    back = F.col("_cnt") - F.col("_rn")
    return (ranked.withColumn(SPLIT, F.when(back == 0, 2).when(back == 1, 1).otherwise(0).cast("int"))
            .drop("_rn", "_cnt"))
