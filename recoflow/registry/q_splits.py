"""Splitters over the ``ratings`` view."""

from pyspark.sql import functions as F

from recoflow.functions.hashing import sql_hash_key, sql_hash_uniform
from recoflow.operators import splits as sp
from recoflow.operators.clean import min_rating_filter
from recoflow.registry import register
from recoflow.registry.common import T
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

OUT = ["user_id", "item_id", "split"]


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _sql_case(frac: str, bounds, op: str = "<=") -> str:
    whens = " ".join(f"WHEN {frac} {op} {_dbl(b)} THEN {i}" for i, b in enumerate(bounds[:-1]))
    return f"CAST(CASE {whens} ELSE {len(bounds) - 1} END AS INTEGER)"


R3 = [0.7, 0.2, 0.1]


@register("random_split", with_views(
    f"SELECT user_id, item_id, {_sql_case(sql_hash_uniform(42, 'user_id', 'item_id'), sp.split_bounds(R3), '<')} "
    "AS split FROM ratings"))
def q_random_split(spark, sf):
    return sp.random_split(fx.ratings(T(spark, sf)), R3, seed=42).select(*OUT)


_STRAT_FRAC = (f"CAST(row_number() OVER (PARTITION BY user_id ORDER BY {sql_hash_key(42, 'user_id', 'item_id')}, "
               "item_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id)")


@register("stratified_split", with_views(
    f"SELECT user_id, item_id, {_sql_case('_f', sp.split_bounds(R3))} AS split FROM "
    f"(SELECT user_id, item_id, {_STRAT_FRAC} AS _f FROM ratings)"))
def q_stratified_split(spark, sf):
    return sp.stratified_split(fx.ratings(T(spark, sf)), R3, seed=42).select(*OUT)


@register("chrono_split", with_views(
    f"SELECT user_id, item_id, {_sql_case('_f', sp.split_bounds(0.75))} AS split FROM "
    "(SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS DOUBLE)"
    " / count(*) OVER (PARTITION BY user_id) AS _f FROM ratings)"))
def q_chrono_split(spark, sf):
    return sp.chrono_split(fx.ratings(T(spark, sf)), 0.75).select(*OUT)


@register("chrono_split_by_item", with_views(
    f"SELECT user_id, item_id, {_sql_case('_f', sp.split_bounds(0.8))} AS split FROM "
    "(SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY ts, user_id) AS DOUBLE)"
    " / count(*) OVER (PARTITION BY item_id) AS _f FROM ratings "
    " WHERE item_id IN (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= 20))"))
def q_chrono_split_item(spark, sf):
    return sp.chrono_split(fx.ratings(T(spark, sf)), 0.8, min_rating=20, filter_by="item").select(*OUT)


@register("timestamp_split", with_views(
    f"SELECT user_id, item_id, {_sql_case('_f', sp.split_bounds(0.75))} AS split FROM "
    "(SELECT user_id, item_id, CAST(row_number() OVER (ORDER BY ts, user_id, item_id) AS DOUBLE)"
    " / count(*) OVER () AS _f FROM ratings)"))
def q_timestamp_split(spark, sf):
    return sp.timestamp_split(fx.ratings(T(spark, sf)), 0.75).select(*OUT)


def _ratio_rows_sql(bounds):
    whens = " ".join(f"WHEN _r <= round_even({_dbl(b)} * _n, 0) THEN {i}" for i, b in enumerate(bounds[:-1]))
    return (f"SELECT user_id, item_id, CAST(CASE {whens} ELSE {len(bounds) - 1} END AS INTEGER) AS split FROM "
            "(SELECT user_id, item_id, row_number() OVER (ORDER BY ts, user_id, item_id) AS _r, "
            "count(*) OVER () AS _n FROM ratings)")


@register("ratio_split_rows", with_views(_ratio_rows_sql(sp.split_bounds(R3))))
def q_ratio_split_rows(spark, sf):
    return sp.ratio_split_rows(fx.ratings(T(spark, sf)), R3, ["ts", "user_id", "item_id"]).select(*OUT)


@register("per_user_holdout", with_views(
    "SELECT user_id, item_id, CAST(CASE WHEN _r <= round_even(_n * 20.0 / 100.0, 0) THEN 1 ELSE 0 END AS INTEGER)"
    " AS split FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY "
    f"{sql_hash_key(42, 'user_id', 'item_id')}, item_id) AS _r, count(*) OVER (PARTITION BY user_id) AS _n "
    "FROM ratings)"))
def q_per_user_holdout(spark, sf):
    return sp.per_user_holdout(fx.ratings(T(spark, sf)), 20.0, seed=42).select(*OUT)


@register("leave_last_two", with_views(
    "SELECT user_id, item_id, CAST(CASE WHEN _n - _r = 0 THEN 2 WHEN _n - _r = 1 THEN 1 ELSE 0 END AS INTEGER)"
    " AS split FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS _r,"
    " count(*) OVER (PARTITION BY user_id) AS _n FROM ratings)"))
def q_leave_last_two(spark, sf):
    return sp.leave_last_two(fx.ratings(T(spark, sf))).select(*OUT)


@register("min_rating_filter", with_views(
    "SELECT user_id, item_id, rating FROM ratings WHERE user_id IN "
    "(SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= 40)"))
def q_min_rating_filter(spark, sf):
    return min_rating_filter(fx.ratings(T(spark, sf)), 40, "user").select("user_id", "item_id", "rating")


@register("positive_filter", with_views(
    "SELECT user_id, item_id, rating - 3 AS rating FROM ratings WHERE rating - 3 > 0"))
def q_positive_filter(spark, sf):
    from recoflow.operators.clean import positive_filter
    r = fx.ratings(T(spark, sf)).select("user_id", "item_id", (F.col("rating") - 3).alias("rating"))
    return positive_filter(r)
