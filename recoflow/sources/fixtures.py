"""Stand-in views over the TPC-H-like tables (see FIXTURES.md).

Each view exists twice: as a DataFrame plan (what the operators consume) and
as SQL text (what the independent oracle runs). Both must give equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.functions.arrays import epoch_seconds
from recoflow.session import dealt
from recoflow.sources.tables import Tables


def ratings(t: Tables) -> DataFrame:
    """(user_id, item_id, rating, ts): one row per (customer, part)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    return (o.join(li, o.o_orderkey == li.l_orderkey)
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
            .agg((1 + F.max("l_quantity") % 5).cast("double").alias("rating"),
                 F.max(epoch_seconds("o_orderdate")).alias("ts")))


def predictions(t: Tables, base: DataFrame | None = None) -> DataFrame:
    r = base if base is not None else ratings(t)
    return r.select("user_id", "item_id",
                    (1 + ((F.col("user_id") * 7919 + F.col("item_id") * 104729) % 997).cast("double") / 249)
                    .alias("prediction"))


def impressions(t: Tables) -> DataFrame:
    """(imp_id, user_id, item_id, label, ts): one row per item of an order; an order's rows lie in one of many tasks of bounded size."""
    rows = t.lineitem.count()  # from the files' footers
    o = dealt(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), rows, "o_orderkey")
    li = dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag"), rows, "l_orderkey")
    return (o.join(li, o.o_orderkey == li.l_orderkey)
            .groupBy(F.col("o_orderkey").alias("imp_id"), F.col("o_custkey").alias("user_id"),
                     F.col("l_partkey").alias("item_id"))
            .agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"),
                 F.max(epoch_seconds("o_orderdate")).alias("ts")))


def items(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
                         F.col("p_brand").alias("genre"), F.col("p_type").alias("category"))


def ctr(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("row_id"),
                           F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
                           F.col("user_id").cast("string").alias("cat_user"),
                           F.col("props").alias("cat_props"),
                           F.col("value").alias("num_value"))


def docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", "lang", "source")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("item_id"),
                               F.col("embedding").alias("features"))


# ---------------------------------------------------------------- SQL text
EP = "CAST(epoch(o_orderdate) AS BIGINT)"

SQL_VIEWS = {
    "ratings": f"""SELECT o_custkey AS user_id, l_partkey AS item_id,
       CAST(1 + MAX(l_quantity) % 5 AS DOUBLE) AS rating, MAX({EP}) AS ts
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey""",
    "predictions": """SELECT user_id, item_id,
       1 + CAST((user_id * 7919 + item_id * 104729) % 997 AS DOUBLE) / 249 AS prediction FROM ratings""",
    "impressions": f"""SELECT o_orderkey AS imp_id, o_custkey AS user_id, l_partkey AS item_id,
       MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, MAX({EP}) AS ts
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, l_partkey""",
    "items": "SELECT p_partkey AS item_id, p_name AS title, p_brand AS genre, p_type AS category FROM part",
    "ctr": """SELECT event_id AS row_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
       CAST(user_id AS VARCHAR) AS cat_user, props AS cat_props, value AS num_value FROM events""",
    "docs": "SELECT doc_id, text, lang, source FROM documents",
    "vectors": "SELECT vec_id AS item_id, embedding AS features FROM embeddings",
}
_DEPS = {"predictions": ["ratings"]}
_ORDER = list(SQL_VIEWS)


def with_views(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the fixture CTEs it mentions (plus ``extra`` named CTEs)."""
    text = body + " ".join(s for _, s in extra)
    need: set[str] = set()
    for name in _ORDER:
        if re.search(rf"\b{name}\b", text):
            need.add(name)
    for name in list(need):
        need.update(_DEPS.get(name, []))
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in _ORDER if n in need]
    ctes += [f"{n} AS ({s})" for n, s in extra]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
