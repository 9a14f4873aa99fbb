"""Per-group top-k.

``row_number() <= k`` over a window is planned by Spark as a
``WindowGroupLimit``: each map task keeps only k rows per group before the
shuffle, so even a hot user costs O(k) shuffle rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols


def topk_items(df: DataFrame, k: int = 10, cols: Cols = DEFAULT, score: str | None = None,
               rank_col: str | None = None) -> DataFrame:
    """k best items per user by score desc, ties by item asc."""
    score = score or cols.prediction
    w = Window.partitionBy(cols.user).orderBy(F.col(score).desc(), F.col(cols.item).asc())
    out = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    if rank_col:
        return out.withColumnRenamed("_r", rank_col).withColumn(rank_col, F.col(rank_col).cast("bigint"))
    return out.drop("_r")


def popular_topk(df: DataFrame, k: int = 10, cols: Cols = DEFAULT) -> DataFrame:
    """The k items with most distinct users (the co-occurrence diagonal); ties by item."""
    pop = (df.select(cols.user, cols.item).distinct()
           .groupBy(cols.item).agg(F.count(F.lit(1)).alias("n_users")))
    return pop.orderBy(F.col("n_users").desc(), F.col(cols.item).asc()).limit(k)
