"""Shared fixture plans for the catalogue (train/test, top-k predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.session import written
from recoflow.sources import fixtures as fx
from recoflow.sources.tables import Tables

K = 10


def T(spark: SparkSession, sf: str) -> Tables:
    return Tables(spark, sf)


def rnd(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# train / test used by the metric and model queries: chronological 75/25 per user
def train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from recoflow.operators.splits import chrono_split, parts
    # the ratings are read twice by the split, its rows by every use of train and test: each is made once
    tagged = written(chrono_split(written(fx.ratings(T(spark, sf)), "ratings"), 0.75), "train-test")
    train, test = parts(tagged, 2)
    return train, test


SQL_TRAIN_TEST = (
    ("_chrono", """SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS DOUBLE)
        / count(*) OVER (PARTITION BY user_id) AS _f FROM ratings"""),
    ("train", "SELECT user_id, item_id, rating, ts FROM _chrono WHERE _f <= 0.75"),
    ("test", "SELECT user_id, item_id, rating, ts FROM _chrono WHERE _f > 0.75"),
)

# the mean rating of train as a one-row table
TRAIN_MEAN = ("m", "SELECT avg(rating) AS mean FROM train")
