"""Ranks inside hot groups: buckets over the bound are cut again."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from recoflow.operators import splits as sp
from recoflow.operators.ordering import count_before, cut, number_digits, rank_within, time_digits

DAY = 86400


def _hot(spark):
    """3,000 rows: a third of one user on one day (and one second), null users and times among the others."""
    hot = spark.range(1000).select(F.lit(7).cast("bigint").alias("user_id"), F.col("id").alias("item_id"), F.lit(5 * DAY).cast("bigint").alias("ts"))
    rest = spark.range(2000).select(F.when(F.col("id") % 40 != 0, F.col("id") % 50).alias("user_id"), (F.col("id") + 5000).alias("item_id"),
                                    F.when(F.col("id") % 31 != 0, F.col("id") % 9 * DAY + F.col("id") % 3).cast("bigint").alias("ts"))
    return hot.unionByName(rest)


def _order(df):
    return time_digits("ts") + number_digits(df, "item_id", 8)


def test_no_leaf_above_the_bound(spark):
    df = _hot(spark)
    rows, leaves, path = cut(df, ["user_id"], _order(df), bound=16)
    assert len(path) == 5  # day, minute and second do not cut the hot user, its items do
    assert leaves.agg(F.max("_bc")).first()[0] <= 16 and leaves.agg(F.sum("_bc")).first()[0] == 3000
    sizes = rows.groupBy("user_id", *path).count()
    assert sizes.agg(F.max("count")).first()[0] <= 16 and rows.count() == 3000
    rows, leaves, path = cut(df, ["user_id"], _order(df), bound=4)
    assert len(path) == 6 and leaves.agg(F.max("_bc")).first()[0] <= 4


def test_refined_ranks_equal_one_window(spark):
    df = _hot(spark)
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    ref = df.withColumn("_rn", F.row_number().over(w)).withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    for bound in (3, 100, 1 << 20):
        got = rank_within(df, ["user_id"], ["ts", "item_id"], _order(df), bound=bound).select(ref.columns)
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_refined_counts_equal_one_window(spark):
    df = _hot(spark)
    flag = F.col("item_id") % 3 == 0
    w = Window.partitionBy("user_id").orderBy("ts", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("n", F.coalesce(F.sum(flag.cast("bigint")).over(w), F.lit(0)))
    got = count_before(df, ["user_id"], ["ts", "item_id"], _order(df), flag, "n", bound=5).select(ref.columns)
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_splitters_on_a_hot_day(spark):
    tagged = sp.chrono_split(_hot(spark), 0.75)
    n = {(r["user_id"], r["split"]): r["count"] for r in tagged.groupBy("user_id", "split").count().collect()}
    assert n[(7, 0)] + n[(7, 1)] == 1040 and n[(7, 0)] == 780
    assert tagged.count() == 3000


def test_predict_refuses_an_unknown_user(spark):
    import pytest
    from recoflow.operators import sar
    train = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 4.0, 2), (2, 10, 5.0, 3)], "user_id int, item_id int, rating double, ts long")
    sim = sar.similarity(sar.cooccurrence(train))
    with pytest.raises(Exception, match="no training data for user 9"):
        sar.predict(train, sim, spark.createDataFrame([(9, 10)], "user_id int, item_id int")).collect()


def test_predict_of_busy_users_is_the_same(spark):
    from recoflow.operators import sar
    rows = [(1, i, float(i % 5 + 1), i) for i in range(60)] + [(u, u * 7 % 60, 2.0, u) for u in range(2, 30)] + [(u, u * 11 % 60, 3.0, u) for u in range(2, 30)]
    train = spark.createDataFrame(rows, "user_id int, item_id int, rating double, ts long").dropDuplicates(["user_id", "item_id"])
    sim = sar.similarity(sar.cooccurrence(train)).checkpoint()
    pairs = spark.createDataFrame([(u, i) for u in (1, 2, 9, 20) for i in range(0, 60, 7)], "user_id int, item_id int")
    plain = {(r["user_id"], r["item_id"]): round(r["prediction"], 9) for r in sar.predict(train, sim, pairs).collect()}
    busy = {(r["user_id"], r["item_id"]): round(r["prediction"], 9) for r in sar.predict(train, sim, pairs, busy_items=10).collect()}
    assert plain == busy and any(plain.values())
