"""Tables are dealt into tasks of a bounded number of rows, and small groups are ranked without being cut."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from recoflow import session
from recoflow.operators import metrics as m
from recoflow.operators.candidates import impression_negatives
from recoflow.operators.ordering import number_digits, rank_within
from recoflow.sources import fixtures as fx


class _Orders:
    """4,000 orders of 3 lines; every 50th order has no date and every 70th line no order."""

    def __init__(self, spark):
        n = spark.range(4000)
        self.orders = n.select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"),
                               F.when(F.col("id") % 50 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int"))).alias("o_orderdate"))
        li = spark.range(12000)
        self.lineitem = li.select(F.when(F.col("id") % 70 != 0, F.floor(F.col("id") / 3)).alias("l_orderkey"), (F.col("id") % 37).alias("l_partkey"),
                                  F.when(F.col("id") % 3 == 1, "R").otherwise("N").alias("l_returnflag"))


def _most(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_a_tasks_rows_do_not_grow_with_the_table(spark, monkeypatch):
    tables = _Orders(spark)
    whole = fx.impressions(tables).collect()
    ranks = m.group_ranks(fx.impressions(tables).withColumn("score", F.col("item_id") * 7 % 11), "imp_id").collect()
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    got = fx.impressions(tables)
    assert _most(got) <= 250 and sorted(got.collect(), key=str) == sorted(whole, key=str)
    ranked = m.group_ranks(got.withColumn("score", F.col("item_id") * 7 % 11), "imp_id")
    assert _most(ranked) <= 250 and sorted(ranked.collect(), key=str) == sorted(ranks, key=str)


def test_negatives_in_bounded_tasks(spark, monkeypatch):
    imps = fx.impressions(_Orders(spark))
    for padded in (False, True):
        before = sorted(impression_negatives(imps, 2, padded=padded).collect(), key=str)
        with monkeypatch.context() as patch:
            patch.setattr(session, "ROWS_A_TASK", 100)
            got = impression_negatives(imps, 2, padded=padded)
            assert _most(got) <= 250 and sorted(got.collect(), key=str) == before


def test_small_groups_are_ranked_without_offsets(spark):
    df = spark.range(500).select(F.when(F.col("id") % 9 != 0, F.col("id") % 20).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 100).alias("x"), "id")
    order = ["x", "id"]
    got = rank_within(df, ["g"], order, number_digits(df, "x", 4) + number_digits(df, "id", 4))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    w = Window.partitionBy("g")
    ref = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_cnt", F.count(F.lit(1)).over(w))
    assert sorted(got.select(ref.columns).collect(), key=str) == sorted(ref.collect(), key=str)
