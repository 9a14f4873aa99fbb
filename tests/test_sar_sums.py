"""All scores: whole sums are made where a block of users meets a part of the items."""

import pytest
from pyspark.sql import functions as F

from recoflow.operators import sar


def _train(spark):
    n = spark.range(2500)
    return n.select(F.when(F.col("id") % 61 != 0, F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 37)).cast("bigint").alias("user_id"),
                    F.when(F.col("id") % 59 != 0, F.when(F.col("id") % 5 == 0, 2).otherwise(F.col("id") * 13 % 71)).cast("bigint").alias("item_id"),
                    (F.col("id") % 5 + 1).cast("double").alias("rating"), (F.col("id") * 86400).alias("ts")).dropDuplicates(["user_id", "item_id"])


def _joined(aff, sim, *values):
    left = aff.withColumnRenamed("item_id", "src")
    return left.join(sar.symmetric(sim), "src").groupBy("user_id", F.col("dst").alias("item_id")).agg(
        *(F.sum(F.col(v) * F.col("sim")).alias(v) for v in values))


def _near(got, want):
    got, want = ({(r["user_id"], r["item_id"]): r[2] for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())


@pytest.mark.parametrize("out,terms,hot", [(1 << 22, 1 << 21, 4096), (100, 50, 3)])
def test_sums_equal_the_join(spark, monkeypatch, out, terms, hot):
    for name, value in (("GRID_OUT", out), ("GRID_TERMS", terms), ("HOT_USERS", hot)):
        monkeypatch.setattr(sar, name, value)
    train = _train(spark)
    aff = sar.affinity(train).withColumn("affinity", F.when(F.col("item_id") % 6 != 0, F.col("affinity") - 3))  # nulls, zeros, less than zero
    sim = sar.similarity(sar.cooccurrence(train, frequencies=True))
    _near(sar.score(aff, sim), _joined(aff, sim, "affinity"))
    aff = sar.affinity(train).withColumn("_one", F.lit(1.0))
    low, high, n = aff.agg(F.min("affinity"), F.max("affinity"), F.countDistinct("item_id")).first()
    both = _joined(aff, sim, "affinity", "_one")
    ends = both.groupBy("user_id").agg(F.min("_one").alias("a"), F.max("_one").alias("b"), F.count(F.lit(1)).alias("c"))
    lo, hi = F.when(F.col("c") < n, 0.0).otherwise(F.col("a")) * low, F.col("b") * high
    want = both.join(ends, "user_id").select("user_id", "item_id", ((F.col("affinity") - lo) / (hi - lo) * (high - low) + low).alias("score"))
    _near(sar.score_normalized(train, sim), want)


def test_no_partial_sums_move(spark):
    train = _train(spark)
    plan = sar.score(sar.affinity(train), sar.similarity(sar.cooccurrence(train)))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan.split("\n")[0] and "Aggregate" not in plan
