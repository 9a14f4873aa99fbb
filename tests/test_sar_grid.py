"""SAR top-k: sums are made where a block of users meets all similarities to a part of the items."""

import random

import pytest
from pyspark.sql import functions as F

from recoflow.operators import sar
from recoflow.operators.topk import topk_items

pytestmark = pytest.mark.filterwarnings("ignore")


def _plain(aff, sim, k, digits):
    """Partial sums per (user, item), shuffled; then seen ones are taken out."""
    s = sar.score(aff, sim).join(aff.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return topk_items(s.select("user_id", "item_id", F.round("score", digits).alias("prediction")), k)


def _rows(df):
    return sorted(((r.user_id, r.item_id, None if r.prediction is None else round(r.prediction, 5)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("item", ["bigint", "string"])
def test_grid_gives_the_rows_of_the_join(spark, monkeypatch, item):
    rng = random.Random(3)
    name = (lambda i: f"i{i}") if item == "string" else int
    rows = list({(u if u else None, name(int(rng.random() ** 2 * 60))): 0 for u in range(40) for _ in range(1 + u % 13)})
    values = [1.0, 2.0, 0.0, None, -1.0]
    aff = spark.createDataFrame([(u, i, rng.choice(values)) for u, i in rows], f"user_id bigint, item_id {item}, affinity double")
    aff = aff.unionByName(spark.createDataFrame([(5, None, 1.0)], aff.schema))
    sim = sar.similarity(sar.cooccurrence(aff, frequencies=True))
    monkeypatch.setattr(sar, "GRID_SIM", 200)  # several parts and blocks
    monkeypatch.setattr(sar, "GRID_ROWS", 100)
    monkeypatch.setattr(sar, "GRID_TERMS", 50)
    got = sar.top_scores(aff, sim, 4, True, 6)
    assert _rows(got) == _rows(_plain(aff.where("item_id IS NOT NULL"), sim, 4, 6))


def test_no_partial_sum_per_user_and_item_is_shuffled(spark):
    train = spark.createDataFrame([(u, i, 1.0, 0) for u in range(30) for i in range(u % 7, 20, 1 + u % 3)],
                                  "user_id int, item_id int, rating double, ts bigint")
    sim = sar.similarity(sar.cooccurrence(train, frequencies=True))
    plan = sar.recommend(train, sim, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan
