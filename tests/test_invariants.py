"""Invariants and golden micro-cases."""

import pytest
from pyspark.sql import functions as F

from recoflow.operators import metrics as m
from recoflow.operators import splits as sp
from recoflow.operators.pairs import item_pair_counts
from recoflow.sources import fixtures as fx
from recoflow.sources.tables import Tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def ratings(spark):
    return fx.ratings(Tables(spark, SF_SMALL)).cache()


def test_split_ratio_rounding_keeps_all_rows():
    assert sp.split_bounds([0.7, 0.2, 0.1])[-1] == 1.0
    assert sp.split_bounds([2, 1, 1]) == [0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        sp.split_bounds(1.5)


@pytest.mark.parametrize("fn", [
    lambda d: sp.random_split(d, [0.7, 0.2, 0.1]),
    lambda d: sp.stratified_split(d, [0.7, 0.2, 0.1]),
    lambda d: sp.chrono_split(d, [0.7, 0.2, 0.1]),
    lambda d: sp.timestamp_split(d, [0.7, 0.2, 0.1]),
])
def test_splits_disjoint_and_complete(ratings, fn):
    tagged = fn(ratings)
    parts = sp.parts(tagged, 3)
    total = sum(p.count() for p in parts)
    assert total == ratings.count()
    assert tagged.select("user_id", "item_id").distinct().count() == total


def test_pair_counter_block_split_is_exact(ratings):
    """Hot users cut into blocks (tiny block size) give exactly the same counts."""
    a = item_pair_counts(ratings, block_size=4096)
    b = item_pair_counts(ratings, block_size=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rank_within_matches_window(spark, ratings):
    from pyspark.sql import Window
    from recoflow.operators.ordering import rank_within
    r = rank_within(ratings, ["user_id"], ["ts", "item_id"], F.floor(F.col("ts") / 86400))
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    ref = ratings.withColumn("_ref", F.row_number().over(w))
    j = r.join(ref, ["user_id", "item_id"])
    assert j.where(F.col("_rn") != F.col("_ref")).count() == 0


def test_layout_independence(spark, ratings):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    outs = []
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outs.append(sorted(sp.stratified_split(ratings, 0.75).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert outs[0] == outs[1] == outs[2]


def test_ranking_metrics_golden(spark):
    # 1 user, truth {1,2,3}; predicted order 1,4,2 (k=3): hits at ranks 1 and 3
    truth = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "user_id long, item_id long")
    pred = spark.createDataFrame([(1, 1, 0.9), (1, 4, 0.8), (1, 2, 0.7)], "user_id long, item_id long, prediction double")
    hits = m.ranking_hits(m.relevant_topk(pred, 3), truth)
    r = m.ranking_metrics(hits, 3).first()
    import math
    assert r.precision_at_k == pytest.approx(2 / 3)
    assert r.recall_at_k == pytest.approx(2 / 3)
    assert r.map_at_k == pytest.approx((1 / 1 + 2 / 3) / 3)
    idcg = 1 / math.log(2) + 1 / math.log(3) + 1 / math.log(4)
    assert r.ndcg_at_k == pytest.approx((1 / math.log(2) + 1 / math.log(4)) / idcg)


# ---- rows that must not be lost, and ids of any kind

RATING = "user_id {}, item_id {}, rating double, ts long"


def test_splitters_keep_rows_with_nulls(spark):
    rows = [(1, 1, 3.0, 10), (1, 2, 4.0, None), (None, 3, 5.0, 20), (2, 4, 1.0, 5), (None, None, 1.0, None)]
    df = spark.createDataFrame(rows, RATING.format("long", "long"))
    for tagged in (sp.stratified_split(df, 0.5), sp.chrono_split(df, 0.5), sp.chrono_split(df, 0.5, filter_by="item"),
                   sp.per_user_holdout(df, 50.0), sp.leave_last_two(df)):
        assert sorted(map(tuple, tagged.select(df.columns).collect()), key=repr) == sorted(rows, key=repr)


def test_clicks_without_negatives_are_padded(spark):
    from recoflow.operators.candidates import impression_negatives
    imps = spark.createDataFrame([(1, 7, 100, 1), (2, 7, 100, 1), (2, 7, 101, 0)], "imp_id long, user_id long, item_id long, label int")
    got = impression_negatives(imps, 3, padded=True).orderBy("imp_id", "slot").collect()
    assert [(r.imp_id, r.neg_item) for r in got] == [(1, 0)] * 3 + [(2, 101), (2, 0), (2, 0)]


def test_readers_keep_everything(spark, tmp_path):
    from recoflow.sources import readers as rd
    from recoflow.sources import writers as wr
    (tmp_path / "items").write_text("1|A (1999)|" + "|".join(f"g{i}" for i in range(1500)) + "\n2|B\n")
    got = {r.item_id: r.genres for r in rd.read_items(spark, str(tmp_path / "items")).collect()}
    assert len(got[1]) == 1500 and got[2] == []
    (tmp_path / "ratings").write_text("3000000000\t1\t4.5\t100\n")
    assert rd.read_ratings(spark, str(tmp_path / "ratings")).first().user_id == 3_000_000_000
    (tmp_path / "bad").write_text("x\t1\t4.5\t100\n")
    with pytest.raises(Exception):
        rd.read_ratings(spark, str(tmp_path / "bad")).collect()
    df = spark.createDataFrame([(1, 1, "a", 2.5), (2, 0, None, 1.0), (3, 0, "b", None)], "id long, y int, c string, x double")
    lines = {r.id: r.line for r in wr.to_libffm(df, "y", ["c", "x"], "id").collect()}
    assert lines == {1: "1 1:1:1 2:3:2.5", 2: "0 2:3:1.0", 3: "0 1:2:1"}


def test_string_ids(spark):
    from recoflow.operators import candidates as cd
    rows = [(f"u{u}", f"item{i}") for u in range(4) for i in range(10) if (u + i) % 3 or u == 0]
    df = spark.createDataFrame(rows, "user_id string, item_id string")
    seen = set(rows)
    got = cd.train_negatives(df, 2).collect()
    assert {(r.user_id, r.item_id) for r in got} == {p for p in rows if p[0] != "u0"}  # u0 has seen all; others are not affected
    assert all((r.user_id, r.neg_item) not in seen for r in got)
    neg = [r for r in cd.negative_sample(df).collect() if r.feedback == 0]
    assert neg and all((r.user_id, r.item_id) not in seen for r in neg)


def test_als_takes_large_ids_and_recommends_k_unseen(spark, ratings):
    from recoflow.operators import factors as fa
    big = ratings.selectExpr("user_id + 3000000000 AS user_id", "concat('i', item_id) AS item_id", "rating", "ts")
    fit = fa.als_fit(big, rank=5, max_iter=5)
    reco = fa.als_recommend(fit, big, 5)
    assert reco.groupBy("user_id").count().where("count <> 5").count() == 0
    assert reco.count() == 5 * big.select("user_id").distinct().count()
    assert reco.join(big, ["user_id", "item_id"]).count() == 0
    data = big.join(fit.users, "user_id").join(fit.items, "item_id").selectExpr("cast(_u AS int) _u", "cast(_i AS int) _i", "rating")
    err, spread = fit.model.transform(data).selectExpr("sqrt(avg(pow(rating - prediction, 2)))", "stddev_pop(rating)").first()
    assert err < spread


def test_unknown_user_stops_sar_predict(spark, ratings):
    from recoflow.operators import sar
    sim = sar.similarity(sar.cooccurrence(ratings))
    asked = spark.createDataFrame([(-1, 1)], "user_id long, item_id long")
    with pytest.raises(Exception, match="no training data for user -1"):
        sar.predict(ratings, sim, asked).collect()


def test_hot_items_are_split_without_change(ratings, monkeypatch):
    from recoflow.operators import sar
    sim = sar.similarity(sar.cooccurrence(ratings))
    want = {(r.user_id, r.item_id): r.score for r in sar.score(sar.affinity(ratings), sim).collect()}
    monkeypatch.setattr(sar, "HOT_USERS", 3)
    got = {(r.user_id, r.item_id): r.score for r in sar.score(sar.affinity(ratings), sim).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_needed_pairs_equal_the_whole_matrix(spark, ratings):
    from recoflow.operators.diversity import cooccurrence_cosine
    whole = {(r.i1, r.i2): r.sim for r in cooccurrence_cosine(ratings).collect()}
    asked = spark.createDataFrame([(a, b) for a, b in list(whole)[::7]] + [(1, 10**9)], "i1 long, i2 long")
    got = {(r.i1, r.i2): r.sim for r in cooccurrence_cosine(ratings, pairs=asked).collect()}
    assert got == pytest.approx({k: whole[k] for k in list(whole)[::7]})
