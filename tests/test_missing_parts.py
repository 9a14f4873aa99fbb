"""Zero-filled lists, vocabulary lookups under skew, and inputs that are refused."""

import pytest
from pyspark.sql import functions as F

from recoflow.operators import clean as cl
from recoflow.operators import metrics as m
from recoflow.operators import sar
from recoflow.sources import readers as rd
from recoflow.sources import writers as wr


def test_least_free_against_plain_sets(spark):
    catalogue = list(range(3, 60, 3))
    taken = {1: {3, 6, 9, 12}, 2: set(), 3: {6, 57}, 4: set(catalogue), 5: set(catalogue) - {30, 57}, 6: {3, 9, 15, 21, 27}}
    needs = [(1, 2), (2, 5), (3, 19), (4, 3), (5, 4), (6, 6)]
    got = sar.least_free(spark.createDataFrame(needs, "user_id int, _need int"),
                         spark.createDataFrame([(u, i) for u, s in taken.items() for i in s], "user_id int, item_id int"),
                         spark.createDataFrame([(i,) for i in catalogue], "item_id int"))
    want = {(u, i) for u, n in needs for i in [c for c in catalogue if c not in taken[u]][:n]}
    assert {tuple(r) for r in got.collect()} == want


def test_every_user_gets_k_when_filled(spark):
    rows = [(1, 1, 5.0, 1), (1, 2, 4.0, 2), (2, 2, 3.0, 1), (2, 3, 3.0, 2), (3, 9, 1.0, 1)] + [(4, i, 2.0, i) for i in range(20, 40)]
    train = spark.createDataFrame(rows, "user_id int, item_id int, rating double, ts long")
    sim = sar.similarity(sar.cooccurrence(train))
    plain = sar.recommend(train, sim, 4)
    full = sar.recommend(train, sim, 4, fill_zero=True)
    n = {r["user_id"]: r["count"] for r in full.groupBy("user_id").count().collect()}
    assert n == {1: 4, 2: 4, 3: 4, 4: 4}
    lists = {}
    for r in full.collect():
        lists.setdefault(r["user_id"], {})[r["item_id"]] = r["prediction"]
    assert lists[3] == {1: 0.0, 2: 0.0, 3: 0.0, 20: 0.0}  # nothing scored: the least unseen ids
    assert set(lists[1]) == {3, 9, 20, 21} and lists[1][3] > 0
    assert plain.join(full, ["user_id", "item_id", "prediction"], "left_anti").count() == 0


def _sequence_lines(n):
    """n lines; item 'hot' holds a third of all places and more; equal lines and unlisted words among them."""
    for i in range(n):
        items = ["hot" if (i + j) % 3 else f"i{j * i % 50}" for j in range(1 + i % 6)]
        cates = [f"c{j % 3}" for j in range(len(items))]
        yield "\t".join([str(i % 2), f"u{i % 9}", items[0], cates[-1], str(1000 + i % 7), ",".join(items), ",".join(cates), ",".join("7" for _ in items)])


def test_vocabulary_lookup_with_a_hot_word(spark, tmp_path):
    lines = list(_sequence_lines(200)) + ["1\tu1\tnone\tnone\t5\t\t\t"] + list(_sequence_lines(40))
    path = str(tmp_path / "seq")
    wr.write_lines(spark.createDataFrame([(x,) for x in lines], "value string"), path)
    items = {"hot": 1, **{f"i{k}": k + 2 for k in range(0, 50, 2)}}
    cates, users = {"c0": 1, "c2": 2}, {f"u{k}": k + 1 for k in range(5)}
    tables = [spark.createDataFrame(list(v.items()), "word string, idx long") for v in (users, items, cates)]
    got = rd.read_sequences(spark, path, *tables).collect()
    want = []
    for x in lines:
        w = x.split("\t")
        want.append((int(w[0]), users.get(w[1], 0), items.get(w[2], 0), cates.get(w[3], 0), [items.get(i, 0) for i in w[5].split(",")],
                     [cates.get(c, 0) for c in w[6].split(",")]))
    keys = ("label", "user_idx", "item_idx", "cate_idx", "item_history_idx", "cate_history_idx")
    assert sorted(tuple(r[k] for k in keys) for r in got) == sorted(want)
    assert rd.read_sequences(spark, path).count() == len(lines)


def test_only_frequent_words_are_broadcast(spark):
    words = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id") % 900)).alias("word"))
    vocabulary = spark.createDataFrame([("hot", 1)] + [(f"w{i}", i + 2) for i in range(500)], "word string, idx long")
    got = rd.vocabulary_lookup(words, vocabulary, ["word"], "idx", heavy=16)
    assert got.count() == 3000 and got.where("word = 'hot' AND idx = 1").count() == 1000
    assert got.where("word <> 'hot'").join(vocabulary, ["word", "idx"], "left_anti").where("idx IS NOT NULL").count() == 0


def test_refused_inputs(spark):
    truth = spark.createDataFrame([(1, 2, 3.0)], "user_id int, item_id int, rating double")
    pred = spark.createDataFrame([(1, 2, 3.5)], "user_id long, item_id int, prediction float")
    cl.check_inputs(truth, pred)  # widths may differ
    with pytest.raises(ValueError, match="truth has no rows"):
        cl.check_inputs(truth.where("false"), pred)
    with pytest.raises(ValueError, match="prediction has no rows"):
        m.rating_pairs(truth, pred.where("false"), strict=True)
    with pytest.raises(TypeError, match="user_id is int in the truth and string"):
        cl.check_inputs(truth, pred.withColumn("user_id", F.col("user_id").cast("string")))
    with pytest.raises(TypeError, match="not a number"):
        cl.check_inputs(truth.withColumn("rating", F.lit("good")), pred)
    with pytest.raises(ValueError, match="lacks prediction"):
        cl.check_inputs(truth, pred.drop("prediction"))


def test_report_counts_and_raises(spark):
    rows = [(1, 10, 3.0), (1, 10, 3.0), (2, None, 4.5), (None, 11, None), (70000, -5, 3.0)]
    df = spark.createDataFrame(rows, "user_id int, item_id long, rating double")
    got = {r["column"]: (r["rows"], r["nulls"], r["distinct_values"], r["dup_keys"]) for r in cl.contract_report(df).collect()}
    assert got == {"user_id": (5, 1, 3, 1), "item_id": (5, 1, 3, 1), "rating": (5, 1, 2, 1)}
    plan = cl.contract_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "bitmap_construct_agg" in plan
    with pytest.raises(ValueError, match="no rows"):
        cl.contract_report(df.where("false"), strict=True)
    with pytest.raises(TypeError, match="rating is double"):
        cl.contract_report(df, other=df.withColumn("rating", F.lit("x")), strict=True)
    assert cl.contract_report(df.where("false")).where("distinct_values = 0").count() == 3
