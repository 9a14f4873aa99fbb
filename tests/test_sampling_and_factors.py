"""Alias tables, popularity shares, principal components, hubs, and the results table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recoflow.operators import candidates as cd
from recoflow.operators import encode as en
from recoflow.operators import graph as gr
from recoflow.sources import writers as wr


@pytest.mark.parametrize("counts", [[5], [1, 1, 1], [1, 2, 3, 4, 90], [100, 1, 1, 1, 1, 1, 95], [3, 3, 6, 1, 7, 7, 2, 40, 1, 1], list(range(1, 60))])
def test_alias_table_gives_every_item_its_share(spark, counts):
    n, total = len(counts), sum(counts)
    df = spark.createDataFrame([(10 * i, c) for i, c in enumerate(counts)], "item_id long, c long")
    rows = cd.alias_table(df, "item_id", "c", n, total).collect()
    assert sorted(r["_slot"] for r in rows) == list(range(n))
    mass = dict.fromkeys((10 * i for i in range(n)), 0)
    for r in rows:
        assert 0 <= r["_cut"] <= total
        mass[r["item_id"]] += r["_cut"]
        mass[r["_alias"]] += total - r["_cut"]
    assert mass == {10 * i: n * c for i, c in enumerate(counts)}


def test_popularity_shares_by_chi_square(spark):
    """First draws of many instances of one item follow the other items' shares."""
    counts = {1: 400, 2: 300, 3: 200, 4: 100, 5: 50, 6: 50}
    rows = [(u, i) for i, c in counts.items() for u in range(1000 * i, 1000 * i + c)]
    got = cd.popularity_negatives(spark.createDataFrame(rows, "user_id long, item_id long"), 2, seed=7)
    per = got.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("neg_item").alias("d"), F.sum((F.col("neg_item") == F.col("item_id")).cast("int")).alias("own"))
    assert per.count() == len(rows) and per.where("n <> 2 OR d <> 2 OR own > 0").count() == 0
    first = {(r["item_id"], r["neg_item"]): r["count"] for r in got.where("slot = 0").groupBy("item_id", "neg_item").count().collect()}
    chi = cells = 0
    for i, c in counts.items():
        rest = sum(counts.values()) - c
        for j, d in counts.items():
            if i != j:
                want = c * d / rest
                chi += (first.get((i, j), 0) - want) ** 2 / want
                cells += 1
    assert chi < 60  # 24 degrees of freedom: 51 is exceeded once in a thousand


def test_popularity_needs_enough_items(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, item_id long")
    with pytest.raises(ValueError, match="more than 2 items"):
        cd.popularity_negatives(df, 2)
    assert cd.popularity_negatives(df.where("false"), 2).count() == 0


def test_components_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "item_id long, features array<double>").repartition(7)
    cov = {(r["i"], r["j"]): r["cov"] for r in en.covariance(df, "features").collect()}
    assert np.allclose([[cov[i, j] for j in range(6)] for i in range(6)], np.cov(x.T))
    got = {r["item_id"]: r["features_pca"] for r in en.pca(df, "features", 3).collect()}
    assert got.pop(999) is None
    y = np.array([got[i] for i in range(300)])
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ vt[:3].T
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    assert np.allclose(y, want * signs)
    assert np.allclose(y.var(axis=0, ddof=1), s[:3] ** 2 / 299)
    with pytest.raises(ValueError):
        en.pca(df, "features", 7)


def test_hub_edges_are_dealt(spark):
    rows = [(1, i, 1.0) for i in range(200)] + [(u, u % 9, 2.0) for u in range(2, 60)]
    train = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    edges = gr.normalized_adjacency(train)
    rng = np.random.default_rng(6)
    emb = spark.createDataFrame([("u", u, rng.normal(size=3).tolist()) for u in range(1, 60)] + [("i", i, rng.normal(size=3).tolist()) for i in range(200)],
                                "kind string, node long, f array<double>").select("kind", "node", F.posexplode("f").alias("dim", "val"))
    whole = {(r["kind"], r["node"], r["dim"]): r["val"] for r in gr.graph_propagate(edges, emb, 2, hub_edges=1 << 20).collect()}
    cut = {(r["kind"], r["node"], r["dim"]): r["val"] for r in gr.graph_propagate(edges, emb, 2, hub_edges=16).collect()}
    assert whole.keys() == cut.keys() and np.allclose([whole[k] for k in whole], [cut[k] for k in whole])
    w = {}
    for r in edges.collect():
        w.setdefault((r["dst_kind"], r["dst"]), []).append(((r["src_kind"], r["src"]), r["w"]))
    layer = {}
    for r in emb.collect():
        layer.setdefault((r["kind"], r["node"]), np.zeros(3))[r["dim"]] = r["val"]
    total = {k: v.copy() for k, v in layer.items()}
    for _ in range(2):
        layer = {d: sum(x * layer[s] for s, x in e) for d, e in w.items()}
        for d, v in layer.items():
            total[d] = total.get(d, 0) + v
    assert np.allclose([whole[k, n, d] for (k, n) in total for d in range(3)], [total[k, n][d] / 3 for (k, n) in total for d in range(3)])


def test_results_table_by_data_size(spark, tmp_path):
    heads = list(wr.RESULT_HEADS)
    rows = [("100k", algo, 10, *(0.1 * j for j in range(len(heads) - 3))) for algo in ("random", "als", "comb")]
    res = spark.createDataFrame(rows, heads)
    path = wr.write_results(res, str(tmp_path), "100k")
    assert path.endswith("/results100k.csv")
    wr.write_results(res, str(tmp_path), "100k")  # replaced, not added to
    back = wr.read_results(spark, path)
    assert back.columns == ["_c0", *wr.RESULT_HEADS.values()]
    assert [(r["_c0"], r["Algo"]) for r in back.orderBy("_c0").collect()] == [(1, "als"), (2, "comb"), (3, "random")]
    with pytest.raises(ValueError):
        wr.write_results(res, str(tmp_path), "../up")
    with pytest.raises(ValueError, match="novelty"):
        wr.write_results(res.drop("novelty"), str(tmp_path), "1m")
