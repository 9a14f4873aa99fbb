"""Factor models, score shifts, re-ranks, vector scoring and the user–item graph."""

import math

from pyspark.sql import functions as F

from recoflow.operators import factors as fa
from recoflow.operators import graph as gr
from recoflow.operators.encode import blend_with_mean
from recoflow.registry import register
from recoflow.registry.common import K, SQL_TRAIN_TEST, TRAIN_MEAN, T, rnd, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

UF_SQL = ("uf", "SELECT c_custkey AS user_id, [c_acctbal / 997.0, c_nationkey / 25.0, 1.0] AS features FROM customer")
IF_SQL = ("itf", "SELECT p_partkey AS item_id, [p_retailprice / 997.0, p_size / 50.0, 1.0] AS features FROM part")
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def user_f(t):
    c = t.customer
    return c.select(F.col("c_custkey").alias("user_id"),
                    F.array(F.col("c_acctbal") / 997.0, F.col("c_nationkey") / 25.0, F.lit(1.0)).alias("features"))


def item_f(t):
    p = t.part
    return p.select(F.col("p_partkey").alias("item_id"),
                    F.array(F.col("p_retailprice") / 997.0, F.col("p_size") / 50.0, F.lit(1.0)).alias("features"))


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


def _unseen(spark, sf):
    train, _ = train_test(spark, sf)
    return fx.predictions(T(spark, sf)).join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


_UNSEEN = ("unseen", "SELECT * FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = p.user_id "
                     "AND t.item_id = p.item_id)")
_TOPK = ("topk", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) "
                 f"AS r FROM unseen) WHERE r <= {K}")


@register("als_recommend", None)
def q_als_recommend(spark, sf):
    train, _ = train_test(spark, sf)
    model = fa.als_fit(train, 10, 15, 0.05)
    return fa.als_recommend(model, train, K)


@register("als_blended", None)
def q_als_blended(spark, sf):
    train, _ = train_test(spark, sf)
    blended = blend_with_mean(train, 0.4)
    model = fa.als_fit(blended, 10, 15, 0.05)
    return fa.als_recommend(model, train, K)


# Whatever the factors are: k unseen items of the train catalogue for every user (or all there are), best first, scores finite.
_ALS_SHAPE = tv(f"""
SELECT user_id, least({K}, m.n_items - count(*)) AS n_rows, least({K}, m.n_items - count(*)) AS n_items, 0 AS n_seen, 0 AS n_unknown, 0 AS n_bad
FROM (SELECT DISTINCT user_id, item_id FROM train) t, (SELECT count(DISTINCT item_id) AS n_items FROM train) m GROUP BY user_id, m.n_items""")


def _als_shape(reco, train):
    seen = train.select("user_id", "item_id").distinct().withColumn("_s", F.lit(1))
    known = train.select("item_id").distinct().withColumn("_k", F.lit(1))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    return (reco.join(seen, ["user_id", "item_id"], "left").join(known, "item_id", "left").groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_id").alias("n_items"), count(F.col("_s").isNotNull()).alias("n_seen"),
                 count(F.col("_k").isNull()).alias("n_unknown"), count(F.col("prediction").isNull() | F.isnan("prediction")).alias("n_bad")))


@register("als_recommend_shape", _ALS_SHAPE)
def q_als_recommend_shape(spark, sf):
    return _als_shape(q_als_recommend(spark, sf), train_test(spark, sf)[0])


@register("als_blended_shape", _ALS_SHAPE)
def q_als_blended_shape(spark, sf):
    return _als_shape(q_als_blended(spark, sf), train_test(spark, sf)[0])


@register("shift_scores", tv(
    "SELECT user_id, item_id, round(prediction + (SELECT avg(prediction) FROM unseen), 6) AS prediction, "
    "row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), "
    "CAST(item_id AS VARCHAR))), item_id) AS rank FROM topk", _UNSEEN, _TOPK))
def q_shift_scores(spark, sf):
    return fa.shift_scores(_unseen(spark, sf), K).withColumn("prediction", rnd("prediction"))


@register("combined_shift_rerank", tv(
    "SELECT user_id, item_id, round(prediction + (SELECT avg(prediction) FROM unseen), 6) AS prediction FROM topk",
    _UNSEEN, _TOPK))
def q_combined_shift_rerank(spark, sf):
    return fa.combined_shift_rerank(_unseen(spark, sf), K).withColumn("prediction", rnd("prediction"))


@register("pair_combination_rerank", tv(f"""
SELECT user_id, b_item AS item_id, round(b_pred, 6) AS prediction FROM (
  SELECT user_id, b_item, b_pred, row_number() OVER (PARTITION BY user_id ORDER BY h, b_item) AS r FROM (
    SELECT user_id, b_item, min(h) AS h, first(b_pred) AS b_pred FROM (
      SELECT user_id, a_item, b_item, b_pred, md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(a_item AS VARCHAR),
             CAST(b_item AS VARCHAR))) AS h FROM (
        SELECT user_id, comb, arg_min(a_item, (a_item, b_item)) AS a_item, arg_min(b_item, (a_item, b_item)) AS b_item,
               arg_min(b_pred, (a_item, b_item)) AS b_pred FROM (
          SELECT a.user_id, a.item_id AS a_item, b.item_id AS b_item, b.prediction AS b_pred,
                 (a.prediction + b.prediction) / 2 AS comb
          FROM top20 a JOIN top20 b ON a.user_id = b.user_id AND a.item_id <> b.item_id) GROUP BY user_id, comb))
    GROUP BY user_id, b_item))
WHERE r <= {K}""", _UNSEEN,
    ("top20", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS r "
              "FROM unseen) WHERE r <= 20")))
def q_pair_combination(spark, sf):
    return fa.pair_combination_rerank(_unseen(spark, sf), 20, K).withColumn("prediction", rnd("prediction"))


@register("factor_predict", tv(
    f"SELECT t.user_id, t.item_id, round({DOT.format(a='u.features', b='i.features')} + m.mean, 6)"
    " AS prediction FROM test t JOIN uf u ON t.user_id = u.user_id JOIN itf i ON t.item_id = i.item_id, m", UF_SQL, IF_SQL, TRAIN_MEAN))
def q_factor_predict(spark, sf):
    t = T(spark, sf)
    train, test = train_test(spark, sf)
    mean = train.agg(F.avg("rating")).first()[0]
    out = fa.factor_predict(test.select("user_id", "item_id"), user_f(t), item_f(t), mean)
    return out.withColumn("prediction", rnd("prediction"))


@register("dot_scores", with_views(
    f"SELECT m.imp_id, m.item_id, round({DOT.format(a='u.features', b='i.features')}, 6) AS score FROM impressions m "
    "JOIN uf u ON m.user_id = u.user_id JOIN itf i ON m.item_id = i.item_id", UF_SQL, IF_SQL))
def q_dot_scores(spark, sf):
    t = T(spark, sf)
    rows = fx.impressions(t).select("imp_id", "user_id", "item_id")
    return fa.dot_scores(rows, user_f(t), item_f(t)).select("imp_id", "item_id", rnd("score").alias("score"))


@register("group_softmax_scores", with_views(
    "SELECT imp_id, item_id, round(e / sum(e) OVER (PARTITION BY imp_id), 6) AS score FROM ("
    "SELECT imp_id, item_id, exp(c - max(c) OVER (PARTITION BY imp_id)) AS e FROM (SELECT m.imp_id, m.item_id, "
    f"{DOT.format(a='u.features', b='i.features')} / ({NORM.format(a='u.features')} * {NORM.format(a='i.features')}) AS c "
    "FROM impressions m JOIN uf u ON m.user_id = u.user_id JOIN itf i ON m.item_id = i.item_id))", UF_SQL, IF_SQL))
def q_group_softmax(spark, sf):
    t = T(spark, sf)
    rows = fx.impressions(t).select("imp_id", "user_id", "item_id")
    return fa.group_softmax_scores(rows, user_f(t), item_f(t), "imp_id").select("imp_id", "item_id",
                                                                              rnd("score").alias("score"))


@register("embedding_similar", with_views(
    "SELECT item_id, round(similarity, 6) AS similarity FROM (SELECT v.item_id, "
    f"{DOT.format(a='CAST(v.features AS DOUBLE[])', b='CAST(q.features AS DOUBLE[])')} / "
    f"({NORM.format(a='CAST(v.features AS DOUBLE[])')} * {NORM.format(a='CAST(q.features AS DOUBLE[])')}) AS similarity "
    "FROM vectors v, (SELECT features FROM vectors ORDER BY item_id LIMIT 1) q "
    "WHERE v.item_id <> (SELECT min(item_id) FROM vectors)) ORDER BY similarity DESC, item_id LIMIT 10"))
def q_embedding_similar(spark, sf):
    v = fx.vectors(T(spark, sf))
    first_id = v.agg(F.min("item_id")).first()[0]
    return fa.embedding_similar(v, first_id, 10).withColumn("similarity", rnd("similarity"))


_NB = f"""SELECT a.item_id, b.item_id AS similar_id, {DOT.format(a='a.u', b='b.u')} AS similarity
  FROM units a JOIN units b ON a.item_id <> b.item_id"""


@register("embedding_neighbors", with_views(
    "SELECT item_id, similar_id, round(similarity, 6) AS similarity, r AS rank FROM (SELECT *, row_number() OVER ("
    f"PARTITION BY item_id ORDER BY round(similarity, 9) DESC, similar_id) AS r FROM ({_NB})) WHERE r <= {K}",
    ("units", f"SELECT item_id, list_transform(f, lambda x: x / n) AS u FROM (SELECT item_id, f, {NORM.format(a='f')} AS n FROM "
              "(SELECT item_id, CAST(features AS DOUBLE[]) AS f FROM vectors)) WHERE n > 0")))
def q_embedding_neighbors(spark, sf):
    from recoflow.operators.neighbors import embedding_neighbors
    return embedding_neighbors(fx.vectors(T(spark, sf)), K).withColumn("similarity", rnd("similarity"))


W = [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]
W_ITEMS = [[0.5, 0.0], [0.25, 1.0], [0.0, 2.0]]
B = [[0.5, 0.25], [0.25, 4.0]]


def _side(x, w, j):
    return "(" + " + ".join(f"CAST({x}[{i + 1}] AS DOUBLE) * {w[i][j]}" for i in range(len(w))) + ")"


_BIL = ("bil", "SELECT t.user_id, t.item_id, " + " + ".join(
    f"{_side('u.features', W, j)} * {B[j][m]} * {_side('i.features', W_ITEMS, m)}" for j in range(2) for m in range(2))
    + " AS score FROM test t JOIN uf u ON t.user_id = u.user_id JOIN itf i ON t.item_id = i.item_id")


def _bilinear(spark, sf, output):
    t = T(spark, sf)
    _, test = train_test(spark, sf)
    out = fa.bilinear_scores(user_f(t), item_f(t), test.select("user_id", "item_id"), W, B, W_ITEMS, output, 5)
    return out.select("user_id", "item_id", rnd("score").alias("score"))


@register("bilinear_scores", tv("SELECT user_id, item_id, round(score, 6) AS score FROM bil", UF_SQL, IF_SQL, _BIL))
def q_bilinear(spark, sf):
    return _bilinear(spark, sf, "score")


@register("bilinear_above_mean", tv("SELECT user_id, item_id, CAST(score > bm.mean AS DOUBLE) AS score FROM bil, bm",
                                    UF_SQL, IF_SQL, _BIL, ("bm", "SELECT avg(score) AS mean FROM bil")))
def q_bilinear_mean(spark, sf):
    return _bilinear(spark, sf, "mean")


@register("bilinear_topk", tv("SELECT user_id, count(*) AS n, sum(score) AS ones FROM (SELECT user_id, CAST(row_number() OVER ("
                              "PARTITION BY user_id ORDER BY score DESC, item_id) <= 5 AS DOUBLE) AS score FROM bil) GROUP BY user_id",
                              UF_SQL, IF_SQL, _BIL))
def q_bilinear_topk(spark, sf):
    from pyspark.sql import functions as F
    return _bilinear(spark, sf, "topk").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("ones"))


_ADJ = ("adj", """SELECT e.user_id, e.item_id, (1.0 / sqrt(du.d + 1e-9)) * (1.0 / sqrt(di.d + 1e-9)) AS w
  FROM (SELECT DISTINCT user_id, item_id FROM train WHERE rating > 0) e
  JOIN (SELECT user_id, count(*) AS d FROM (SELECT DISTINCT user_id, item_id FROM train WHERE rating > 0) GROUP BY user_id) du
    ON e.user_id = du.user_id
  JOIN (SELECT item_id, count(*) AS d FROM (SELECT DISTINCT user_id, item_id FROM train WHERE rating > 0) GROUP BY item_id) di
    ON e.item_id = di.item_id""")
_EDGES = ("edges", "SELECT 'u' AS src_kind, user_id AS src, 'i' AS dst_kind, item_id AS dst, w FROM adj UNION ALL "
                   "SELECT 'i', item_id, 'u', user_id, w FROM adj")


@register("normalized_adjacency", tv("SELECT src_kind, src, dst_kind, dst, round(w, 9) AS w FROM edges", _ADJ, _EDGES))
def q_normalized_adjacency(spark, sf):
    train, _ = train_test(spark, sf)
    return gr.normalized_adjacency(train).withColumn("w", F.round("w", 9))


_E0 = ("e0", "SELECT 'u' AS kind, user_id AS node, CAST(g.i - 1 AS INTEGER) AS dim, features[g.i] AS val FROM uf, "
             "range(1, 4) g(i) UNION ALL SELECT 'i', item_id, CAST(g.i - 1 AS INTEGER), features[g.i] FROM itf, range(1, 4) g(i)")


def _hop(name, prev):
    return (name, f"SELECT e.dst_kind AS kind, e.dst AS node, p.dim, sum(e.w * p.val) AS val FROM edges e "
                  f"JOIN {prev} p ON e.src_kind = p.kind AND e.src = p.node GROUP BY 1, 2, 3")


@register("graph_propagate", tv(
    "SELECT kind, node, dim, round(sum(val) / 3.0, 6) AS val FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 "
    "UNION ALL SELECT * FROM e2) GROUP BY kind, node, dim", _ADJ, _EDGES, UF_SQL, IF_SQL, _E0, _hop("e1", "e0"),
    _hop("e2", "e1")))
def q_graph_propagate(spark, sf):
    t = T(spark, sf)
    train, _ = train_test(spark, sf)
    emb = gr.to_long(user_f(t), "u", "user_id", "features").unionByName(gr.to_long(item_f(t), "i", "item_id", "features"))
    out = gr.graph_propagate(gr.normalized_adjacency(train), emb, layers=2)
    return out.withColumn("val", rnd("val")).withColumn("dim", F.col("dim").cast("int"))
