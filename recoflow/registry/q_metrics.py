"""Rating, classification, ranking and grouped metric queries."""

from pyspark.sql import functions as F

from recoflow.operators import metrics as m
from recoflow.registry import register
from recoflow.registry.common import K, SQL_TRAIN_TEST, T, rnd, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

SCORE = "CAST((user_id * 7919 + item_id * 104729) % 997 AS DOUBLE) / 996.0"


def _score_col():
    return ((F.col("user_id") * 7919 + F.col("item_id") * 104729) % 997).cast("double") / 996.0


def _pairs(spark, sf):
    _, test = train_test(spark, sf)
    return m.rating_pairs(test, fx.predictions(T(spark, sf)))


def _scored_impressions(spark, sf):
    return fx.impressions(T(spark, sf)).withColumn("score", _score_col())


_PAIRS = ("pairs", "SELECT t.user_id, t.item_id, t.rating AS label, p.prediction FROM test t "
                   "JOIN predictions p ON t.user_id = p.user_id AND t.item_id = p.item_id")


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


@register("rating_pairs", tv("SELECT user_id, item_id, label, round(prediction, 6) AS prediction FROM pairs", _PAIRS))
def q_rating_pairs(spark, sf):
    return _pairs(spark, sf).withColumn("prediction", rnd("prediction"))


_RM = {
    "rmse": "sqrt(avg((label - prediction) * (label - prediction)))",
    "mae": "avg(abs(label - prediction))",
    "rsquared": "1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))",
    "exp_var": "1 - var_samp(label - prediction) / var_samp(label)",
}
for _name, _expr in _RM.items():
    def _mk(name):
        def q(spark, sf):
            return m.rating_metrics(_pairs(spark, sf)).select(rnd(name).alias(name))
        return q
    register(_name, tv(f"SELECT round({_expr}, 6) AS {_name} FROM pairs", _PAIRS))(_mk(_name))


@register("rating_metrics", tv("SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RM.items()) + " FROM pairs",
                               _PAIRS))
def q_rating_metrics(spark, sf):
    return m.rating_metrics(_pairs(spark, sf)).select(*[rnd(c).alias(c) for c in _RM])


@register("user_exact_accuracy", tv(
    "SELECT round(avg(a), 6) AS user_exact_accuracy, round(sqrt(avg(e) / 2), 6) AS user_masked_rmse FROM "
    "(SELECT user_id, avg(CASE WHEN label = round(prediction) THEN 1.0 ELSE 0.0 END) AS a, "
    "avg((label - round(prediction)) * (label - round(prediction))) AS e FROM pairs GROUP BY user_id)", _PAIRS))
def q_user_exact_accuracy(spark, sf):
    _, test = train_test(spark, sf)
    pred = fx.predictions(T(spark, sf)).withColumn("prediction", F.round("prediction"))
    out = m.user_exact_accuracy_rmse(test, pred)
    return out.select(*[rnd(c).alias(c) for c in out.columns])


# ------------------------------------------------------------- classification

@register("auc", with_views(f"""
SELECT round((sum(label * r) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc
FROM (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
      FROM (SELECT label, {SCORE} AS s FROM impressions))"""))
def q_auc(spark, sf):
    return m.auc(_scored_impressions(spark, sf)).select(rnd("auc").alias("auc"))


@register("logloss", with_views(f"""
SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS logloss
FROM (SELECT label, greatest(1e-11, least(1 - 1e-11, {SCORE})) AS p FROM impressions)"""))
def q_logloss(spark, sf):
    return m.logloss(_scored_impressions(spark, sf)).select(rnd("logloss").alias("logloss"))


@register("accuracy_f1", with_views(f"""
SELECT round(avg(CASE WHEN yp = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(2.0 * sum(CASE WHEN yp = 1 AND label = 1 THEN 1 ELSE 0 END) / (2.0 * sum(CASE WHEN yp = 1 AND label = 1
       THEN 1 ELSE 0 END) + sum(CASE WHEN yp = 1 AND label = 0 THEN 1 ELSE 0 END)
       + sum(CASE WHEN yp = 0 AND label = 1 THEN 1 ELSE 0 END)), 6) AS f1
FROM (SELECT label, CASE WHEN {SCORE} >= 0.5 THEN 1 ELSE 0 END AS yp FROM impressions)"""))
def q_accuracy_f1(spark, sf):
    out = m.accuracy_f1(_scored_impressions(spark, sf))
    return out.select(rnd("accuracy").alias("accuracy"), rnd("f1").alias("f1"))


# ------------------------------------------------------------- relevance + ranking

_TOPK = ("reco", f"SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id "
                 f"ORDER BY prediction DESC, item_id) AS rank FROM predictions) WHERE rank <= {K}")


@register("relevant_topk", with_views("SELECT user_id, item_id, rank FROM reco", _TOPK))
def q_relevant_topk(spark, sf):
    return m.relevant_topk(fx.predictions(T(spark, sf)), K)


@register("relevant_by_threshold", with_views(
    "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank "
    "FROM predictions WHERE prediction >= 4.5"))
def q_relevant_by_threshold(spark, sf):
    return m.relevant_by_threshold(fx.predictions(T(spark, sf)), 4.5)


@register("relevant_by_timestamp", with_views(
    f"SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id "
    f"ORDER BY ts DESC, item_id) AS rank FROM ratings) WHERE rank <= {K}"))
def q_relevant_by_timestamp(spark, sf):
    return m.relevant_by_timestamp(fx.ratings(T(spark, sf)), K)


_HITS = ("hits", f"""
SELECT a.user_id, coalesce(h.n_hits, 0) AS n_hits, a.n_actual, coalesce(h.dcg, 0.0) AS dcg,
       coalesce(h.ap_sum, 0.0) AS ap_sum
FROM (SELECT user_id, count(*) AS n_actual FROM test GROUP BY user_id) a
JOIN (SELECT DISTINCT user_id FROM reco) u ON a.user_id = u.user_id
LEFT JOIN (SELECT user_id, count(*) AS n_hits, sum(1.0 / ln(1.0 + rank)) AS dcg, sum(hit_no / rank) AS ap_sum
           FROM (SELECT r.user_id, r.rank, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS hit_no
                 FROM reco r JOIN test t ON r.user_id = t.user_id AND r.item_id = t.item_id) GROUP BY user_id) h
  ON a.user_id = h.user_id""")


def _hits(spark, sf):
    _, test = train_test(spark, sf)
    return m.ranking_hits(m.relevant_topk(fx.predictions(T(spark, sf)), K), test)


@register("ranking_hits", tv("SELECT user_id, n_hits, n_actual, round(dcg, 6) AS dcg, round(ap_sum, 6) AS ap_sum "
                             "FROM hits", _TOPK, _HITS))
def q_ranking_hits(spark, sf):
    return _hits(spark, sf).withColumn("dcg", rnd("dcg")).withColumn("ap_sum", rnd("ap_sum"))


_IDCG = f"list_sum(list_transform(range(1, least(n_actual, {K}) + 1), lambda i: 1.0 / ln(1.0 + i)))"
_RK = {
    "precision_at_k": f"avg(n_hits / {K})",
    "recall_at_k": "avg(n_hits / n_actual)",
    "ndcg_at_k": f"avg(dcg / {_IDCG})",
    "map_at_k": "avg(ap_sum / n_actual)",
}
for _name, _expr in _RK.items():
    def _mk2(name):
        def q(spark, sf):
            return m.ranking_metrics(_hits(spark, sf), K).select(rnd(name).alias(name))
        return q
    register(_name, tv(f"SELECT round({_expr}, 6) AS {_name} FROM hits", _TOPK, _HITS))(_mk2(_name))


# ------------------------------------------------------------------ grouped

_GR = ("gr", f"""SELECT imp_id, item_id, label, {SCORE} AS score,
  row_number() OVER (PARTITION BY imp_id ORDER BY {SCORE} DESC, item_id) AS rk,
  row_number() OVER (PARTITION BY imp_id ORDER BY label DESC, item_id) AS irk FROM impressions""")


def _ranked(spark, sf):
    return m.group_ranks(_scored_impressions(spark, sf), "imp_id")


@register("group_mrr", with_views(
    "SELECT round(avg(rr / np), 6) AS mean_mrr FROM (SELECT imp_id, sum(label / rk) AS rr, sum(label) AS np "
    "FROM gr GROUP BY imp_id) WHERE np > 0", _GR))
def q_group_mrr(spark, sf):
    return m.group_mrr(_ranked(spark, sf), "imp_id").select(rnd("mean_mrr").alias("mean_mrr"))


def _ndcg_sql(ks):
    inner = ", ".join(
        f"sum(CASE WHEN rk <= {k} THEN (pow(2.0, label) - 1) / log2(rk + 1.0) ELSE 0 END) AS d{k}, "
        f"sum(CASE WHEN irk <= {k} THEN (pow(2.0, label) - 1) / log2(irk + 1.0) ELSE 0 END) AS i{k}, "
        f"max(CASE WHEN rk <= {k} AND label = 1 THEN 1 ELSE 0 END) AS h{k}" for k in ks)
    outer = ", ".join(f"round(avg(CASE WHEN i{k} > 0 THEN d{k} / i{k} END), 6) AS ndcg_at_{k}, "
                      f"round(avg(CAST(h{k} AS DOUBLE)), 6) AS hit_at_{k}" for k in ks)
    return f"SELECT {outer} FROM (SELECT imp_id, {inner} FROM gr GROUP BY imp_id)"


@register("group_ndcg_hit", with_views(_ndcg_sql([1, 3, 5]), _GR))
def q_group_ndcg(spark, sf):
    out = m.group_ndcg_hit(_ranked(spark, sf), "imp_id", [1, 3, 5])
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@register("group_auc", with_views(f"""
SELECT round(avg((rs - np * (np + 1) / 2.0) / (np * (n - np))), 6) AS group_auc FROM (
  SELECT imp_id, sum(label * r) AS rs, sum(label) AS np, count(*) AS n FROM (
    SELECT imp_id, label, rank() OVER (PARTITION BY imp_id ORDER BY s)
           + (count(*) OVER (PARTITION BY imp_id, s) - 1) / 2.0 AS r
    FROM (SELECT imp_id, label, {SCORE} AS s FROM impressions)) GROUP BY imp_id)
WHERE np > 0 AND n - np > 0"""))
def q_group_auc(spark, sf):
    return m.group_auc(_scored_impressions(spark, sf), "imp_id").select(rnd("group_auc").alias("group_auc"))


@register("group_labels", with_views(f"""
SELECT imp_id, list(label ORDER BY item_id) AS labels, list(round({SCORE}, 6) ORDER BY item_id) AS scores
FROM impressions GROUP BY imp_id"""))
def q_group_labels(spark, sf):
    df = _scored_impressions(spark, sf).withColumn("score", rnd("score"))
    return m.group_labels(df, "imp_id")
