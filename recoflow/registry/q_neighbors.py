"""SAR family over the chronological train split."""

from pyspark.sql import functions as F

from recoflow.operators import sar
from recoflow.operators.topk import popular_topk
from recoflow.registry import register
from recoflow.registry.common import K, SQL_TRAIN_TEST, T, rnd, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

HALF_LIFE = 30 * 24 * 3600.0


def cooc_sql(th):
    return ("cooc", "SELECT a.item_id AS i1, b.item_id AS i2, count(*) AS n FROM train a JOIN train b "
                    f"ON a.user_id = b.user_id AND a.item_id <= b.item_id GROUP BY 1, 2 HAVING count(*) >= {th}")


DIAG = ("diag", "SELECT i1 AS i, n AS f FROM cooc WHERE i1 = i2")


def sim_sql(kind):
    expr = {"jaccard": "c.n / (d1.f + d2.f - c.n)", "lift": "c.n / (d1.f * d2.f)"}[kind]
    return ("sim", f"SELECT c.i1, c.i2, CAST({expr} AS DOUBLE) AS sim FROM cooc c JOIN diag d1 ON c.i1 = d1.i "
                   "JOIN diag d2 ON c.i2 = d2.i")


def sim_table_sql(kind):
    """The similarity table by itself: diagonals by one window each instead of two joins."""
    expr = {"jaccard": "n / (f1 + f2 - n)", "lift": "n / (f1 * f2)"}[kind]
    diagonal = "max(CASE WHEN i1 = i2 THEN n END) OVER (PARTITION BY {})"
    return (f"SELECT i1, i2, round(CAST({expr} AS DOUBLE), 6) AS sim FROM (SELECT i1, i2, n, {diagonal.format('i1')} AS f1, "
            f"{diagonal.format('i2')} AS f2 FROM cooc)")


SSIM = ("ssim", "SELECT i1 AS src, i2 AS dst, sim FROM sim UNION ALL SELECT i2, i1, sim FROM sim WHERE i1 <> i2")
SCORES = ("scores", "SELECT a.user_id, s.dst AS item_id, sum(a.rating * s.sim) AS score FROM train a "
                    "JOIN ssim s ON a.item_id = s.src GROUP BY 1, 2")


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


def _train(spark, sf):
    return train_test(spark, sf)[0]


def _sim(train, kind="jaccard", th=1):
    return sar.similarity(sar.cooccurrence(train, threshold=th, frequencies=kind != sar.COOCCUR), kind)


@register("sar_affinity", with_views(f"""
SELECT user_id, item_id, round(sum(rating * least(1.0, pow(0.5, (n.now - ts) / {HALF_LIFE}))), 6) AS affinity
FROM ratings, (SELECT max(ts) AS now FROM ratings) n GROUP BY user_id, item_id"""))
def q_sar_affinity(spark, sf):
    a = sar.affinity(fx.ratings(T(spark, sf)), half_life=HALF_LIFE)
    return a.withColumn("affinity", rnd("affinity"))


@register("sar_cooccurrence", tv("SELECT i1, i2, n FROM cooc", cooc_sql(1)))
def q_sar_cooccurrence(spark, sf):
    return sar.cooccurrence(_train(spark, sf))


@register("sar_cooccurrence_threshold", tv("SELECT i1, i2, n FROM cooc", cooc_sql(2)))
def q_sar_cooccurrence_threshold(spark, sf):
    return sar.cooccurrence(_train(spark, sf), threshold=2)


@register("sar_jaccard", tv(sim_table_sql("jaccard"), cooc_sql(1)))
def q_sar_jaccard(spark, sf):
    return _sim(_train(spark, sf), "jaccard").withColumn("sim", rnd("sim"))


@register("sar_lift", tv(sim_table_sql("lift"), cooc_sql(1)))
def q_sar_lift(spark, sf):
    return _sim(_train(spark, sf), "lift").withColumn("sim", rnd("sim"))


@register("sar_score", tv("SELECT user_id, item_id, round(score, 6) AS score FROM scores",
                          cooc_sql(1), DIAG, sim_sql("jaccard"), SSIM, SCORES))
def q_sar_score(spark, sf):
    tr = _train(spark, sf)
    return sar.score(sar.affinity(tr), _sim(tr)).withColumn("score", rnd("score"))


@register("sar_score_normalized", tv("""
SELECT s.user_id, s.item_id, round((s.score - umin * rmin) / (umax * rmax - umin * rmin) * (rmax - rmin) + rmin, 6)
       AS score
FROM scores s JOIN pu ON s.user_id = pu.user_id, (SELECT min(rating) AS rmin, max(rating) AS rmax FROM train) r""",
    cooc_sql(1), DIAG, sim_sql("jaccard"), SSIM, SCORES,
    ("uscores", "SELECT a.user_id, s.dst AS item_id, sum(s.sim) AS u FROM train a JOIN ssim s ON a.item_id = s.src "
                "GROUP BY 1, 2"),
    ("pu", "SELECT user_id, CASE WHEN count(*) < (SELECT count(DISTINCT item_id) FROM train) THEN least(0.0, min(u)) "
           "ELSE min(u) END AS umin, max(u) AS umax FROM uscores GROUP BY user_id")))
def q_sar_score_normalized(spark, sf):
    tr = _train(spark, sf)
    return sar.score_normalized(tr, _sim(tr)).withColumn("score", rnd("score"))


_RECO = f"""SELECT user_id, item_id, prediction FROM (
  SELECT user_id, item_id, prediction, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS r
  FROM (SELECT s.user_id, s.item_id, round(s.score, 6) AS prediction FROM scores s
        WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.item_id = s.item_id)))
WHERE r <= {K}"""


@register("sar_recommend", tv(_RECO, cooc_sql(1), DIAG, sim_sql("jaccard"), SSIM, SCORES))
def q_sar_recommend(spark, sf):
    tr = _train(spark, sf)
    return sar.recommend(tr, _sim(tr), K)


# co-occurrence threshold 3 leaves many users with fewer than k scored items
@register("sar_recommend_fill_zero", tv(f"""
SELECT user_id, item_id, prediction FROM (
  SELECT u.user_id, i.item_id, coalesce(round(s.score, 6), 0.0) AS prediction,
         row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(round(s.score, 6), 0.0) DESC, s.score IS NULL, i.item_id) AS r
  FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN (SELECT DISTINCT item_id FROM train) i
  LEFT JOIN scores s ON s.user_id = u.user_id AND s.item_id = i.item_id
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = i.item_id))
WHERE r <= {K}""", cooc_sql(3), DIAG, sim_sql("jaccard"), SSIM, SCORES))
def q_sar_recommend_fill_zero(spark, sf):
    tr = _train(spark, sf)
    return sar.recommend(tr, _sim(tr, th=3), K, fill_zero=True)


@register("sar_recommend_lift", tv(_RECO, cooc_sql(1), DIAG, sim_sql("lift"), SSIM, SCORES))
def q_sar_recommend_lift(spark, sf):
    tr = _train(spark, sf)
    return sar.recommend(tr, _sim(tr, "lift"), K)


@register("sar_item_topk", tv(f"""
SELECT user_id, item_id, prediction FROM (
  SELECT user_id, item_id, prediction, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS r
  FROM (SELECT a.user_id, s.dst AS item_id, round(sum(s.sim), 6) AS prediction FROM test a
        JOIN ssim s ON a.item_id = s.src
        WHERE NOT EXISTS (SELECT 1 FROM test t WHERE t.user_id = a.user_id AND t.item_id = s.dst)
        GROUP BY 1, 2))
WHERE r <= {K}""", cooc_sql(1), DIAG, sim_sql("jaccard"), SSIM))
def q_sar_item_topk(spark, sf):
    tr, te = train_test(spark, sf)
    return sar.item_based_topk(te.select("user_id", "item_id"), _sim(tr), K)


@register("popular_topk", tv(f"""
SELECT item_id, n_users FROM (SELECT item_id, count(DISTINCT user_id) AS n_users FROM train GROUP BY item_id)
ORDER BY n_users DESC, item_id LIMIT {K}"""))
def q_popular_topk(spark, sf):
    return popular_topk(_train(spark, sf), K)


@register("sar_predict", tv("""
SELECT p.user_id, p.item_id, round(coalesce(s.score, 0.0), 6) AS prediction
FROM test p LEFT JOIN scores s ON p.user_id = s.user_id AND p.item_id = s.item_id
WHERE p.user_id IN (SELECT user_id FROM train)""",
    cooc_sql(1), DIAG, sim_sql("jaccard"), SSIM, SCORES))
def q_sar_predict(spark, sf):
    tr, te = train_test(spark, sf)
    # a user with a single rating has no train part; predict refuses such users, so they are not asked for
    asked = te.select("user_id", "item_id").join(tr.select("user_id"), "user_id", "left_semi")
    out = sar.predict(tr, _sim(tr), asked)
    return out.withColumn("prediction", rnd("prediction"))


@register("sar_flagship", with_views(f"""
SELECT r.user_id, r.item_id, r.prediction, p.p_name AS title FROM ({_RECO.replace('train', 'ratings')}) r
JOIN part p ON r.item_id = p.p_partkey""",
    cooc_sql(1)[:1] + (cooc_sql(1)[1].replace("train", "ratings"),), DIAG, sim_sql("jaccard"), SSIM,
    ("scores", SCORES[1].replace("train", "ratings"))))
def q_sar_flagship(spark, sf):
    from recoflow.plans.flagship import sar_top10_with_names
    return sar_top10_with_names(spark, sf)


def _sweep_sql(thresholds=(1, 2), kinds=("jaccard", "lift"), ks=(5, 10)):
    ctes, parts = [], []
    for th in thresholds:
        ctes += [(f"cooc{th}", cooc_sql(th)[1]), (f"diag{th}", DIAG[1].replace("cooc", f"cooc{th}"))]
        for kind in kinds:
            v = f"{kind}{th}"
            ctes.append((f"sim_{v}", sim_sql(kind)[1].replace("cooc", f"cooc{th}").replace("diag", f"diag{th}")))
            ctes.append((f"scores_{v}", f"SELECT a.user_id, s.dst AS item_id, sum(a.rating * s.sim) AS score FROM train a "
                                        f"JOIN (SELECT i1 AS src, i2 AS dst, sim FROM sim_{v} UNION ALL SELECT i2, i1, sim "
                                        f"FROM sim_{v} WHERE i1 <> i2) s ON a.item_id = s.src GROUP BY 1, 2"))
            ctes.append((f"reco_{v}", f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY "
                                      f"round(score, 6) DESC, item_id) AS rank FROM scores_{v} s WHERE NOT EXISTS "
                                      f"(SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.item_id = s.item_id)"))
            for k in ks:
                ctes.append((f"hits_{v}_{k}", f"""SELECT a.user_id, coalesce(h.n_hits, 0) AS n_hits, a.n_actual,
  coalesce(h.dcg, 0.0) AS dcg, coalesce(h.ap_sum, 0.0) AS ap_sum
  FROM (SELECT user_id, count(*) AS n_actual FROM test GROUP BY user_id) a
  JOIN (SELECT DISTINCT user_id FROM reco_{v} WHERE rank <= {k}) u ON a.user_id = u.user_id
  LEFT JOIN (SELECT user_id, count(*) AS n_hits, sum(1.0 / ln(1.0 + rank)) AS dcg, sum(hit_no / rank) AS ap_sum FROM
    (SELECT r.user_id, r.rank, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS hit_no FROM reco_{v} r
     JOIN test t ON r.user_id = t.user_id AND r.item_id = t.item_id WHERE r.rank <= {k}) GROUP BY user_id) h
  ON a.user_id = h.user_id"""))
                parts.append(f"SELECT '{kind}' AS similarity, {k} AS k, {th} AS threshold, avg(n_hits / {k}) AS precision_at_k, "
                             f"avg(n_hits / n_actual) AS recall_at_k, avg(dcg / list_sum(list_transform(range(1, "
                             f"least(n_actual, {k}) + 1), lambda i: 1.0 / ln(1.0 + i)))) AS ndcg_at_k, "
                             f"avg(ap_sum / n_actual) AS map_at_k FROM hits_{v}_{k}")
    body = ("SELECT similarity, k, threshold, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS "
            "recall_at_k, round(ndcg_at_k, 6) AS ndcg_at_k, round(map_at_k, 6) AS map_at_k, row_number() OVER "
            "(ORDER BY round(precision_at_k, 9) DESC, similarity, threshold, k) AS rank FROM (" + " UNION ALL ".join(parts) + ")")
    return tv(body, *ctes)


_METRICS = ["precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k"]


@register("sweep_leaderboard", _sweep_sql())
def q_sweep(spark, sf):
    from recoflow.plans.sweep import sar_sweep
    train, test = train_test(spark, sf)
    out = sar_sweep(train, test, ["jaccard", "lift"], [5, 10], [1, 2])
    return out.select("similarity", "k", "threshold", *[rnd(c).alias(c) for c in _METRICS], "rank")


@register("sweep_als", None)
def q_sweep_als(spark, sf):
    from recoflow.plans.sweep import als_sweep
    train, test = train_test(spark, sf)
    return als_sweep(train, test, [5, 10], [0.01, 0.05], [5, 10], max_iter=5)
