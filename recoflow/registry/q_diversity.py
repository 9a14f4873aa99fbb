"""Diversity, novelty, serendipity and coverage of a top-k list against train."""

from pyspark.sql import functions as F

from recoflow.operators.diversity import FEATURE, ListQuality, cooccurrence_cosine, item_novelty, pairwise_items
from recoflow.operators.topk import topk_items
from recoflow.registry import register
from recoflow.registry.common import K, SQL_TRAIN_TEST, T, rnd, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

# reco: the k best-predicted pairs per user that are not in train
RECO = ("reco", f"""SELECT user_id, item_id, 1.0 AS relevance FROM (
  SELECT p.user_id, p.item_id, row_number() OVER (PARTITION BY p.user_id ORDER BY p.prediction DESC, p.item_id) AS r
  FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = p.user_id AND t.item_id = p.item_id))
WHERE r <= {K}""")
ICOUNT = ("icount", "SELECT item_id, sqrt(count(*)) AS s FROM train GROUP BY item_id")
CSIM = ("csim", """SELECT p.i1, p.i2, p.n / (c1.s * c2.s) AS sim FROM (
  SELECT a.item_id AS i1, b.item_id AS i2, count(*) AS n FROM train a JOIN train b
  ON a.user_id = b.user_id AND a.item_id <= b.item_id GROUP BY 1, 2) p
  JOIN icount c1 ON p.i1 = c1.item_id JOIN icount c2 ON p.i2 = c2.item_id""")
FEAT = ("feat", "SELECT p_partkey AS item_id, [CAST(p_size AS DOUBLE), p_retailprice, CAST(length(p_type) AS DOUBLE)]"
                " AS features FROM part")
FSIM = ("fsim", """SELECT i1, i2, list_sum(list_transform(list_zip(f1, f2), lambda x: x[1] * x[2]))
   / (sqrt(list_sum(list_transform(f1, lambda x: x * x))) * sqrt(list_sum(list_transform(f2, lambda x: x * x)))) AS sim
   FROM (SELECT DISTINCT i1, i2 FROM need) n JOIN (SELECT item_id, features AS f1 FROM feat) a ON n.i1 = a.item_id
   JOIN (SELECT item_id, features AS f2 FROM feat) b ON n.i2 = b.item_id""")
ILS = ("ils", """SELECT a.user_id, avg(coalesce(s.sim, 0.0)) AS avg_il_sim FROM reco a JOIN reco b
  ON a.user_id = b.user_id AND a.item_id < b.item_id LEFT JOIN csim s ON s.i1 = a.item_id AND s.i2 = b.item_id
  GROUP BY a.user_id""")
UIS = ("uis", """SELECT u.user_id, u.item_id, (1 - avg(coalesce(s.sim, 0.0))) * max(u.relevance) AS user_item_serendipity
  FROM (SELECT r.user_id, r.item_id, r.relevance, least(r.item_id, t.item_id) AS i1,
               greatest(r.item_id, t.item_id) AS i2 FROM reco r JOIN train t ON r.user_id = t.user_id) u
  LEFT JOIN csim s ON s.i1 = u.i1 AND s.i2 = u.i2 GROUP BY u.user_id, u.item_id""")


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


def _ev(spark, sf, **kw):
    train, _ = train_test(spark, sf)
    t = T(spark, sf)
    unseen = fx.predictions(t).join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    reco = topk_items(unseen, K)
    return ListQuality(train, reco, **kw)


def _feat(spark, sf):
    p = T(spark, sf).part
    return p.select(F.col("p_partkey").alias("item_id"),
                    F.array(F.col("p_size").cast("double"), F.col("p_retailprice"),
                            F.length("p_type").cast("double")).alias("features"))


@register("pairwise_items", tv("SELECT a.user_id, a.item_id AS i1, b.item_id AS i2 FROM reco a JOIN reco b "
                               "ON a.user_id = b.user_id AND a.item_id <= b.item_id", RECO))
def q_pairwise_items(spark, sf):
    return pairwise_items(_ev(spark, sf).reco)


@register("cooccurrence_cosine", tv("SELECT i1, i2, round(sim, 6) AS sim FROM csim", ICOUNT, CSIM))
def q_cooccurrence_cosine(spark, sf):
    return cooccurrence_cosine(train_test(spark, sf)[0]).withColumn("sim", rnd("sim"))


@register("feature_cosine", tv(
    "SELECT i1, i2, round(sim, 6) AS sim FROM fsim", RECO, FEAT,
    ("need", "SELECT a.item_id AS i1, b.item_id AS i2 FROM reco a JOIN reco b ON a.user_id = b.user_id "
             "AND a.item_id <= b.item_id"), FSIM))
def q_feature_cosine(spark, sf):
    from recoflow.operators.diversity import feature_cosine
    pairs = pairwise_items(_ev(spark, sf).reco)
    return feature_cosine(pairs, _feat(spark, sf)).withColumn("sim", rnd("sim"))


@register("intralist_similarity", tv("SELECT user_id, round(avg_il_sim, 6) AS avg_il_sim FROM ils",
                                     RECO, ICOUNT, CSIM, ILS))
def q_intralist(spark, sf):
    return _ev(spark, sf).user_similarity().withColumn("avg_il_sim", rnd("avg_il_sim"))


@register("user_diversity", tv("SELECT user_id, round(1 - avg_il_sim, 6) AS user_diversity FROM ils",
                               RECO, ICOUNT, CSIM, ILS))
def q_user_diversity(spark, sf):
    return _ev(spark, sf).user_diversity().withColumn("user_diversity", rnd("user_diversity"))


@register("diversity", tv("SELECT round(avg(1 - avg_il_sim), 6) AS diversity FROM ils", RECO, ICOUNT, CSIM, ILS))
def q_diversity(spark, sf):
    return _ev(spark, sf).diversity().select(rnd("diversity").alias("diversity"))


@register("diversity_features", tv(
    """SELECT round(avg(1 - a), 6) AS diversity FROM (SELECT n.user_id, avg(s.sim) AS a FROM need n
       JOIN fsim s ON n.i1 = s.i1 AND n.i2 = s.i2 WHERE n.i1 <> n.i2 GROUP BY n.user_id)""", RECO, FEAT,
    ("need", "SELECT a.user_id, a.item_id AS i1, b.item_id AS i2 FROM reco a JOIN reco b ON a.user_id = b.user_id "
             "AND a.item_id <= b.item_id"), FSIM))
def q_diversity_features(spark, sf):
    ev = _ev(spark, sf, measure=FEATURE, item_features=_feat(spark, sf))
    return ev.diversity().select(rnd("diversity").alias("diversity"))


_NOV = ("nov", "SELECT item_id, -log2(count(*) / (SELECT count(*) FROM train)) AS item_novelty FROM train "
               "GROUP BY item_id")


@register("item_novelty", tv("SELECT item_id, round(item_novelty, 6) AS item_novelty FROM nov", _NOV))
def q_item_novelty(spark, sf):
    return item_novelty(train_test(spark, sf)[0]).withColumn("item_novelty", rnd("item_novelty"))


@register("novelty", tv("""SELECT round(sum(c * item_novelty) / (SELECT count(*) FROM reco), 6) AS novelty
  FROM (SELECT item_id, count(*) AS c FROM reco GROUP BY item_id) r JOIN nov USING (item_id)""", RECO, _NOV))
def q_novelty(spark, sf):
    return _ev(spark, sf).novelty().select(rnd("novelty").alias("novelty"))


@register("user_item_serendipity", tv(
    "SELECT user_id, item_id, round(user_item_serendipity, 6) AS user_item_serendipity FROM uis",
    RECO, ICOUNT, CSIM, UIS))
def q_uis(spark, sf):
    return _ev(spark, sf).user_item_serendipity().withColumn("user_item_serendipity", rnd("user_item_serendipity"))


@register("user_serendipity", tv(
    "SELECT user_id, round(avg(user_item_serendipity), 6) AS user_serendipity FROM uis GROUP BY user_id",
    RECO, ICOUNT, CSIM, UIS))
def q_us(spark, sf):
    return _ev(spark, sf).user_serendipity().withColumn("user_serendipity", rnd("user_serendipity"))


@register("serendipity", tv(
    "SELECT round(avg(us), 6) AS serendipity FROM (SELECT user_id, avg(user_item_serendipity) AS us FROM uis "
    "GROUP BY user_id)", RECO, ICOUNT, CSIM, UIS))
def q_serendipity(spark, sf):
    return _ev(spark, sf).serendipity().select(rnd("serendipity").alias("serendipity"))


@register("catalog_coverage", tv(
    "SELECT round((SELECT count(DISTINCT item_id) FROM reco) / (SELECT count(DISTINCT item_id) FROM train), 6) "
    "AS catalog_coverage", RECO))
def q_catalog_coverage(spark, sf):
    return _ev(spark, sf).catalog_coverage().select(rnd("catalog_coverage").alias("catalog_coverage"))


@register("distributional_coverage", tv(
    "SELECT round(-sum(p * log2(p)), 6) AS distributional_coverage FROM (SELECT count(*) / "
    "(SELECT count(*) FROM reco) AS p FROM reco GROUP BY item_id)", RECO))
def q_distributional_coverage(spark, sf):
    return _ev(spark, sf).distributional_coverage().select(
        rnd("distributional_coverage").alias("distributional_coverage"))


# ----------------------------------------------------------------- metric suite
_SUITE_SQL = tv(f"""
SELECT 'sf' AS data, 'pred' AS algo, {K} AS k,
  round(h.precision_at_k, 6) AS precision_at_k, round(h.recall_at_k, 6) AS recall_at_k,
  round(h.ndcg_at_k, 6) AS ndcg_at_k, round(h.map_at_k, 6) AS map_at_k,
  round((SELECT count(DISTINCT item_id) FROM reco) / (SELECT count(DISTINCT item_id) FROM train), 6) AS catalog_coverage,
  round((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM reco) AS p FROM reco GROUP BY item_id)), 6)
    AS distributional_coverage,
  round((SELECT sum(c * item_novelty) / (SELECT count(*) FROM reco) FROM (SELECT item_id, count(*) AS c FROM reco
         GROUP BY item_id) r JOIN nov USING (item_id)), 6) AS novelty,
  round((SELECT avg(1 - avg_il_sim) FROM ils), 6) AS diversity,
  round((SELECT avg(us) FROM (SELECT user_id, avg(user_item_serendipity) AS us FROM uis GROUP BY user_id)), 6) AS serendipity
FROM (SELECT avg(n_hits / {K}) AS precision_at_k, avg(n_hits / n_actual) AS recall_at_k,
             avg(dcg / list_sum(list_transform(range(1, least(n_actual, {K}) + 1), lambda i: 1.0 / ln(1.0 + i)))) AS ndcg_at_k,
             avg(ap_sum / n_actual) AS map_at_k FROM hits) h""",
    RECO, ICOUNT, CSIM, ILS, UIS, _NOV,
    ("rk", f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, item_id) AS rank FROM "
           "(SELECT r.user_id, r.item_id, p.prediction AS p FROM reco r JOIN predictions p USING (user_id, item_id))"),
    ("hits", f"""SELECT a.user_id, coalesce(h.n_hits, 0) AS n_hits, a.n_actual, coalesce(h.dcg, 0.0) AS dcg,
       coalesce(h.ap_sum, 0.0) AS ap_sum
FROM (SELECT user_id, count(*) AS n_actual FROM test GROUP BY user_id) a
JOIN (SELECT DISTINCT user_id FROM rk WHERE rank <= {K}) u ON a.user_id = u.user_id
LEFT JOIN (SELECT user_id, count(*) AS n_hits, sum(1.0 / ln(1.0 + rank)) AS dcg, sum(hit_no / rank) AS ap_sum
           FROM (SELECT r.user_id, r.rank, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS hit_no
                 FROM rk r JOIN test t ON r.user_id = t.user_id AND r.item_id = t.item_id WHERE r.rank <= {K})
           GROUP BY user_id) h ON a.user_id = h.user_id"""))


@register("metric_suite", _SUITE_SQL)
def q_metric_suite(spark, sf):
    from recoflow.plans.suite import metric_suite
    train, test = train_test(spark, sf)
    t = T(spark, sf)
    unseen = fx.predictions(t).join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    reco = topk_items(unseen, K)
    row = metric_suite(train, test, reco, K, "sf", "pred")
    return row.select("data", "algo", "k", *[rnd(c).alias(c) for c in row.columns[3:]])


def _write_results_sql():
    from recoflow.sources.writers import RESULT_HEADS
    return f'SELECT 1 AS "_c0", {", ".join(f"{c} AS {chr(34)}{head}{chr(34)}" for c, head in RESULT_HEADS.items())} FROM ({_SUITE_SQL})'


@register("write_results", _write_results_sql())
def q_write_results(spark, sf):
    from recoflow.sources import writers as wr
    path = wr.write_results(q_metric_suite(spark, sf), wr.scratch_path(spark, "experiment"), "100k")
    return wr.read_results(spark, path)


@register("experiment_results", None)
def q_experiment_results(spark, sf):
    """All recommenders of the experiment scored by the suite, written as a results table and read back."""
    from recoflow.operators.candidates import random_recommend
    from recoflow.operators.factors import als_fit, als_recommend, combination_recommend
    from recoflow.plans.suite import experiment
    from recoflow.sources import writers as wr
    train, test = train_test(spark, sf)
    recos = {
        "als": (als_recommend(als_fit(train), train, K), "prediction"),
        "random": (random_recommend(train, K), "score"),
        "comb": (combination_recommend(train, K), "prediction"),
    }
    res = experiment(train, test, recos, K, sf.rstrip("/").rsplit("/", 1)[-1])
    path = wr.write_table(res, wr.scratch_path(spark, "results"), "csv")
    return spark.read.csv(path, header=True, schema=res.schema)
