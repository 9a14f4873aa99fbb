"""Encoding and feature queries."""

from pyspark.sql import functions as F

from recoflow.functions.hashing import sql_hash_int, sql_hash_uniform, hash_uniform
from recoflow.operators import encode as en
from recoflow.registry import register
from recoflow.registry.common import SQL_TRAIN_TEST, TRAIN_MEAN, T, rnd, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

HALF_LIFE = 30 * 24 * 3600.0


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


@register("index_ids", with_views("""
SELECT 'user' AS kind, user_id AS id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM ratings)
UNION ALL
SELECT 'item', item_id, row_number() OVER (ORDER BY item_id) - 1 FROM (SELECT DISTINCT item_id FROM ratings)"""))
def q_index_ids(spark, sf):
    r = fx.ratings(T(spark, sf))
    u = en.index_ids(r, "user_id", "idx").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "idx")
    i = en.index_ids(r, "item_id", "idx").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "idx")
    return u.unionByName(i)


@register("frequency_vocab", with_views(
    "SELECT item_id, count, row_number() OVER (ORDER BY count DESC, item_id) AS index FROM "
    "(SELECT item_id, count(*) AS count FROM impressions GROUP BY item_id)"))
def q_frequency_vocab(spark, sf):
    return en.frequency_vocab(fx.impressions(T(spark, sf)), "item_id", start=1)


_IDX = (("ui", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM ratings)"),
        ("ii", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM ratings)"))


@register("affinity", with_views("SELECT user_idx, item_idx, rating FROM ratings JOIN ui USING (user_id) JOIN ii USING (item_id)",
                                 *_IDX))
def q_affinity(spark, sf):
    return en.affinity_matrix(fx.ratings(T(spark, sf)))[0]


@register("affinity_sparsity", with_views(
    "SELECT round((1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id))) * 100, 6) AS sparsity FROM ratings"))
def q_affinity_sparsity(spark, sf):
    return en.sparsity(fx.ratings(T(spark, sf))).select(rnd("sparsity").alias("sparsity"))


@register("affinity_to_ratings", with_views("SELECT user_id, item_id, rating FROM ratings WHERE rating <> 0"))
def q_affinity_to_ratings(spark, sf):
    m, ui, ii = en.affinity_matrix(fx.ratings(T(spark, sf)))
    return en.affinity_to_ratings(m, ui, ii)


@register("implicit_feedback", with_views(
    "SELECT user_id, sum(CASE WHEN rating > 3 THEN 1 ELSE 0 END) AS n_pos FROM ratings GROUP BY user_id"))
def q_implicit_feedback(spark, sf):
    f = en.implicit_feedback(fx.ratings(T(spark, sf)), 3.0)
    return f.groupBy("user_id").agg(F.sum("rating").cast("bigint").alias("n_pos"))


@register("rescale_ratings", with_views("""
SELECT user_id, item_id, round(CASE WHEN hi > lo THEN (rating - lo) / (hi - lo) END, 6) AS rating,
       round((rating - 1.0) / (5.0 - 1.0) * 10, 6) AS rating_fixed
FROM (SELECT *, min(rating) OVER (PARTITION BY user_id) AS lo, max(rating) OVER (PARTITION BY user_id) AS hi FROM ratings)"""))
def q_rescale_ratings(spark, sf):
    r = fx.ratings(T(spark, sf)).select("user_id", "item_id", "rating", F.col("rating").alias("rating_fixed"))
    stats = r.groupBy("user_id").agg(F.min("rating").alias("_lo"), F.max("rating").alias("_hi"))
    r = r.join(stats, "user_id")
    # groups with one value have no range: null (a pandas rescale gives NaN)
    r = r.withColumn("rating", F.when(F.col("_hi") > F.col("_lo"), (F.col("rating") - F.col("_lo"))
                                      / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")
    r = en.rescale(r, "rating_fixed", 0.0, 10.0, data_min=1.0, data_max=5.0)
    return r.select("user_id", "item_id", rnd("rating").alias("rating"), rnd("rating_fixed").alias("rating_fixed"))


@register("decayed_popularity", with_views(f"""
SELECT item_id, round(sum(least(1.0, pow(0.5, (n.now - ts) / {HALF_LIFE}))), 6) AS popularity
FROM ratings, (SELECT max(ts) AS now FROM ratings) n GROUP BY item_id"""))
def q_decayed_popularity(spark, sf):
    return en.decayed_popularity(fx.ratings(T(spark, sf)), HALF_LIFE).withColumn("popularity", rnd("popularity"))


@register("blend_with_mean", tv(
    "SELECT user_id, item_id, round(0.4 * rating + (1 - 0.4) * m.mean, 6) AS rating FROM train, m", TRAIN_MEAN))
def q_blend_with_mean(spark, sf):
    train, _ = train_test(spark, sf)
    return en.blend_with_mean(train, 0.4).select("user_id", "item_id", rnd("rating").alias("rating"))


@register("mean_center", tv(
    "SELECT user_id, item_id, round(rating - m.mean, 6) AS rating FROM test, m", TRAIN_MEAN))
def q_mean_center(spark, sf):
    train, test = train_test(spark, sf)
    return en.mean_center(test, train).select("user_id", "item_id", rnd("rating").alias("rating"))


@register("target_transform", with_views("""
SELECT user_id, item_id, round(rating / (SELECT sqrt(sum(rating * rating)) FROM ratings), 9) AS rating_norm,
       CASE WHEN rating > 3 THEN 1.0 ELSE 0.0 END AS rating_bin FROM ratings"""))
def q_target_transform(spark, sf):
    r = fx.ratings(T(spark, sf))
    n = en.target_transform(r, "normalize").select("user_id", "item_id", F.round("rating", 9).alias("rating_norm"))
    b = en.target_transform(r, "binarize").select("user_id", "item_id", F.col("rating").alias("rating_bin"))
    return n.join(b, ["user_id", "item_id"])


def _kept_sql(col):
    return (f"SELECT {col} FROM (SELECT {col}, c, row_number() OVER (ORDER BY c DESC, {col}) AS r, count(*) OVER () AS n "
            f"FROM (SELECT {col}, count(*) AS c FROM ctr WHERE {col} IS NOT NULL GROUP BY {col})) "
            f"WHERE r <= CAST(floor(n * 0.99) AS BIGINT) AND c > 10")


def _less_sql(col):
    return (f"CASE WHEN {col} IS NULL THEN '<UNK>' WHEN {col} IN ({_kept_sql(col)}) THEN {col} ELSE '<LESS>' END")


@register("rare_to_less", with_views(
    f"SELECT row_id, {_less_sql('cat_user')} AS cat_user, {_less_sql('cat_props')} AS cat_props FROM ctr"))
def q_rare_to_less(spark, sf):
    c = fx.ctr(T(spark, sf)).select("row_id", "cat_user", "cat_props")
    for col in ("cat_user", "cat_props"):
        c = en.apply_rare_to_less(c, col, en.rare_to_less_table(c, col, 10, 0.99))
    return c


@register("mean_impute", with_views(
    "SELECT row_id, round(coalesce(num_value, (SELECT avg(num_value) FROM ctr)), 6) AS num_value FROM ctr"))
def q_mean_impute(spark, sf):
    c = fx.ctr(T(spark, sf))
    return en.mean_impute(c, "num_value").select("row_id", rnd("num_value").alias("num_value"))


_ORD = ("ord", "SELECT cat_props, row_number() OVER (ORDER BY f, cat_props) AS code FROM "
               "(SELECT cat_props, min(row_id) AS f FROM ctr GROUP BY cat_props)")


@register("ordinal_encode", with_views(
    "SELECT row_id, coalesce(o.code, -1) AS cat_props_code FROM ctr c LEFT JOIN ord o "
    "ON c.cat_props IS NOT DISTINCT FROM o.cat_props", _ORD))
def q_ordinal_encode(spark, sf):
    c = fx.ctr(T(spark, sf))
    return en.ordinal_encode(c, "cat_props", en.ordinal_table(c, "cat_props", "row_id")).select("row_id", "cat_props_code")


@register("binary_encode", with_views(
    "SELECT row_id, list_transform(range(0, (SELECT CAST(ceil(log2(max(code) + 1)) AS BIGINT) FROM ord)), "
    "lambda b: CAST((code >> b) & 1 AS INTEGER)) AS code_bits FROM (SELECT row_id, o.code FROM ctr c JOIN ord o "
    "ON c.cat_props IS NOT DISTINCT FROM o.cat_props)", _ORD))
def q_binary_encode(spark, sf):
    c = fx.ctr(T(spark, sf))
    coded = en.ordinal_encode(c, "cat_props", en.ordinal_table(c, "cat_props", "row_id"), out="code")
    return en.binary_encode(coded, "code", out="code_bits").select("row_id", "code_bits")


@register("target_encode_online", with_views("""
SELECT row_id, round_even(CASE WHEN c > 0 THEN s / c ELSE 0.0 END, 6) AS cat_user_t_mean,
       round_even(CASE WHEN c > 0 THEN c / idx ELSE 0.0 END, 6) AS cat_user_t_count
FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS idx,
             coalesce(sum(label) OVER w, 0) AS s, count(*) OVER w AS c
      FROM ctr WINDOW w AS (PARTITION BY cat_user ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def q_target_encode_online(spark, sf):
    c = fx.ctr(T(spark, sf))
    out = en.target_encode_online(c, "cat_user", "label", "row_id", bucket_rows=512)
    # ratios of small integers hit exact decimal ties: round half to even on both sides
    return out.select("row_id", F.bround("cat_user_t_mean", 6).alias("cat_user_t_mean"),
                      F.bround("cat_user_t_count", 6).alias("cat_user_t_count"))


_U = sql_hash_uniform(7, "row_id")


@register("target_encode_frozen", with_views(f"""
SELECT row_id, round(coalesce(m, 0.0), 6) AS cat_user_t_mean, round(coalesce(cn, 0.0), 6) AS cat_user_t_count
FROM (SELECT * FROM ctr WHERE {_U} >= 0.7) te
LEFT JOIN (SELECT cat_user AS v, sum(label) / count(*) AS m, count(*) / (SELECT count(*) FROM ctr WHERE {_U} < 0.7) AS cn
           FROM ctr WHERE {_U} < 0.7 GROUP BY cat_user) t ON te.cat_user IS NOT DISTINCT FROM t.v"""))
def q_target_encode_frozen(spark, sf):
    c = fx.ctr(T(spark, sf))
    u = hash_uniform(7, "row_id")
    out = en.target_encode_frozen(c.where(u >= 0.7), c.where(u < 0.7), "cat_user", "label")
    return out.select("row_id", rnd("cat_user_t_mean").alias("cat_user_t_mean"),
                      rnd("cat_user_t_count").alias("cat_user_t_count"))


@register("one_hot_features", """
SELECT c_custkey, 'c_mktsegment=' || c_mktsegment AS feature, 1.0 AS value FROM customer WHERE c_mktsegment IS NOT NULL
UNION ALL
SELECT c_custkey, 'c_nationkey=' || CAST(c_nationkey AS VARCHAR), 1.0 FROM customer WHERE c_nationkey IS NOT NULL""")
def q_one_hot(spark, sf):
    return en.one_hot_long(T(spark, sf).customer, "c_custkey", ["c_mktsegment", "c_nationkey"])


@register("length_normalize", with_views("""
SELECT item_id, list_transform(features, lambda v: round(CASE WHEN n > 0 THEN CAST(v AS DOUBLE) / n ELSE CAST(v AS DOUBLE) END, 6))
       AS features
FROM (SELECT item_id, features, sqrt(list_reduce(list_transform(features, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)),
      lambda a, b: a + b)) AS n FROM vectors)"""))
def q_length_normalize(spark, sf):
    v = en.length_normalize(fx.vectors(T(spark, sf)), "features")
    return v.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


@register("crossed_bucket", with_views(
    f"SELECT user_id, item_id, {sql_hash_int(0, 'user_id', 'item_id')} % 1000 AS cross_bucket FROM ratings"))
def q_crossed_bucket(spark, sf):
    return en.crossed_bucket(fx.ratings(T(spark, sf)).select("user_id", "item_id"), 1000)


@register("metrics_long", tv("""
SELECT stage, metric, round(value, 6) AS value FROM (
  SELECT stage, sqrt(avg((rating - prediction) * (rating - prediction))) AS rmse, avg(abs(rating - prediction)) AS mae
  FROM (SELECT 'train' AS stage, t.rating, p.prediction FROM train t JOIN predictions p USING (user_id, item_id)
        UNION ALL SELECT 'test', t.rating, p.prediction FROM test t JOIN predictions p USING (user_id, item_id))
  GROUP BY stage) UNPIVOT (value FOR metric IN (rmse, mae))"""))
def q_metrics_long(spark, sf):
    from recoflow.operators.metrics import rating_metrics, rating_pairs
    train, test = train_test(spark, sf)
    pred = fx.predictions(T(spark, sf))
    wide = None
    for stage, part in (("train", train), ("test", test)):
        w = rating_metrics(rating_pairs(part, pred)).select(F.lit(stage).alias("stage"), "rmse", "mae")
        wide = w if wide is None else wide.unionByName(w)
    return en.metrics_long(wide, ["stage"]).withColumn("value", rnd("value"))


_AS_DOUBLE = ("vd", "SELECT item_id, CAST(features AS DOUBLE[]) AS f FROM vectors")


@register("reduce_dims", None)
def q_reduce_dims(spark, sf):
    return en.pca(fx.vectors(T(spark, sf)), "features", 8).select("item_id", "features_pca")


@register("reduce_dims_covariance", with_views("""
SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(avg(a.x), 9) AS mean_i, round(covar_samp(a.x, b.x), 9) AS cov
FROM cells a JOIN cells b ON a.item_id = b.item_id GROUP BY a.i, b.i""", _AS_DOUBLE,
    ("cells", "SELECT item_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM vd")))
def q_reduce_dims_covariance(spark, sf):
    c = en.covariance(fx.vectors(T(spark, sf)), "features")
    return c.select("i", "j", F.round("mean_i", 9).alias("mean_i"), F.round("cov", 9).alias("cov"))


# All components: lengths of centred vectors and their angles to the first vector must survive the projection.
@register("reduce_dims_isometry", with_views("""
SELECT c.item_id, round(list_sum(list_transform(c.y, lambda x: x * x)), 6) AS norm2,
       round(list_sum(list_transform(list_zip(c.y, f.y), lambda x: x[1] * x[2])), 6) AS with_first
FROM centred c, (SELECT y FROM centred ORDER BY item_id LIMIT 1) f""", _AS_DOUBLE,
    ("means", "SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM vd) GROUP BY i)"),
    ("centred", "SELECT item_id, list_transform(list_zip(f, m), lambda x: x[1] - x[2]) AS y FROM vd, means")))
def q_reduce_dims_isometry(spark, sf):
    from recoflow.functions.arrays import dot
    v = fx.vectors(T(spark, sf))
    p = en.pca(v, "features", 64).select("item_id", F.col("features_pca").alias("y"))
    first = p.orderBy("item_id").limit(1).select(F.col("y").alias("f"))
    return p.join(F.broadcast(first)).select("item_id", rnd(dot("y", "y")).alias("norm2"), rnd(dot("y", "f")).alias("with_first"))
