"""Source and sink round trips: rows written from the views to a fresh folder under the
shared checkpoint folder and read back with the readers."""

from pyspark.sql import functions as F

from recoflow.functions.arrays import epoch_seconds
from recoflow.sources import readers as rd
from recoflow.sources import writers as wr
from recoflow.registry import register
from recoflow.registry.common import K, SQL_TRAIN_TEST, T, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


@register("read_ratings", with_views("SELECT user_id, item_id, rating, ts FROM ratings"))
def q_read_ratings(spark, sf):
    path = wr.write_lines(wr.delimited_lines(fx.ratings(T(spark, sf)), "::"), wr.scratch_path(spark, "ratings"))
    r = rd.read_ratings(spark, path, "double_colon", ["user_id", "item_id", "rating", "ts"])
    return r.select(F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"),
                    F.col("rating").cast("double"), "ts")


_ITEM_LINES = ("il", "SELECT p_partkey AS item_id, p_name || ' (' || CAST(1990 + p_size % 30 AS VARCHAR) || ')' AS title, "
                     "1990 + p_size % 30 AS year, string_split(p_type, ' ') AS genres FROM part")


def _items(spark, sf):
    p = T(spark, sf).part
    title = F.concat(F.col("p_name"), F.lit(" ("), (1990 + F.col("p_size") % 30).cast("string"), F.lit(")"))
    lines = p.select(F.concat_ws("|", F.col("p_partkey").cast("string"), title,
                                 F.array_join(F.split("p_type", " "), "|")).alias("value"))
    path = wr.write_lines(lines, wr.scratch_path(spark, "items"))
    return rd.read_items(spark, path)


@register("read_items", with_views("SELECT item_id, title, year, genres FROM il", _ITEM_LINES))
def q_read_items(spark, sf):
    return _items(spark, sf)


@register("items_by_year", with_views("SELECT year, count(*) AS n_items FROM il GROUP BY year", _ITEM_LINES))
def q_items_by_year(spark, sf):
    return rd.items_by_year(_items(spark, sf))


@register("items_by_genre", with_views(
    "SELECT genre, count(*) AS n_items FROM (SELECT DISTINCT item_id, unnest(genres) AS genre FROM il) GROUP BY genre",
    _ITEM_LINES))
def q_items_by_genre(spark, sf):
    return rd.items_by_genre(_items(spark, sf))


@register("items_by_flags", """
SELECT CASE WHEN f = 1 THEN 'large' ELSE 'dear' END AS genre, count(*) AS n_items FROM (SELECT p_partkey, unnest(
  list_filter([CASE WHEN p_size > 25 THEN 1 END, CASE WHEN p_retailprice > 1000 THEN 2 END], lambda x: x IS NOT NULL)) AS f FROM part)
GROUP BY f""")
def q_items_by_flags(spark, sf):
    p = T(spark, sf).part
    flags = p.select((F.col("p_size") > 25).cast("int").alias("large"), (F.col("p_retailprice") > 1000).cast("int").alias("dear"))
    return rd.items_by_genre(rd.genres_from_flags(flags, ["large", "dear"]))


@register("ratings_with_items", with_views(
    "SELECT r.user_id, r.item_id, r.rating, i.title, i.genre FROM ratings r LEFT JOIN items i ON r.item_id = i.item_id"))
def q_ratings_with_items(spark, sf):
    t = T(spark, sf)
    return rd.ratings_with_items(fx.ratings(t).select("user_id", "item_id", "rating"),
                                 fx.items(t).select("item_id", "title", "genre"))


@register("read_ctr_log", with_views(
    "SELECT label, CAST(floor(num_value) AS INTEGER) AS int00, cat_user AS cat00, cat_props AS cat01 FROM ctr"))
def q_read_ctr_log(spark, sf):
    c = fx.ctr(T(spark, sf))
    empties = [F.lit("")] * 12 + [F.lit("")] * 24
    lines = c.select(F.concat_ws("\t", F.col("label").cast("string"), F.floor("num_value").cast("int").cast("string"),
                                 *empties[:12], F.col("cat_user"), F.col("cat_props"), *empties[12:]).alias("value"))
    path = wr.write_lines(lines, wr.scratch_path(spark, "ctr"))
    return rd.read_ctr_log(spark, path).select("label", "int00", "cat00", "cat01")


@register("read_reviews", """
SELECT CAST(user_id AS VARCHAR) AS user_id, event_type || '-' || CAST(event_id AS VARCHAR) AS item_id,
       CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events""")
def q_read_reviews(spark, sf):
    e = T(spark, sf).events
    lines = e.select(F.format_string("{'reviewerID': '%s', 'asin': '%s-%s', 'unixReviewTime': %s}",
                                     F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string"),
                                     epoch_seconds("ts").cast("string")).alias("value"))
    path = wr.write_lines(lines, wr.scratch_path(spark, "reviews"))
    return rd.read_reviews(spark, path)


_FFM_SQL = ("ffm", """SELECT c.row_id, CAST(c.label AS VARCHAR) || ' 1:' || CAST(u.code AS VARCHAR) || ':1 2:'
  || CAST(n.nu + 1 AS VARCHAR) || ':' || CAST(c.num_value AS VARCHAR) || ' 3:' || CAST(p.code + n.nu + 1 AS VARCHAR) || ':1'
  AS line FROM ctr c
  JOIN (SELECT cat_user, row_number() OVER (ORDER BY f, cat_user) AS code FROM (SELECT cat_user, min(row_id) AS f FROM ctr
        WHERE cat_user IS NOT NULL GROUP BY cat_user)) u ON c.cat_user = u.cat_user
  JOIN (SELECT cat_props, row_number() OVER (ORDER BY f, cat_props) AS code FROM (SELECT cat_props, min(row_id) AS f FROM ctr
        WHERE cat_props IS NOT NULL GROUP BY cat_props)) p ON c.cat_props = p.cat_props,
  (SELECT count(DISTINCT cat_user) AS nu FROM ctr) n""")


def _ffm(spark, sf):
    return wr.to_libffm(fx.ctr(T(spark, sf)), "label", ["cat_user", "num_value", "cat_props"], "row_id")


@register("to_libffm", with_views("SELECT row_id, line FROM ffm", _FFM_SQL))
def q_to_libffm(spark, sf):
    return _ffm(spark, sf)


def _read_ffm(spark, sf):
    lines = _ffm(spark, sf).select(F.concat(F.col("line"), F.lit("%"), F.col("row_id").cast("string")).alias("value"))
    path = wr.write_lines(lines, wr.scratch_path(spark, "ffm"))
    return rd.read_ffm(spark, path)


@register("read_ffm", with_views(
    "SELECT CAST(label AS FLOAT) AS label, row_id AS impression_id, 3 AS n_features FROM ctr"))
def q_read_ffm(spark, sf):
    f = _read_ffm(spark, sf)
    return f.select("label", "impression_id", F.size("features").alias("n_features"))


@register("ffm_sparse_index", with_views("""
SELECT row_id, CAST(g.f - 1 AS INTEGER) AS field, CAST(string_split(string_split(line, ' ')[g.f + 1], ':')[2] AS INTEGER) - 1
       AS feature, round(CAST(string_split(string_split(line, ' ')[g.f + 1], ':')[3] AS FLOAT), 4) AS value, 0 AS slot
FROM ffm, range(1, 4) g(f)""", _FFM_SQL))
def q_ffm_sparse_index(spark, sf):
    f = _read_ffm(spark, sf).withColumnRenamed("impression_id", "row_id")
    out = rd.ffm_sparse_index(f, "row_id")
    return out.withColumn("value", F.round("value", 4)).withColumn("slot", F.col("slot").cast("int"))


@register("read_embeddings", with_views(
    "SELECT CAST(item_id AS VARCHAR) AS key, list_transform(features, lambda x: round(CAST(x AS DOUBLE), 5)) AS vector "
    "FROM vectors"))
def q_read_embeddings(spark, sf):
    v = fx.vectors(T(spark, sf))
    lines = v.select(F.concat_ws(" ", F.col("item_id").cast("string"),
                                 F.transform("features", lambda x: x.cast("string"))).alias("value"))
    path = wr.write_lines(lines, wr.scratch_path(spark, "emb"))
    e = rd.read_embeddings(spark, path)
    return e.select("key", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


@register("to_vw_lines", tv(
    "SELECT idx, CAST(CAST(rating AS BIGINT) AS VARCHAR) || ' ' || CAST(idx AS VARCHAR) || '|user ' || CAST(user_id AS VARCHAR)"
    " || ' |item ' || CAST(item_id AS VARCHAR) AS line FROM (SELECT *, row_number() OVER (ORDER BY user_id, item_id) - 1 "
    "AS idx FROM train)"))
def q_to_vw_lines(spark, sf):
    from recoflow.operators.encode import index_ids
    train, _ = train_test(spark, sf)
    keyed = train.withColumn("_k", F.struct("user_id", "item_id"))
    idx = index_ids(keyed, "_k", "idx")
    return wr.to_vw_lines(keyed.join(idx, "_k"), "user_id", "item_id", "rating", "idx")


@register("to_vw_lines_logistic", tv(
    "SELECT idx, CAST(CAST(2 * round_even(CAST(rating AS BIGINT) / (SELECT max(CAST(rating AS BIGINT)) FROM train), 0) - 1 "
    "AS BIGINT) AS VARCHAR) || ' ' || CAST(idx AS VARCHAR) || '|user ' || CAST(user_id AS VARCHAR) || ' |item ' || "
    "CAST(item_id AS VARCHAR) AS line FROM (SELECT *, row_number() OVER (ORDER BY user_id, item_id) - 1 AS idx FROM train)"))
def q_to_vw_lines_logistic(spark, sf):
    from recoflow.operators.encode import index_ids
    train, _ = train_test(spark, sf)
    keyed = train.withColumn("_k", F.struct("user_id", "item_id"))
    idx = index_ids(keyed, "_k", "idx")
    return wr.to_vw_lines(keyed.join(idx, "_k"), "user_id", "item_id", "rating", "idx", logistic=True)


@register("news_entities", with_views(
    "SELECT doc_id, unnest([lang, source]) AS surface, 'Q' || CAST(doc_id AS VARCHAR) AS entity_id FROM docs"))
def q_news_entities(spark, sf):
    d = fx.docs(T(spark, sf))
    ents = d.select("doc_id", F.to_json(F.array(F.struct(F.array("lang", "source").alias("SurfaceForms"),
                                                         F.concat(F.lit("Q"), F.col("doc_id").cast("string"))
                                                         .alias("WikidataId")))).alias("entities"))
    return rd.news_entities(ents, "doc_id", "entities")


@register("write_train_impressions", with_views(
    "SELECT CAST(label AS VARCHAR) || ' train_' || CAST(user_id AS VARCHAR) || ' ' || CAST(item_id AS VARCHAR) || '%' || "
    "CAST(imp_id AS VARCHAR) AS value FROM impressions"))
def q_write_train_impressions(spark, sf):
    lines = wr.impression_lines(fx.impressions(T(spark, sf)), "train_")
    path = wr.write_lines(lines, wr.scratch_path(spark, "imps"))
    return spark.read.text(path)


@register("write_sequences", with_views(
    "SELECT label, CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, cate, ts, "
    "list_transform(item_history, lambda x: CAST(x AS VARCHAR)) AS item_history FROM hist",
    *__import__("recoflow.registry.q_sequences", fromlist=["INST"]).INST and
    (__import__("recoflow.registry.q_sequences", fromlist=["INST"]).INST,
     __import__("recoflow.registry.q_sequences", fromlist=["HIST"]).HIST)))
def q_write_sequences(spark, sf):
    from recoflow.registry.q_sequences import _hist
    path = wr.write_lines(wr.sequence_lines(_hist(spark, sf)), wr.scratch_path(spark, "seq"), "gzip")  # whole histories repeat themselves
    return rd.read_sequences(spark, path).select("label", "user_id", "item_id", "cate", "ts", "item_history")


# words of the train impressions; an eighth of the users and parts and one category stay unlisted
_SEQ_VOCAB = tuple((f"v_{name}", f"SELECT CAST(w AS VARCHAR) AS w, row_number() OVER (ORDER BY w) AS idx FROM (SELECT DISTINCT {col} AS w FROM {table}) "
                                 f"WHERE {listed}") for name, col, table, listed in (
    ("user", "user_id", "ratings", "w % 8 <> 0"), ("item", "item_id", "ratings", "w % 8 <> 3"), ("cate", "category", "items", "w < 'STANDARD'")))


def _hist_ctes():
    from recoflow.registry.q_sequences import HIST, INST
    return INST, HIST


@register("read_sequences", with_views("""
SELECT h.label, CAST(h.user_id AS VARCHAR) AS user_id, CAST(h.item_id AS VARCHAR) AS item_id, h.cate, h.ts,
       coalesce(u.idx, 0) AS user_idx, coalesce(i.idx, 0) AS item_idx, coalesce(c.idx, 0) AS cate_idx, l.item_history_idx, l.cate_history_idx
FROM hist h LEFT JOIN v_user u ON u.w = CAST(h.user_id AS VARCHAR) LEFT JOIN v_item i ON i.w = CAST(h.item_id AS VARCHAR)
LEFT JOIN v_cate c ON c.w = h.cate JOIN looked l ON l.imp_id = h.imp_id AND l.user_id = h.user_id AND l.item_id = h.item_id""",
    *_hist_ctes(), *_SEQ_VOCAB,
    ("places", "SELECT imp_id, user_id, item_id, unnest(item_history) AS x, unnest(cate_history) AS y, generate_subscripts(item_history, 1) AS p FROM hist"),
    ("looked", "SELECT s.imp_id, s.user_id, s.item_id, list(coalesce(v.idx, 0) ORDER BY p) AS item_history_idx, "
               "list(coalesce(c.idx, 0) ORDER BY p) AS cate_history_idx FROM places s LEFT JOIN v_item v ON v.w = CAST(s.x AS VARCHAR) "
               "LEFT JOIN v_cate c ON c.w = s.y GROUP BY s.imp_id, s.user_id, s.item_id")))
def q_read_sequences(spark, sf):
    from recoflow.operators.encode import index_ids
    from recoflow.registry.q_sequences import _hist
    t = T(spark, sf)
    r = fx.ratings(t)
    users = index_ids(r.where("user_id % 8 <> 0"), "user_id", "idx", start=1)
    items = index_ids(r.where("item_id % 8 <> 3"), "item_id", "idx", start=1)
    cates = index_ids(fx.items(t).where("category < 'STANDARD'"), "category", "idx", start=1)
    path = wr.write_lines(wr.sequence_lines(_hist(spark, sf)), wr.scratch_path(spark, "seq"), "gzip")  # whole histories repeat themselves
    return rd.read_sequences(spark, path, users, items, cates).drop("item_history", "cate_history", "time_history")


def _write_reco_sql():
    from recoflow.registry import q_neighbors as n
    return n.tv(n._RECO, n.cooc_sql(1), n.DIAG, n.sim_sql("jaccard"), n.SSIM, n.SCORES)


@register("write_recommendations", _write_reco_sql())
def q_write_recommendations(spark, sf):
    from recoflow.operators import sar
    train, _ = train_test(spark, sf)
    reco = sar.recommend(train, sar.similarity(sar.cooccurrence(train, frequencies=True)), K)
    path = wr.write_table(reco, wr.scratch_path(spark, "reco"), "csv")
    return spark.read.csv(path, header=True, schema="user_id long, item_id long, prediction double")
