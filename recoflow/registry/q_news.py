"""News features, vocabularies, body and entity joins, impression files."""

from pyspark.sql import functions as F

from recoflow.functions import text as tx
from recoflow.operators import candidates as cd
from recoflow.operators import news as nw
from recoflow.operators import sequences as sq
from recoflow.operators.encode import frequency_vocab
from recoflow.registry import register
from recoflow.registry.common import T, rnd
from recoflow.registry.q_candidates import _imp_sql
from recoflow.sources import fixtures as fx
from recoflow.sources import readers as rd
from recoflow.sources import writers as wr
from recoflow.sources.fixtures import with_views

SIZE, PAST, DIMS = 10, 4, 64
FLAT = r"regexp_replace(coalesce(text, ''), '[\t\r\n]', ' ', 'g')"


def _flat():
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[\t\r\n]", " ")


def _entities(name, ident):
    return F.to_json(F.array(F.struct(F.array(name).alias("SurfaceForms"), ident.alias("WikidataId"))))


@register("read_news", f"SELECT CAST(doc_id AS VARCHAR) AS news_id, lang AS vert, source AS subvert, {FLAT} AS title, "
                       "CAST(n_chars AS VARCHAR) AS abstract FROM documents")
def q_read_news(spark, sf):
    d = T(spark, sf).documents
    line = lambda seq, vert: d.select("doc_id", F.lit(seq).alias("seq"), F.concat_ws(
        "\t", F.col("doc_id").cast("string"), vert, "source", _flat(), F.col("n_chars").cast("string"), F.lit("u"), F.lit("[]"),
        F.lit("[]")).alias("value"))
    both = line(0, F.col("lang")).unionByName(line(1, F.lit("again")))  # every id twice: the first line stays
    path = wr.scratch_path(spark, "news")
    both.orderBy("doc_id", "seq").select("value").write.text(path)
    return rd.read_news(spark, path).select("news_id", "vert", "subvert", "title", "abstract")


_WORDS = rf"regexp_extract_all(lower(coalesce(text, '')), '{tx.SQL_WORD}')"


@register("words_and_entities", f"""
SELECT doc_id, {_WORDS} AS words, CASE WHEN lang = 'en' THEN source ELSE lang END AS surface, 'Q' || CAST(doc_id AS VARCHAR) AS entity
FROM documents""")
def q_words_and_entities(spark, sf):
    d = T(spark, sf).documents.withColumn("title", F.coalesce("text", F.lit("")))
    ident = F.concat(F.lit("Q"), F.col("doc_id").cast("string"))
    train = d.withColumn("ents", _entities("lang", ident))
    valid = d.where("lang = 'en'").withColumn("ents", _entities("source", ident))  # English ids are in both parts
    out = nw.words_and_entities(train, valid, "doc_id", "title", "ents")
    return out.select("doc_id", "words", F.col("entities")[0]["SurfaceForms"][0].alias("surface"),
                      F.col("entities")[0]["WikidataId"].alias("entity"))


_WV = (
    ("wd", f"SELECT doc_id, lang, {_WORDS} AS words FROM documents"),
    ("wp", "SELECT doc_id, lang, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM wd"),
    ("wvec", "SELECT f.word, e.embedding AS vector FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS i "
             "FROM wp GROUP BY word) f JOIN embeddings e ON e.vec_id = f.i"),
    ("vocab", "SELECT word, row_number() OVER (ORDER BY f.d, f.p) AS index FROM (SELECT word, min((doc_id, p)) AS f0, "
              "min({'d': doc_id, 'p': p}) AS f FROM wp WHERE word IN (SELECT word FROM wvec) GROUP BY word)"),
)


def _news(spark, sf):
    """Documents with words, word vectors (by frequency rank) and the first-appearance vocabulary."""
    t = T(spark, sf)
    docs = t.documents.select("doc_id", "lang", tx.words_col(F.lower(F.col("text"))).alias("words"))
    rank = frequency_vocab(docs.select(F.explode("words").alias("word")), "word")
    vectors = rank.join(t.embeddings.select(F.col("vec_id").alias("index"), F.col("embedding").alias("vector")), "index").select("word", "vector")
    return docs, vectors, nw.word_vocabulary(docs, vectors, "doc_id", "words")


_DWI = _WV + (
    ("dwi", f"""SELECT d.doc_id, list_transform(range(0, {SIZE}), lambda i: coalesce(v.w[i + 1], 0)) AS word_index,
  list_transform(range(0, {SIZE}), lambda i: coalesce(v.e[i + 1], 0)) AS entity_index FROM wd d LEFT JOIN (
    SELECT wp.doc_id, list(coalesce(vocab.index, 0) ORDER BY p) AS w, list(CASE WHEN wp.word = 'de' AND wp.lang <> 'en' THEN wp.doc_id + 1
           ELSE 0 END ORDER BY p) AS e FROM wp LEFT JOIN vocab ON wp.word = vocab.word WHERE p < {SIZE} GROUP BY wp.doc_id) v
  ON d.doc_id = v.doc_id"""),
)


def _doc_index(spark, sf):
    docs, _, vocab = _news(spark, sf)
    ents = docs.where("lang <> 'en'").select("doc_id", F.lit("de").alias("word"), (F.col("doc_id") + 1).alias("entity_index"))
    return nw.doc_word_index(docs, vocab, "doc_id", "words", SIZE, ents)


@register("doc_word_index", with_views("SELECT doc_id, word_index, entity_index FROM dwi", *_DWI))
def q_doc_word_index(spark, sf):
    return _doc_index(spark, sf)


@register("embedding_lookup", with_views(
    f"SELECT index, found, list_transform(vector, lambda x: round(x, 5)) AS vector FROM (SELECT vocab.index, true AS found, "
    f"list_transform(wvec.vector, lambda x: CAST(x AS DOUBLE)) AS vector FROM vocab JOIN wvec ON vocab.word = wvec.word "
    f"UNION ALL SELECT 0, false, list_transform(range(0, {DIMS}), lambda x: CAST(0 AS DOUBLE)))", *_WV))
def q_embedding_lookup(spark, sf):
    _, vectors, vocab = _news(spark, sf)
    vectors = vectors.withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    out = nw.embedding_lookup(vocab, vectors, DIMS)
    return out.withColumn("vector", F.transform("vector", lambda x: F.round(x, 5)))


@register("write_embeddings", with_views(
    "SELECT CAST(item_id AS VARCHAR) AS key, list_transform(features, lambda x: round(CAST(x AS DOUBLE), 5)) AS vector FROM vectors"))
def q_write_embeddings(spark, sf):
    path = wr.write_lines(wr.embedding_lines(fx.vectors(T(spark, sf)), "item_id", "features"), wr.scratch_path(spark, "wemb"))
    got = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return got.select(got.f[0].alias("key"), F.transform(F.split(got.f[1], " "), lambda x: F.round(x.cast("float").cast("double"), 5)).alias("vector"))


@register("write_doc_features", with_views(
    "SELECT CAST(doc_id AS VARCHAR) || ' ' || array_to_string(word_index, ',') || ' ' || array_to_string(entity_index, ',') AS value FROM dwi",
    *_DWI))
def q_write_doc_features(spark, sf):
    lines = wr.doc_feature_lines(_doc_index(spark, sf), "doc_id", "word_index", "entity_index")
    return spark.read.text(wr.write_lines(lines, wr.scratch_path(spark, "docf")))


_BEH = (
    ("bi", "SELECT imp_id, user_id, max(ts) AS ts, string_agg(CAST(item_id AS VARCHAR) || '-' || CAST(label AS VARCHAR), ' ' ORDER BY item_id) "
           "AS imps, coalesce(string_agg(CASE WHEN label = 1 THEN CAST(item_id AS VARCHAR) END, ' ' ORDER BY item_id), '') AS clicked "
           "FROM impressions GROUP BY imp_id, user_id"),
    ("bh", "SELECT *, coalesce(lag(clicked) OVER (PARTITION BY user_id ORDER BY ts, imp_id), '') AS history FROM bi"),
    ("hist_of", "SELECT user_id, list_filter(string_split(arg_max(history, imp_id), ' '), lambda x: x <> '') AS history FROM bh GROUP BY user_id"),
)


def _behaviors(spark, sf):
    """The impression log as a file and read back; its history column holds the clicks of the user's impression before."""
    from pyspark.sql import Window
    b = sq.parse_behaviors(sq.behaviors_from_impressions(fx.impressions(T(spark, sf))))
    w = Window.partitionBy("user_id").orderBy("ts", "imp_id")
    lines = b.select("imp_id", F.concat_ws("\t", F.col("imp_id").cast("string"), F.col("user_id").cast("string"), F.col("ts").cast("string"),
                                           F.coalesce(F.lag(F.concat_ws(" ", "pos")).over(w), F.lit("")), "imps").alias("value"))
    path = wr.scratch_path(spark, "behaviors")
    lines.orderBy("imp_id").select("value").write.text(path)
    return rd.read_behaviors(spark, path)


@register("read_behaviors_file", with_views("""
SELECT CAST(imp_id AS VARCHAR) AS imp_id, CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS VARCHAR) AS time,
  list_filter(string_split(history, ' '), lambda x: x <> '') AS history,
  list_transform(list_filter(string_split(imps, ' '), lambda x: x LIKE '%-1'), lambda x: string_split(x, '-')[1]) AS pos,
  list_transform(list_filter(string_split(imps, ' '), lambda x: x LIKE '%-0'), lambda x: string_split(x, '-')[1]) AS neg
FROM bh""", *_BEH))
def q_read_behaviors_file(spark, sf):
    return _behaviors(spark, sf).drop("_line")


@register("latest_history", with_views("SELECT CAST(user_id AS VARCHAR) AS user_id, history FROM hist_of", *_BEH))
def q_latest_history(spark, sf):
    return nw.latest_history(_behaviors(spark, sf), ["_line"])


@register("write_user_history", with_views("""
SELECT 'train_' || CAST(user_id AS VARCHAR) || ' ' || array_to_string(history, ',') AS value FROM hist_of
UNION ALL SELECT 'valid_' || CAST(user_id AS VARCHAR) || ' ' || array_to_string(history, ',') FROM hist_of""", *_BEH))
def q_write_user_history(spark, sf):
    h = nw.latest_history(_behaviors(spark, sf), ["_line"])
    return spark.read.text(wr.write_lines(wr.user_history_lines(h, h), wr.scratch_path(spark, "uhist")))


@register("write_train_lines", f"""
SELECT '1 train_' || CAST(user_id AS VARCHAR) || ' ' || CAST(item_id AS VARCHAR) AS value FROM ({fx.SQL_VIEWS['impressions']}) WHERE label = 1
UNION ALL SELECT '0 train_' || CAST(user_id AS VARCHAR) || ' ' || CAST(neg_item AS VARCHAR) FROM ({_imp_sql(4, False)})""")
def q_write_train_lines(spark, sf):
    imps = fx.impressions(T(spark, sf))
    lines = wr.train_lines(imps.where("label = 1"), cd.impression_negatives(imps, 4, seed=42))
    return spark.read.text(wr.write_lines(lines, wr.scratch_path(spark, "trainl")))


@register("write_valid_impressions", with_views("""
SELECT CAST(label AS VARCHAR) || ' valid_' || CAST(user_id AS VARCHAR) || ' ' || CAST(item_id AS VARCHAR) || '%' || CAST(s AS VARCHAR) AS value
FROM impressions JOIN (SELECT imp_id, row_number() OVER (ORDER BY imp_id) - 1 AS s FROM (SELECT DISTINCT imp_id FROM impressions)) USING (imp_id)"""))
def q_write_valid_impressions(spark, sf):
    imps = fx.impressions(T(spark, sf))
    lines = wr.valid_lines(imps.join(nw.sessions(imps), "imp_id"))
    return spark.read.text(wr.write_lines(lines, wr.scratch_path(spark, "validl")))


_ZERO = f"list_transform(range(0, {SIZE}), lambda x: CAST(0 AS BIGINT))"


@register("impression_features", with_views(f"""
SELECT i.imp_id, i.user_id, i.item_id, i.label, coalesce(c.word_index, {_ZERO}) AS candidate_words, h.hw AS history_words
FROM impressions i LEFT JOIN dwi c ON c.doc_id = i.item_id JOIN (
  SELECT user_id, list(coalesce(d.word_index, {_ZERO}) ORDER BY g.p) AS hw FROM hist_of, range(1, {PAST + 1}) g(p)
  LEFT JOIN dwi d ON CAST(d.doc_id AS VARCHAR) = history[g.p] GROUP BY user_id) h ON h.user_id = i.user_id""", *_DWI, *_BEH))
def q_impression_features(spark, sf):
    feats = _doc_index(spark, sf).withColumnRenamed("doc_id", "item_id")
    rows = fx.impressions(T(spark, sf)).select("imp_id", "user_id", "item_id", "label")
    hist = nw.latest_history(_behaviors(spark, sf), ["_line"]).withColumn("user_id", F.col("user_id").cast("bigint"))
    return nw.impression_features(rows, feats, hist, PAST, SIZE).select("imp_id", "user_id", "item_id", "label", "candidate_words", "history_words")


@register("read_review_meta", """
SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type AS cate FROM part""")
def q_read_review_meta(spark, sf):
    p = T(spark, sf).part
    lines = p.select(F.format_string("{'asin': '%s', 'categories': [['%s', '%s'], ['other']]}", F.col("p_partkey").cast("string"),
                                     F.col("p_brand"), F.col("p_type")).alias("value"))
    return rd.read_review_meta(spark, wr.write_lines(lines, wr.scratch_path(spark, "meta")))


@register("fulltext_join", r"""
SELECT doc_id, lang, replace(text, chr(10), ' ') AS full_text FROM documents WHERE replace(coalesce(text, ''), chr(10), ' ') <> ''""")
def q_fulltext_join(spark, sf):
    d = T(spark, sf).documents
    name = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("doc_id").cast("string"))
    body = F.to_json(F.struct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(x.alias("text"))).alias("body_text")))
    # German and English papers have an empty first file; the second has the text
    first = d.select(name("a").alias("path"), F.when(F.col("lang").isin("de", "en"), F.lit('{"body_text": []}')).otherwise(body).alias("json"))
    second = d.where("lang IN ('de', 'en')").select(name("b").alias("path"), body.alias("json"))
    meta = d.select("doc_id", "lang", name("a").alias("pdf"), F.when(F.col("lang").isin("de", "en"), name("b")).alias("pmc"))
    return rd.fulltext_join(meta, first.unionByName(second), ["pdf", "pmc"])


@register("linked_entities", """
SELECT l_orderkey AS name, 'Q' || CAST(l_partkey AS VARCHAR) AS entity, l_returnflag AS label FROM lineitem""")
def q_linked_entities(spark, sf):
    li = T(spark, sf).lineitem
    binding = F.struct(F.struct(F.concat(F.lit("http://entity/Q"), F.col("l_partkey").cast("string")).alias("value")).alias("entity"),
                       F.struct(F.col("l_returnflag").alias("value")).alias("label"))
    # an order's lines are its bindings
    res = li.groupBy(F.col("l_orderkey").alias("name")).agg(F.to_json(F.struct(F.struct(F.collect_list(binding).alias("bindings"))
                                                                               .alias("results"))).alias("json"))
    return rd.linked_entities(res, "name", "json")


@register("sequence_negatives", with_views(
    "SELECT imp_id, item_id, target, n_negatives, clash, foreign_items FROM (SELECT m.imp_id, m.item_id, m.item_id AS target, "
    "CAST(3 AS INTEGER) AS n_negatives, CAST(0 AS INTEGER) AS clash, CAST(0 AS INTEGER) AS foreign_items FROM impressions m)"))
def q_sequence_negatives(spark, sf):
    """Invariants of each instance: its last target, k draws per place, none equal to its target, all from its run."""
    inst = fx.impressions(T(spark, sf)).withColumn("past", F.array(F.col("user_id")))
    out = nw.sequence_negatives(inst, 3, 2, 64, ["imp_id", "item_id"], "past")
    bad = F.aggregate(F.transform("negatives", lambda row: F.size(F.filter(F.zip_with(row, F.col("targets"), lambda a, b: a == b), lambda x: x))),
                      F.lit(0), lambda a, x: a + x)
    short = F.size(F.filter("negatives", lambda row: F.size(row) != F.size("targets")))
    return out.select("imp_id", "item_id", F.element_at("targets", -1).alias("target"), F.size("negatives").alias("n_negatives"),
                      bad.alias("clash"), short.alias("foreign_items"))


@register("group_dcg", with_views("""
SELECT imp_id, round(sum(CASE WHEN r <= 3 THEN (pow(2.0, label) - 1) / log2(r + 1.0) ELSE 0 END), 6) AS dcg_at_3,
  round(sum((pow(2.0, label) - 1) / log2(r + 1.0)), 6) AS dcg_at_20 FROM (SELECT imp_id, label, row_number() OVER (PARTITION BY imp_id
  ORDER BY 1 + CAST((user_id * 7919 + item_id * 104729) % 997 AS DOUBLE) / 249 DESC, item_id) AS r FROM impressions) GROUP BY imp_id"""))
def q_group_dcg(spark, sf):
    from recoflow.operators import metrics as m
    from recoflow.registry.q_metrics import _ranked
    out = m.group_dcg(_ranked(spark, sf), "imp_id", [3, 20])
    return out.select("imp_id", rnd("dcg_at_3").alias("dcg_at_3"), rnd("dcg_at_20").alias("dcg_at_20"))
