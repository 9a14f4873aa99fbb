"""Cleaning and validation queries."""

from pyspark.sql import functions as F

from recoflow.functions import text as tx
from recoflow.operators import clean as cl
from recoflow.registry import register
from recoflow.registry.common import K, T
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views


@register("contract_report", with_views("""
SELECT c AS "column", dtype, rows, nulls, distinct_values, dup_keys, dtype_match FROM (
  SELECT 'user_id' AS c, 'bigint' AS dtype, count(*) AS rows, count(*) - count(user_id) AS nulls,
         count(DISTINCT user_id) AS distinct_values, true AS dtype_match FROM ratings
  UNION ALL SELECT 'item_id', 'bigint', count(*), count(*) - count(item_id), count(DISTINCT item_id), true FROM ratings
  UNION ALL SELECT 'rating', 'double', count(*), count(*) - count(rating), count(DISTINCT rating), true FROM ratings
) s, (SELECT CAST(coalesce(sum(CASE WHEN c > 1 THEN c - 1 END), 0) AS BIGINT) AS dup_keys
      FROM (SELECT count(*) AS c FROM ratings GROUP BY user_id, item_id)) d"""))
def q_contract_report(spark, sf):
    r = fx.ratings(T(spark, sf))
    return cl.contract_report(r, other=fx.predictions(T(spark, sf)).withColumn("rating", F.lit(1.0)))


@register("no_overlap_check", with_views(f"""
SELECT count(*) AS overlap FROM (
  SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
      ORDER BY prediction DESC, item_id) AS r FROM predictions) WHERE r <= {K}) p
WHERE EXISTS (SELECT 1 FROM ratings t WHERE t.user_id = p.user_id AND t.item_id = p.item_id)"""))
def q_no_overlap(spark, sf):
    from recoflow.operators.topk import topk_items
    t = T(spark, sf)
    reco = topk_items(fx.predictions(t), K)
    return cl.no_overlap_count(reco, fx.ratings(t))


@register("drop_duplicates_seq", """
SELECT doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS r2 FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r1 FROM documents) WHERE r1 = 1)
WHERE r2 = 1""")
def q_drop_duplicates_seq(spark, sf):
    d = T(spark, sf).documents.select("doc_id", "text", "n_chars")
    return cl.drop_duplicates_seq(d, ["text", "n_chars"], ["doc_id"]).select("doc_id")


@register("drop_blank", """
SELECT doc_id, nullif(source, '') AS source, lang FROM documents
WHERE nullif(source, '') IS NOT NULL AND nullif(lang, '') IS NOT NULL""")
def q_drop_blank(spark, sf):
    d = T(spark, sf).documents.select("doc_id", "source", "lang")
    return cl.drop_blank(d, ["source", "lang"])


@register("clean_metadata", """
SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, nullif(source, '') AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r2 FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS r1 FROM documents) WHERE r1 = 1)
WHERE r2 = 1 AND nullif(text, '') IS NOT NULL AND nullif(lang, '') IS NOT NULL AND nullif(source, '') IS NOT NULL""")
def q_clean_metadata(spark, sf):
    d = T(spark, sf).documents.select("doc_id", "text", "lang", "source")
    return cl.clean_metadata(d, ["doc_id"], dedupe_cols=("doc_id", "text"), required=("text", "lang", "source"))


_SQL_CLEAN = (r"lower(regexp_replace(replace(regexp_replace(regexp_replace(nfc_normalize("
              r"concat_ws(' ', coalesce(source, ''), coalesce(text, ''))), '<.*?>', '', 'g'), "
              r"'[\n\t\r]', ' ', 'g'), 'Â ', ''), '" + tx.SQL_NON_WORD + r"', '', 'g'))")


@register("clean_text", with_views(f"SELECT doc_id, {_SQL_CLEAN} AS cleaned_text FROM docs"))
def q_clean_text(spark, sf):
    return cl.clean_text(fx.docs(T(spark, sf)), ["source", "text"]).select("doc_id", "cleaned_text")


@register("token_frequency", with_views(
    f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), "
    f"'{tx.SQL_TOKEN}')) AS token FROM docs) GROUP BY token"))
def q_token_frequency(spark, sf):
    return cl.token_frequency(fx.docs(T(spark, sf)), "text")
