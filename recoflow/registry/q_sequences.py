"""Sequence-building queries over impressions (events) and part categories."""

from pyspark.sql import functions as F

from recoflow.operators import sequences as sq
from recoflow.operators.splits import leave_last_two
from recoflow.registry import register
from recoflow.registry.common import T, rnd
from recoflow.session import written
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views

ORDER = ["ts", "imp_id", "item_id"]
INST = ("inst", "SELECT m.imp_id, m.user_id, m.item_id, m.label, m.ts, coalesce(i.category, 'default_cat') AS cate "
                "FROM impressions m LEFT JOIN items i ON m.item_id = i.item_id")
HIST = ("hist", """SELECT * FROM (SELECT imp_id, user_id, item_id, label, ts, cate,
  list_filter(list(CASE WHEN label = 1 THEN item_id END) OVER w, lambda x: x IS NOT NULL) AS item_history,
  list_filter(list(CASE WHEN label = 1 THEN cate END) OVER w, lambda x: x IS NOT NULL) AS cate_history,
  list_filter(list(CASE WHEN label = 1 THEN ts END) OVER w, lambda x: x IS NOT NULL) AS time_history
  FROM inst WINDOW w AS (PARTITION BY user_id ORDER BY ts, imp_id, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE len(item_history) >= 1""")


def _inst(spark, sf):
    t = T(spark, sf)
    return sq.build_instances(fx.impressions(t), fx.items(t).select("item_id", F.col("category").alias("cate")))


def _hist(spark, sf):
    return sq.expand_history(_inst(spark, sf), ORDER)


@register("build_instances", with_views("SELECT imp_id, user_id, item_id, label, ts, cate FROM inst", INST))
def q_build_instances(spark, sf):
    return _inst(spark, sf).select("imp_id", "user_id", "item_id", "label", "ts", "cate")


@register("expand_history", with_views("SELECT * FROM hist", INST, HIST))
def q_expand_history(spark, sf):
    return _hist(spark, sf).select("imp_id", "user_id", "item_id", "label", "ts", "cate", "item_history",
                                   "cate_history", "time_history")


@register("last_history", with_views("""
SELECT imp_id, user_id, item_id, split, len(item_history) AS hist_len FROM (
  SELECT h.*, s.split, row_number() OVER (PARTITION BY h.user_id, s.split ORDER BY h.ts DESC, h.imp_id DESC,
         h.item_id DESC) AS r FROM hist h JOIN sp s ON h.user_id = s.user_id AND h.imp_id = s.imp_id
         AND h.item_id = s.item_id)
WHERE split <> 0 OR r = 1""", INST, HIST,
    ("sp", "SELECT user_id, imp_id, item_id, CAST(CASE WHEN n - r = 0 THEN 2 WHEN n - r = 1 THEN 1 ELSE 0 END AS INTEGER)"
           " AS split FROM (SELECT user_id, imp_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, imp_id,"
           " item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM inst)")))
def q_last_history(spark, sf):
    from recoflow.cols import DEFAULT
    inst = _inst(spark, sf)
    # leave-last-two tags on the full event order (ts, imp_id, item_id)
    tagged = written(leave_last_two(inst, DEFAULT, order=ORDER), "tagged")  # read twice to pick, once for the histories
    h = sq.expand_history(tagged, ORDER, wanted=sq.last_history(tagged, "split", ORDER))
    return (h.select("imp_id", "user_id", "item_id", "split", F.size("item_history").cast("bigint").alias("hist_len")))


def _lnd_sql(x):
    return f"round(ln(greatest(0.5, ({x}) / 86400.0)), 6)"


@register("time_gap_features", with_views(f"""
SELECT imp_id, user_id, item_id,
  list_transform(list_zip(time_history, list_concat(time_history[2:], [ts])), lambda p: {_lnd_sql('p[2] - p[1]')}) AS time_diff,
  list_transform(list_concat(time_history[2:], [ts]), lambda t: {_lnd_sql('t - time_history[1]')}) AS time_from_first,
  list_transform(time_history, lambda t: {_lnd_sql('ts - t')}) AS time_to_now
FROM hist""", INST, HIST))
def q_time_gap(spark, sf):
    out = sq.time_gap_features(_hist(spark, sf))
    r = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return out.select("imp_id", "user_id", "item_id", r("time_diff").alias("time_diff"),
                      r("time_from_first").alias("time_from_first"), r("time_to_now").alias("time_to_now"))


@register("pad_right", with_views("""
SELECT imp_id, item_id, list_concat(h, list_transform(range(0, 5 - len(h)), lambda x: CAST(0 AS BIGINT))) AS item_history_padded,
  list_transform(range(1, 6), lambda i: CASE WHEN i <= len(h) THEN 1.0 ELSE 0.0 END) AS item_history_mask
FROM (SELECT imp_id, item_id, CASE WHEN len(item_history) > 5 THEN item_history[-5:] ELSE item_history END AS h FROM hist)""",
    INST, HIST))
def q_pad_right(spark, sf):
    return sq.pad_sequences(sq.bounded_history(_inst(spark, sf), ORDER, 5), "item_history", 5, "right").select(
        "imp_id", "item_id", "item_history_padded", "item_history_mask")


@register("pad_left", with_views("""
SELECT imp_id, item_id, list_concat(list_transform(range(0, 5 - len(h)), lambda x: CAST(0 AS BIGINT)), h) AS item_history_padded,
  list_reverse(list_transform(range(1, 6), lambda i: CASE WHEN i <= len(h) THEN 1.0 ELSE 0.0 END)) AS item_history_mask
FROM (SELECT imp_id, item_id, CASE WHEN len(item_history) > 5 THEN item_history[-5:] ELSE item_history END AS h FROM hist)""",
    INST, HIST))
def q_pad_left(spark, sf):
    return sq.pad_sequences(sq.bounded_history(_inst(spark, sf), ORDER, 5), "item_history", 5, "left").select(
        "imp_id", "item_id", "item_history_padded", "item_history_mask")


@register("min_length_filter", with_views("SELECT imp_id, item_id FROM hist WHERE len(item_history) >= 3", INST, HIST))
def q_min_length(spark, sf):
    return sq.history_length(_inst(spark, sf), ORDER).where("n_history >= 3").select("imp_id", "item_id")


@register("shifted_targets", with_views("""
SELECT imp_id, item_id, s[1:len(s) - 1] AS input_seq, s[2:len(s)] AS target_seq
FROM (SELECT imp_id, item_id, list_concat(item_history, [item_id]) AS s FROM hist)""", INST, HIST))
def q_shifted(spark, sf):
    return sq.shifted_targets(_hist(spark, sf), "item_history", "item_id").select("imp_id", "item_id", "input_seq",
                                                                                   "target_seq")


@register("click_history", with_views("""
SELECT user_id, list_concat(h, list_transform(range(0, 10 - len(h)), lambda x: CAST(0 AS BIGINT))) AS click_history
FROM (SELECT user_id, CASE WHEN len(x) > 10 THEN x[-10:] ELSE x END AS h FROM (
  SELECT user_id, arg_max(item_history, (ts, imp_id, item_id)) AS x FROM hist GROUP BY user_id))""", INST, HIST))
def q_click_history(spark, sf):
    return sq.click_history(sq.bounded_history(_inst(spark, sf), ORDER, 10), 10, order=ORDER)


@register("news_history", with_views("""
SELECT imp_id, item_id, list_concat(list_transform(range(0, 10 - len(item_history[1:10])), lambda x: CAST(0 AS BIGINT)),
       item_history[1:10]) AS item_history_10 FROM hist""", INST, HIST))
def q_news_history(spark, sf):
    return sq.news_history(sq.bounded_history(_inst(spark, sf), ORDER, 10, "first"), "item_history", 10, "first").select("imp_id", "item_id", "item_history_10")


BEH = ("beh", "SELECT imp_id, user_id, max(ts) AS ts, string_agg(CAST(item_id AS VARCHAR) || '-' || CAST(label AS VARCHAR), "
              "' ' ORDER BY item_id) AS imps FROM impressions GROUP BY imp_id, user_id")


@register("read_behaviors", with_views("""
SELECT imp_id, user_id, imps,
  list_transform(list_filter(string_split(imps, ' '), lambda x: x LIKE '%-1'), lambda x: string_split(x, '-')[1]) AS pos,
  list_transform(list_filter(string_split(imps, ' '), lambda x: x LIKE '%-0'), lambda x: string_split(x, '-')[1]) AS neg
FROM beh""", BEH))
def q_read_behaviors(spark, sf):
    b = sq.behaviors_from_impressions(fx.impressions(T(spark, sf)))
    return sq.parse_behaviors(b).select("imp_id", "user_id", "imps", "pos", "neg")


@register("explode_impressions", with_views("""
SELECT imp_id, coalesce(u.user_idx, 0) AS user_idx, CAST(g.p - 1 AS INTEGER) AS position,
       string_split(string_split(imps, ' ')[g.p], '-')[1] AS item,
       CAST(string_split(string_split(imps, ' ')[g.p], '-')[2] AS INTEGER) AS label
FROM beh b LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) AS user_idx FROM
  (SELECT DISTINCT user_id FROM ratings WHERE ts < (SELECT quantile_disc(ts, 0.5) FROM ratings))) u
  ON b.user_id = u.user_id, range(1, len(string_split(imps, ' ')) + 1) g(p)""", BEH))
def q_explode_impressions(spark, sf):
    from recoflow.operators.encode import index_ids
    from recoflow.operators.ordering import median_row
    t = T(spark, sf)
    r = fx.ratings(t)
    # users known from the first half of time get an index (1-based); the rest map to 0
    known = index_ids(r.join(F.broadcast(median_row(r, "ts"))).where(F.col("ts") < F.col("median")), "user_id", "user_idx", start=1)
    b = sq.behaviors_from_impressions(fx.impressions(t))
    return sq.explode_impressions(b, user_index=known).select("imp_id", "user_idx", "position", "item", "label")
