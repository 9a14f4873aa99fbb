"""Candidate generation and negative sampling queries."""

from pyspark.sql import functions as F

from recoflow.functions.hashing import sql_hash_int, sql_hash_key
from recoflow.operators import candidates as cd
from recoflow.registry import register
from recoflow.registry.common import K, SQL_TRAIN_TEST, T, train_test
from recoflow.sources import fixtures as fx
from recoflow.sources.fixtures import with_views


def tv(body, *extra):
    return with_views(body, *SQL_TRAIN_TEST, *extra)


def cat_sql(name, src, seed):
    return (name, f"SELECT item_id, row_number() OVER (ORDER BY {sql_hash_key(seed, 'item_id')}, item_id) - 1 AS ipos,"
                  f" count(*) OVER () AS ni FROM (SELECT DISTINCT item_id FROM {src})")


def walk_sql(p, quota, seen, cat, seed):
    """CTEs producing {p}negs(user_id, j, item_id) (see candidates.unseen_walk)."""
    return (
        (f"{p}cseen", f"SELECT DISTINCT user_id, item_id FROM {seen} WHERE item_id IN (SELECT item_id FROM {cat})"),
        (f"{p}ns", f"SELECT user_id, count(*) AS ns FROM {p}cseen GROUP BY user_id"),
        (f"{p}q", f"SELECT * FROM (SELECT a.user_id, a.need, coalesce(b.ns, 0) AS ns, n.ni - coalesce(b.ns, 0) AS pool,"
                  f" n.ni FROM {quota} a LEFT JOIN {p}ns b ON a.user_id = b.user_id,"
                  f" (SELECT max(ni) AS ni FROM {cat}) n) WHERE pool > 0 AND need > 0"),
        (f"{p}walk", f"SELECT user_id, step, (h + step) % ni AS ipos FROM (SELECT user_id, ni, "
                     f"{sql_hash_int(seed, 'user_id')} % ni AS h, unnest(range(0, least(ns + least(need, pool), ni)))"
                     f" AS step FROM {p}q)"),
        (f"{p}cand", f"SELECT w.user_id, c.item_id, row_number() OVER (PARTITION BY w.user_id ORDER BY w.step) - 1 AS r,"
                     f" count(*) OVER (PARTITION BY w.user_id) AS nc FROM {p}walk w JOIN {cat} c ON w.ipos = c.ipos"
                     f" WHERE NOT EXISTS (SELECT 1 FROM {p}cseen s WHERE s.user_id = w.user_id"
                     f" AND s.item_id = c.item_id)"),
        (f"{p}slots", f"SELECT user_id, unnest(range(0, need)) AS j FROM {p}q"),
        (f"{p}negs", f"SELECT s.user_id, s.j, c.item_id FROM {p}slots s JOIN (SELECT DISTINCT user_id, nc FROM {p}cand) a"
                     f" ON s.user_id = a.user_id JOIN {p}cand c ON c.user_id = s.user_id AND c.r = s.j % a.nc"),
    )


@register("filter_by", tv("SELECT user_id, item_id FROM ratings r WHERE NOT EXISTS "
                          "(SELECT 1 FROM test t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)"))
def q_filter_by(spark, sf):
    _, test = train_test(spark, sf)
    return cd.filter_by(fx.ratings(T(spark, sf)).select("user_id", "item_id"), test, ["user_id", "item_id"])


@register("remove_seen", tv("SELECT p.user_id, p.item_id, round(p.prediction, 6) AS prediction FROM predictions p "
                            "WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = p.user_id "
                            "AND t.item_id = p.item_id)"))
def q_remove_seen(spark, sf):
    train, _ = train_test(spark, sf)
    out = cd.remove_seen(fx.predictions(T(spark, sf)), train)
    return out.withColumn("prediction", F.round("prediction", 6))


@register("random_recommend", tv(f"""
SELECT user_id, item_id, CAST(score AS DOUBLE) AS score FROM (
  SELECT w.user_id, c.item_id, row_number() OVER (PARTITION BY w.user_id ORDER BY w.off) AS score
  FROM (SELECT user_id, (h + off) % ni AS ipos, off FROM (
          SELECT u.user_id, n.ni, {sql_hash_int(42, 'u.user_id')} % n.ni AS h,
                 unnest(range(0, least(u.seen + {K}, n.ni))) AS off
          FROM (SELECT user_id, count(*) AS seen FROM train GROUP BY user_id) u,
               (SELECT max(ni) AS ni FROM cat) n)) w
  JOIN cat c ON w.ipos = c.ipos
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = w.user_id AND t.item_id = c.item_id))
WHERE score <= {K}""", cat_sql("cat", "train", 42)))
def q_random_recommend(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.random_recommend(train, K, seed=42)


@register("negative_sample", tv(f"""
SELECT user_id, item_id, 1 AS feedback FROM pos
UNION ALL
SELECT user_id, item_id, 0 FROM (
  SELECT w.user_id, c.item_id, w.neg, row_number() OVER (PARTITION BY w.user_id ORDER BY c.item_id) AS r
  FROM (SELECT user_id, neg, (h + step) % ni AS ipos FROM (
          SELECT pu.user_id, pu.neg, n.ni, {sql_hash_int(42, 'pu.user_id')} % n.ni AS h,
                 unnest(range(0, least(pu.n + pu.neg, n.ni))) AS step
          FROM pu, (SELECT max(ni) AS ni FROM cat) n)) w
  JOIN cat c ON w.ipos = c.ipos
  WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id = w.user_id AND p.item_id = c.item_id))
WHERE r <= neg""",
    ("pos", "SELECT DISTINCT user_id, item_id FROM train"), cat_sql("cat", "pos", 42),
    ("pu", "SELECT user_id, count(*) AS n, greatest(1, CAST(round_even(count(*) * 2.0, 0) AS BIGINT)) AS neg "
           "FROM pos GROUP BY user_id")))
def q_negative_sample(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.negative_sample(train, 2.0, seed=42)


def _neg_per_row_sql(n, seen_cte, target_cte):
    """per row of {target_cte}: n negatives, fewer for a user whose pool is smaller (shared per-user walk, in chunks)."""
    return (
        ("neff", f"SELECT u.user_id, least({n}, ni - coalesce(s.c, 0)) AS n FROM (SELECT DISTINCT user_id FROM {target_cte}) u "
                 f"LEFT JOIN (SELECT user_id, count(*) AS c FROM {seen_cte} WHERE item_id IN (SELECT item_id FROM cat) "
                 "GROUP BY user_id) s ON u.user_id = s.user_id, (SELECT max(ni) AS ni FROM cat) n"),
        ("idx", f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS q "
                f"FROM {target_cte}"),
        ("quota", "SELECT i.user_id, count(*) * any_value(e.n) AS need FROM idx i JOIN neff e ON i.user_id = e.user_id "
                  "GROUP BY i.user_id"),
    ) + walk_sql("w_", "quota", seen_cte, "cat", 42)


_NEG_OUT = ("SELECT i.user_id, i.item_id, n.item_id AS neg_item FROM idx i JOIN neff e ON i.user_id = e.user_id "
            "JOIN w_negs n ON i.user_id = n.user_id AND i.q = n.j // e.n")


@register("train_negatives", tv(_NEG_OUT, ("tr", "SELECT DISTINCT user_id, item_id FROM train"),
                                cat_sql("cat", "tr", 42), *_neg_per_row_sql(4, "tr", "tr")))
def q_train_negatives(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.train_negatives(train, 4, seed=42)


@register("test_negatives", tv(_NEG_OUT, ("tr", "SELECT DISTINCT user_id, item_id FROM train"),
                               ("te", "SELECT DISTINCT user_id, item_id FROM test"),
                               ("seen", "SELECT * FROM tr UNION SELECT * FROM te"),
                               cat_sql("cat", "tr", 42), *_neg_per_row_sql(100, "seen", "te")))
def q_test_negatives(spark, sf):
    train, test = train_test(spark, sf)
    return cd.test_negatives(train, test, 100, seed=42)


@register("bpr_triples", tv(
    "SELECT o.user_id, o.pos_item, n.item_id AS neg_item FROM "
    f"(SELECT user_id, arg_min(item_id, {sql_hash_key(42, 'user_id', 'item_id')}) AS pos_item FROM tr "
    "GROUP BY user_id) o JOIN w_negs n ON o.user_id = n.user_id",
    ("tr", "SELECT DISTINCT user_id, item_id FROM train"), cat_sql("cat", "tr", 43),
    ("quota", "SELECT DISTINCT user_id, 1 AS need FROM tr"), *walk_sql("w_", "quota", "tr", "cat", 43)))
def q_bpr_triples(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.bpr_triples(train, seed=42)


def _imp_sql(k, padded):
    neg = ("negi", f"SELECT imp_id, item_id, row_number() OVER (PARTITION BY imp_id ORDER BY "
                   f"{sql_hash_key(42, 'imp_id', 'item_id')}, item_id) - 1 AS r, count(*) OVER (PARTITION BY imp_id) AS m "
                   "FROM impressions WHERE label = 0")
    pos = ("posi", f"SELECT imp_id, user_id, item_id AS pos_item, row_number() OVER (PARTITION BY imp_id ORDER BY "
                   f"{sql_hash_key(42, 'imp_id', 'item_id')}, item_id) - 1 AS q FROM impressions WHERE label = 1")
    slots = ("slots", "SELECT p.imp_id, p.user_id, p.pos_item, p.q, coalesce(m.m, 0) AS m, unnest(range(0, " + str(k) + ")) AS t "
                      f"FROM posi p {'LEFT ' if padded else ''}JOIN (SELECT DISTINCT imp_id, m FROM negi) m ON p.imp_id = m.imp_id")
    if padded:
        body = (f"SELECT s.imp_id, s.user_id, s.pos_item, CAST(s.t AS INTEGER) AS slot, "
                "coalesce(n.item_id, 0) AS neg_item FROM (SELECT *, CASE WHEN m < " + str(k) +
                " THEN CASE WHEN t < m THEN t END ELSE (q * " + str(k) + " + t) % m END AS r FROM slots) s "
                "LEFT JOIN negi n ON s.imp_id = n.imp_id AND s.r = n.r")
    else:
        body = ("SELECT s.imp_id, s.user_id, s.pos_item, CAST(s.t AS INTEGER) AS slot, n.item_id AS neg_item FROM slots s "
                "JOIN negi n ON s.imp_id = n.imp_id AND n.r = (s.q * " + str(k) + " + s.t) % s.m")
    return with_views(body, neg, pos, slots)


@register("impression_negatives", _imp_sql(4, False))
def q_impression_negatives(spark, sf):
    return cd.impression_negatives(fx.impressions(T(spark, sf)), 4, seed=42)


@register("impression_negatives_padded", _imp_sql(4, True))
def q_impression_negatives_padded(spark, sf):
    return cd.impression_negatives(fx.impressions(T(spark, sf)), 4, seed=42, padded=True)


@register("batch_negatives", tv("""
SELECT c.user_id, c.item_id, c.pos_item, CAST(s.t AS INTEGER) AS slot, c.neg_item FROM (
  SELECT b, q, nv, unnest(range(0, 4)) AS t FROM (SELECT DISTINCT b, q, nv FROM cand)) s
JOIN cand c ON c.b = s.b AND c.q = s.q AND c.c = s.t % s.nv""",
    ("g", "SELECT user_id, item_id, (row_number() OVER (ORDER BY user_id, item_id) - 1) // 64 AS b, "
          "(row_number() OVER (ORDER BY user_id, item_id) - 1) % 64 AS q FROM train"),
    ("gm", "SELECT g.*, m.m FROM g JOIN (SELECT b, count(*) AS m FROM g GROUP BY b) m ON g.b = m.b"),
    ("me", "SELECT b, q, m, user_id, item_id, item_id AS pos_item, unnest(range(1, greatest(1, m - 1) + 1)) AS s FROM gm"),
    ("cand", "SELECT me.b, me.q, me.user_id, me.item_id, me.pos_item, o.item_id AS neg_item, "
             "row_number() OVER (PARTITION BY me.b, me.q ORDER BY me.s) - 1 AS c, "
             "count(*) OVER (PARTITION BY me.b, me.q) AS nv FROM me JOIN g o ON o.b = me.b AND o.q = (me.q + me.s) % me.m "
             "WHERE o.item_id <> me.pos_item")))
def q_batch_negatives(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.batch_negatives(train.select("user_id", "item_id"), 4, 64, ["user_id", "item_id"])


_POPKEY = f"-ln(({sql_hash_int(42, 'item_id')} + 0.5) / 1152921504606846976.0) / c"


@register("popularity_item_sample", tv(f"""
SELECT user_id, item_id FROM train WHERE item_id IN (
  SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY {_POPKEY}, item_id) AS r,
                              count(*) OVER () AS n FROM (SELECT item_id, count(*) AS c FROM train GROUP BY item_id))
  WHERE r <= CAST(floor(n * 0.3) AS BIGINT))"""))
def q_popularity_item_sample(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.popularity_item_sample(train.select("user_id", "item_id"), 0.3, seed=42)


# The alias table once more, by plain windows and inequality joins, and the first four different of 64 draws.
_ALIAS = (
    ("cnt", "SELECT item_id, count(*) AS c FROM train GROUP BY item_id"),
    ("tot", "SELECT count(*) AS n, CAST(sum(c) AS HUGEINT) AS t FROM cnt"),
    ("weight", "SELECT item_id, c * n - t AS w FROM cnt, tot"),
    ("rare", "SELECT item_id, -w AS d, sum(-w) OVER (ORDER BY item_id) + w AS before, row_number() OVER (ORDER BY item_id) - 1 AS i FROM weight WHERE w < 0"),
    ("often", "SELECT item_id, sum(w) OVER (ORDER BY item_id) AS upto, row_number() OVER (ORDER BY item_id) - 1 AS j FROM weight WHERE w >= 0"),
    ("low", "SELECT r.i AS slot, r.item_id AS own, t - r.d AS cut, o.item_id AS alias FROM (SELECT r.i, min(o.j) AS j FROM rare r "
            "JOIN often o ON o.upto >= r.before GROUP BY r.i) g JOIN rare r ON r.i = g.i JOIN often o ON o.j = g.j, tot"),
    ("outrun", "SELECT o.j, min(r.before + r.d) AS stop FROM often o JOIN rare r ON r.before + r.d > o.upto GROUP BY o.j"),
    ("high", "SELECT (SELECT count(*) FROM rare) + o.j AS slot, o.item_id AS own, CASE WHEN u.stop IS NULL OR x.item_id IS NULL THEN t ELSE t - (u.stop - o.upto) END AS cut, "
             "coalesce(x.item_id, o.item_id) AS alias FROM often o LEFT JOIN outrun u ON u.j = o.j LEFT JOIN often x ON x.j = o.j + 1, tot"),
    ("al", "SELECT * FROM low UNION ALL SELECT * FROM high"),
    ("inst", "SELECT DISTINCT user_id, item_id FROM train"),
    ("draws", f"SELECT user_id, item_id, j, {sql_hash_int(42, 'user_id', 'item_id', 'j')} % n AS slot, "
              f"{sql_hash_int(43, 'user_id', 'item_id', 'j')} % CAST(t AS BIGINT) AS u FROM inst, range(64) g(j), tot"),
    ("hits", "SELECT user_id, item_id, j, CASE WHEN u < cut THEN own ELSE alias END AS neg_item FROM draws JOIN al ON draws.slot = al.slot"),
)


@register("popularity_negatives", tv("""
SELECT user_id, item_id, CAST(r - 1 AS INTEGER) AS slot, neg_item FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY j) AS r FROM (
    SELECT user_id, item_id, neg_item, min(j) AS j FROM hits WHERE neg_item <> item_id GROUP BY user_id, item_id, neg_item))
WHERE r <= 4""", *_ALIAS))
def q_popularity_negatives(spark, sf):
    train, _ = train_test(spark, sf)
    return cd.popularity_negatives(train.select("user_id", "item_id"), 4, seed=42)
