"""Item-pair co-occurrence counts over users (the sparse product UᵀU).

A user with d items contributes d² ordered pairs, so one hot user (a third
of all rows) would put a quadratic share of the work into one task. The items
of a user with d > ``block_size`` are cut into ``ceil(d / block_size)`` hash
blocks on both sides of the self join, and every two blocks meet in a join
group of their own, of at most ``block_size²`` pairs. Each pair is produced
exactly once (in the group of its two blocks). Counting (``item_pair_counts``) shuffles
an item with the rest of its list instead of pairs, as few of them can be combined before the shuffle.

How the small table of heavy users is joined is left to the planner, which
knows its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols
from recoflow.session import written


def _blocks(ui: DataFrame, cols: Cols, block_size: int) -> DataFrame:
    deg = ui.groupBy(cols.user).agg(F.count(F.lit(1)).alias("_d"))
    heavy = (deg.where(F.col("_d") > block_size)
             .select(cols.user, F.ceil(F.col("_d") / block_size).cast("int").alias("_nb")))
    return ui.join(heavy, cols.user, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))


def user_item_pairs_within(ui: DataFrame, cols: Cols = DEFAULT, block_size: int = 4096,
                           strict: bool = False) -> DataFrame:
    """(user, i1, i2) with i1 <= i2 (i1 < i2 if ``strict``) for each user's distinct items."""
    ui = ui.select(cols.user, cols.item).distinct()
    b = _blocks(ui, cols, block_size)
    own = F.pmod(F.xxhash64(cols.item), F.col("_nb")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    left = b.select(cols.user, F.col(cols.item).alias("i1"), own.alias("_b1"), every.alias("_b2"))
    right = b.select(cols.user, F.col(cols.item).alias("i2"), own.alias("_b2"), every.alias("_b1"))
    cond = F.col("i1") < F.col("i2") if strict else F.col("i1") <= F.col("i2")
    return left.join(right, [cols.user, "_b1", "_b2"]).where(cond).select(cols.user, "i1", "i2")


PAIRS_A_TASK = 1 << 20  # (i1, i2) occurrences that a task counts; the number of tasks follows from the lists' lengths
HOT_ROWS = 1 << 16  # users of one item from which its partners are dealt over several tasks


def _lists(ui: DataFrame, cols: Cols, block_size: int, frequency: DataFrame | None) -> DataFrame:
    """(user, _b, _nb, _i, _f, _h): a user's distinct items in order, in hash blocks if there are more than ``block_size``.

    ``_h``: into how many parts the partners of each item are dealt; ``_f``: its ``frequency``, else null.
    """
    held = ui.select(cols.user, cols.item).where(F.col(cols.user).isNotNull() & F.col(cols.item).isNotNull()).distinct()
    users = held.groupBy(cols.item).agg(F.count(F.lit(1)).alias("_u"))
    if frequency is None:
        users = users.withColumn("_f", F.lit(None).cast("bigint"))
    else:
        known = frequency.toDF(cols.item, "_f") if frequency.columns != [cols.item, "_f"] else frequency
        users = users.join(known, cols.item)
    users = users.withColumn("_h", F.ceil(F.col("_u") / HOT_ROWS).cast("int")).drop("_u")
    b = _blocks(held, cols, block_size).withColumn("_b", F.pmod(F.xxhash64(cols.item), F.col("_nb")).cast("int")).join(users, cols.item)
    lists = b.groupBy(cols.user, "_b").agg(F.first("_nb").alias("_nb"), F.sort_array(F.collect_list(F.struct(F.col(cols.item).alias("i"), "_f", "_h"))).alias("_l"))
    return lists.select(cols.user, "_b", "_nb", F.col("_l.i").alias("_i"), F.col("_l._f").alias("_f"), F.col("_l._h").alias("_h"))


def item_pair_counts(ui: DataFrame, cols: Cols = DEFAULT, threshold: int = 1,
                     block_size: int = 4096, frequency: DataFrame | None = None) -> DataFrame:
    """(i1, i2, n) with i1 <= i2: number of users holding both; diagonal = item frequency.

    Each item of a list is sent to its task once with the rest of the list as an array; pairs are made there, where
    they are counted. The partners of an item of many users are dealt by hash. With ``frequency``
    (item, count) the two items' counts come along as ``f1`` and ``f2``.
    """
    lists = written(_lists(ui, cols, block_size, frequency), "lists")
    n_items = F.size("_i").cast("bigint")
    # own block: half of its square; every two blocks of a heavy user: together as many as the square of their sizes
    total = lists.agg(F.sum(n_items * F.least(n_items * F.col("_nb"), F.lit(1 << 40)))).first()[0] or 0
    tasks = max(1, -(-int(total) // (2 * PAIRS_A_TASK)))
    place = F.explode(F.sequence(F.lit(1), F.size("_i"))).alias("_p")
    head = [F.element_at("_i", F.col("_p")).alias("i1"), F.element_at("_f", F.col("_p")).alias("f1"), F.element_at("_h", F.col("_p")).alias("_n1")]
    tails = (lists.select("_i", "_f", "_h", place)
             .select(*head, *(F.slice(c, F.col("_p"), F.size("_i")).alias(o) for c, o in (("_i", "_i2"), ("_f", "_f2")))))
    heavy = lists.where("_nb > 1")
    if not heavy.isEmpty():
        other = heavy.select(cols.user, F.col("_b").alias("_ob"), F.col("_i").alias("_oi"), F.col("_f").alias("_of"))
        both = heavy.join(other, cols.user).where(F.col("_b") != F.col("_ob")).select("_i", "_f", "_h", "_oi", "_of", place)
        both = both.select(*head, "_oi", "_of")
        after = F.size(F.filter("_oi", lambda x: x < F.col("i1"))) + 1
        across = both.select("i1", "f1", "_n1", *(F.slice(c, after, F.size("_oi")).alias(o) for c, o in (("_oi", "_i2"), ("_of", "_f2"))))
        tails = tails.unionByName(across.where(F.size("_i2") > 0))
    plain = tails.where("_n1 = 1").withColumn("_part", F.lit(0))
    kept = F.filter(F.arrays_zip("_i2", "_f2"), lambda x: F.pmod(F.xxhash64(x["_i2"]), F.col("_n1")) == F.col("_part"))
    hot = (tails.where("_n1 > 1").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n1") - 1))).withColumn("_k", kept)
           .select("i1", "f1", "_n1", F.col("_k._i2").alias("_i2"), F.col("_k._f2").alias("_f2"), "_part"))
    if frequency is None:
        met = plain.unionByName(hot).select("i1", "_part", "_i2").repartition(tasks, "i1", "_part")
        pairs = met.select("i1", "_part", F.explode("_i2").alias("i2"))
        counts = pairs.groupBy("i1", "_part", "i2").agg(F.count(F.lit(1)).alias("n")).select("i1", "i2", "n")
    else:
        met = plain.unionByName(hot).select("i1", "_part", "f1", "_i2", "_f2").repartition(tasks, "i1", "_part")
        pairs = met.select("i1", "_part", "f1", F.inline(F.arrays_zip("_i2", "_f2")).alias("i2", "f2"))
        counts = (pairs.groupBy("i1", "_part", "i2").agg(F.count(F.lit(1)).alias("n"), F.max("f1").alias("f1"), F.max("f2").alias("f2"))
                  .select("i1", "i2", "n", "f1", "f2"))
    return counts.where(F.col("n") >= threshold) if threshold > 1 else counts
