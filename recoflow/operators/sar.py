"""Smart Adaptive Recommendations (item similarity × user affinity), sparse and distributed.

Matrices are long-form DataFrames: affinity ``(user, item, value)``,
similarity ``(i1, i2, sim)``. The dense item × item array of a single-node
implementation is never built; blocks of users meet parts of the items, and the product is summed there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols
from recoflow.operators.ordering import global_rank, number_digits, rank_within
from recoflow.operators.pairs import item_pair_counts
from recoflow.operators.topk import topk_items
from recoflow.session import ensure_checkpoint_dir, written

COOCCUR, JACCARD, LIFT = "cooccurrence", "jaccard", "lift"


def time_decay(df: DataFrame, half_life: float, value: str, cols: Cols = DEFAULT,
               time_now: int | None = None) -> DataFrame:
    """Σ value · min(1, 0.5^((now - ts)/half_life)) per (user, item); now = max ts unless given."""
    if time_now is None:
        base = df.join(F.broadcast(df.agg(F.max(cols.timestamp).alias("_now"))))  # one row
    else:
        base = df.withColumn("_now", F.lit(time_now))
    w = F.least(F.lit(1.0), F.pow(F.lit(0.5), (F.col("_now") - F.col(cols.timestamp)) / F.lit(float(half_life))))
    return (base.groupBy(cols.user, cols.item)
            .agg(F.sum(F.col(value) * w).alias(value), F.max(cols.timestamp).alias(cols.timestamp)))


def affinity(df: DataFrame, cols: Cols = DEFAULT, half_life: float | None = None) -> DataFrame:
    """(user, item, affinity): decayed sum, or the latest rating per pair when no decay."""
    if half_life:
        dec = time_decay(df.select(cols.user, cols.item, cols.rating, cols.timestamp), half_life, cols.rating, cols)
        return dec.select(cols.user, cols.item, F.col(cols.rating).cast("double").alias("affinity"))
    latest = (df.groupBy(cols.user, cols.item)
              .agg(F.max_by(F.col(cols.rating), F.struct(cols.timestamp, cols.rating)).alias("affinity")))
    return latest.withColumn("affinity", F.col("affinity").cast("double"))


def cooccurrence(df: DataFrame, cols: Cols = DEFAULT, threshold: int = 1, block_size: int = 4096,
                 frequencies: bool = False) -> DataFrame:
    """(i1, i2, n), i1 <= i2, n >= threshold (smaller counts are 0, i.e. absent).

    With ``frequencies`` the numbers of users of the two items come along (f1, f2), so ``similarity`` joins nothing.
    """
    if threshold < 1:
        raise ValueError(f"a pair counts from one common user on; threshold {threshold} is too small")
    held = df.select(cols.user, cols.item)
    if not frequencies:
        return item_pair_counts(held, cols, threshold, block_size)
    users = held.where(F.col(cols.user).isNotNull()).distinct().groupBy(cols.item).agg(F.count(F.lit(1)).alias("_f"))
    return item_pair_counts(held, cols, threshold, block_size, users)


def similarity(cooc: DataFrame, kind: str = JACCARD) -> DataFrame:
    """(i1, i2, sim), i1 <= i2, from thresholded co-occurrence and its diagonal."""
    if kind == COOCCUR:
        return cooc.select("i1", "i2", F.col("n").cast("double").alias("sim"))
    if "f1" in cooc.columns and "f2" in cooc.columns:
        j = cooc
    else:
        j = _with_frequencies(cooc)
    if kind == JACCARD:
        sim = F.col("n") / (F.col("f1") + F.col("f2") - F.col("n"))
    elif kind == LIFT:
        sim = F.col("n") / (F.col("f1") * F.col("f2"))
    else:
        raise ValueError(f"no such item similarity: {kind!r}")
    return j.select("i1", "i2", sim.cast("double").alias("sim"))


def _with_frequencies(cooc: DataFrame) -> DataFrame:
    """Counts with f1 and f2 from their diagonal."""
    diag = cooc.where(F.col("i1") == F.col("i2")).select(F.col("i1").alias("_i"), F.col("n").alias("_f"))
    d1 = diag.select(F.col("_i").alias("i1"), F.col("_f").alias("f1"))
    d2 = diag.select(F.col("_i").alias("i2"), F.col("_f").alias("f2"))
    return cooc.join(d1, "i1").join(d2, "i2")


def symmetric(sim: DataFrame) -> DataFrame:
    """Upper triangle → both directions (src, dst, sim), diagonal once."""
    return sim.select(F.col("i1").alias("src"), F.col("i2").alias("dst"), "sim").unionByName(
        sim.where(F.col("i1") != F.col("i2")).select(F.col("i2").alias("src"), F.col("i1").alias("dst"), "sim"))


GRID_SIM = 1 << 23  # (src, dst) entries that a task of the grid holds
GRID_ROWS = 1 << 24  # affinities that meet them there
GRID_TERMS = 1 << 21  # products, or cells of users x items, that are summed at a time
GRID_OUT = 1 << 22  # scores that a task returns
HOT_USERS = 4096  # users whose scores a task sums at a time, at most


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(number of each value, the values by number); null is a value like any other."""
    coded = values.combine_chunks().dictionary_encode(null_encoding="encode")
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def _floats(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, 0 for null; which are not null)."""
    return np.asarray(values.fill_null(0.0)), np.asarray(values.is_valid())


def _near_top(k: int, remove_seen: bool, slack: float, out: pa.Schema):
    """Users and the similarities to some items -> every user's items with a score within ``slack`` of the k-th best, or over it."""
    def run(aff: pa.Table, sim: pa.Table) -> pa.Table:
        if not aff.num_rows or not sim.num_rows:
            return out.empty_table()
        src, sources = _codes(sim.column("src"))
        dst, items = _codes(sim.column("dst"))
        by_src = np.argsort(src, kind="stable")
        dst = dst[by_src]
        s, s_known = (x[by_src] for x in _floats(sim.column("sim")))
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(sources)))])
        user, users = _codes(aff.column("user"))
        held = aff.column("src").combine_chunks()
        at = np.asarray(pc.fill_null(pc.index_in(held, value_set=sources, skip_nulls=True), -1))
        own = np.asarray(pc.fill_null(pc.index_in(held, value_set=items, skip_nulls=True), -1))
        v, v_known = _floats(aff.column("value"))
        named = np.asarray(users.is_valid())
        by_user = np.argsort(user, kind="stable")
        user, at, own, v, v_known = (x[by_user] for x in (user, at, own, v, v_known))
        terms = np.where(at >= 0, first[at + 1] - first[at], 0)
        begin = np.searchsorted(user, np.arange(len(users) + 1))
        before = np.concatenate([[0], np.cumsum(terms)])[begin]
        step = max(1, GRID_TERMS // len(items))
        plain = bool(v_known.all() and s_known.all() and (v > 1e-100).all() and (s > 1e-100).all())
        found, lo = [], 0
        while lo < len(users):
            hi = min(lo + step, max(lo + 1, int(np.searchsorted(before, before[lo] + GRID_TERMS, "right")) - 1), len(users))
            rows = slice(begin[lo], begin[hi])
            n, cells = terms[rows], (hi - lo) * len(items)
            place = np.arange(n.sum())
            place += np.repeat(first[at[rows]] - (np.cumsum(n) - n), n)
            cell = dst[place]
            cell += np.repeat((user[rows] - lo) * len(items), n)
            if plain:  # a sum of positive terms is over 0
                total = np.bincount(cell, np.repeat(v[rows], n) * s[place], cells)
                there = some = total > 0
            else:
                row = np.repeat(np.arange(rows.start, rows.stop), n)
                known = v_known[row] & s_known[place]
                total = np.bincount(cell, np.where(known, v[row] * s[place], 0.0), cells)
                there, some = (np.bincount(c, minlength=cells) > 0 for c in (cell, cell[known]))
            there = there.copy()
            if remove_seen:
                mine = np.arange(rows.start, rows.stop)
                mine = mine[(own[rows] >= 0) & named[user[rows]]]
                there[(user[mine] - lo) * len(items) + own[mine]] = False
            total, there, some = (x.reshape(hi - lo, len(items)) for x in (total, there, some))
            if len(items) > k:  # a null or NaN score decides nothing here and stays
                counted = np.where(there & some & ~np.isnan(total), total, -np.inf)
                there &= ~(counted < np.partition(counted, len(items) - k, axis=1)[:, len(items) - k, None] - slack) | ~some
            u, i = np.nonzero(there)
            found.append((u + lo, i, total[u, i], some[u, i]))
            lo = hi
        u, i, total, some = (np.concatenate(x) for x in zip(*found))
        return pa.table([users.take(pa.array(u)), items.take(pa.array(i)), pa.array(total, mask=~some)], schema=out)
    return run


def top_scores(aff: DataFrame, sim: DataFrame, k: int, remove_seen: bool, digits: int, cols: Cols = DEFAULT) -> DataFrame:
    """(user, item, prediction): the k best items per user by score (see ``score``), rounded, then item.

    Users are dealt into blocks and items into parts. A block meets, in one task, all similarities to the items of a part: sums are
    made there and only rows that may be among the user's k best are shuffled, instead of a partial sum per (user, item) and task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType
    spark = aff.sparkSession
    aff = aff.where(F.col(cols.item).isNotNull())
    kinds = {f.name: f.dataType for f in aff.schema.fields}
    if kinds[cols.item] != sim.schema["i1"].dataType:
        sim = sim.select(*(F.col(c).cast(kinds[cols.item]).alias(c) for c in ("i1", "i2")), "sim")
    sim = written(sim.where("i1 IS NOT NULL AND i2 IS NOT NULL"), "sim")
    n_sim, n_aff = 2 * sim.count(), aff.count()  # the first from the files' footers
    parts = max(-(-n_sim // GRID_SIM), min(4 * spark.sparkContext.defaultParallelism, -(-n_sim // (1 << 16))), 1)
    blocks = max(1, -(-n_aff // GRID_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (aff.select(F.col(cols.user).alias("user"), F.col(cols.item).alias("src"), F.col("affinity").cast("double").alias("value"))
            .withColumn("_p", every(parts))
            .select((F.pmod(F.xxhash64("user"), F.lit(blocks)) * parts + F.col("_p")).cast("int").alias("g"), "user", "src", "value"))
    right = (symmetric(sim).withColumn("_b", every(blocks))
             .select((F.col("_b") * parts + F.pmod(F.xxhash64("dst"), F.lit(parts))).cast("int").alias("g"), "src", "dst", F.col("sim").cast("double").alias("sim")))
    out = StructType([StructField(cols.user, kinds[cols.user]), StructField(cols.item, kinds[cols.item]), StructField(cols.prediction, DoubleType())])
    near = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_near_top(k, remove_seen, 1.01 * 10.0**-digits, to_arrow_schema(out)), out)
    return topk_items(near.withColumn(cols.prediction, F.round(cols.prediction, digits)), k, cols, score=cols.prediction)


def _all_sums(values: list[str], carried: list[str], spread: bool, out: pa.Schema):
    """Users and the similarities to some items -> the sum of every value times the similarity, by user and item.

    With ``spread`` only the least and greatest of the last sum and their number, by user. ``carried`` columns are one value a user.
    """
    def run(aff: pa.Table, sim: pa.Table) -> pa.Table:
        if not aff.num_rows or not sim.num_rows:
            return out.empty_table()
        src, sources = _codes(sim.column("src"))
        dst, items = _codes(sim.column("dst"))
        by_src = np.argsort(src, kind="stable")
        dst = dst[by_src]
        s, s_known = (x[by_src] for x in _floats(sim.column("sim")))
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(sources)))])
        at = np.asarray(pc.fill_null(pc.index_in(aff.column("src").combine_chunks(), value_set=sources, skip_nulls=True), -1)).astype(np.int64)
        aff, at = aff.filter(pa.array(at >= 0)), at[at >= 0]
        user, users = _codes(aff.column("user"))
        by_user = np.argsort(user, kind="stable")
        user, at = user[by_user], at[by_user]
        v = [[x[by_user] for x in _floats(aff.column(name))] for name in values]
        begin = np.searchsorted(user, np.arange(len(users) + 1))
        told = [aff.column(c).take(pa.array(by_user[begin[:-1]])) for c in carried]
        n_terms = first[at + 1] - first[at]
        before = np.concatenate([[0], np.cumsum(n_terms)])[begin]
        step = max(1, min(HOT_USERS, GRID_TERMS // len(items)))
        found, lo = [], 0
        while lo < len(users):
            hi = min(lo + step, max(lo + 1, int(np.searchsorted(before, before[lo] + GRID_TERMS, "right")) - 1), len(users))
            rows = slice(begin[lo], begin[hi])
            n, cells = n_terms[rows], (hi - lo) * len(items)
            place = np.arange(n.sum()) + np.repeat(first[at[rows]] - (np.cumsum(n) - n), n)
            cell = dst[place] + np.repeat((user[rows] - lo) * len(items), n)
            held = np.flatnonzero(np.bincount(cell, minlength=cells))
            sums = []
            for value, known in v:
                both = np.repeat(known[rows], n) & s_known[place]
                plain = bool(both.all())
                terms = np.repeat(value[rows], n) * s[place]
                total = np.bincount(cell, terms if plain else np.where(both, terms, 0.0), cells)[held]
                sums.append((total, np.zeros(len(held), bool) if plain else np.bincount(cell[both], minlength=cells)[held] == 0))
            if spread:
                (total, none), u = sums[-1], held // len(items)
                u, total = u[~none], total[~none]
                least, most = np.full(hi - lo, np.inf), np.full(hi - lo, -np.inf)
                np.minimum.at(least, u, total)
                np.maximum.at(most, u, total)
                many = np.bincount(held // len(items), minlength=hi - lo)
                found.append((np.arange(lo, hi), least, most, many, np.isinf(least)))
            else:
                found.append((held // len(items) + lo, held % len(items), *(x for pair in sums for x in pair)))
            lo = hi
        got = [np.concatenate(x) for x in zip(*found)]
        if spread:
            u, least, most, many, none = got
            return pa.table([users.take(pa.array(u)), pa.array(least, mask=none), pa.array(most, mask=none), pa.array(many.astype(np.int64))], schema=out)
        u, i = got[:2]
        return pa.table([users.take(pa.array(u)), items.take(pa.array(i)), *(pa.array(x, mask=none) for x, none in zip(got[2::2], got[3::2])),
                         *(c.combine_chunks().take(pa.array(u)) for c in told)], schema=out)
    return run


def _grid(aff: DataFrame, sim: DataFrame, values: list[str], cols: Cols, carried: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """(user, item, *values, *carried): sums of values times similarities, whole where they are made; with ``spread`` (user, _umin, _umax, _nr) by part.

    Users are dealt into blocks and items into parts, and a block meets, in one task, all similarities to the items of a part; nothing of the
    result moves. The numbers of both keep a task's scores bounded and the copies of affinities and similarities about equal.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    kinds = {f.name: f.dataType for f in aff.schema.fields}
    both = symmetric(sim).where("src IS NOT NULL")
    held = aff.where(F.col(cols.item).isNotNull()).select(F.col(cols.user).alias("user"), F.col(cols.item).alias("src"),
                                                          *(F.col(v).cast("double").alias(v) for v in values), *carried)
    item = sim.schema["i1"].dataType
    if kinds[cols.item] != item:
        if kinds[cols.item].simpleString() in ("tinyint", "smallint", "int"):
            held = held.withColumn("src", F.col("src").cast(item))
        else:
            both = both.withColumn("src", F.col("src").cast(kinds[cols.item]))
    n_sim = both.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    met = held.groupBy("src").agg(F.count(F.lit(1)).alias("_u")).join(n_sim, "src", "left")
    r = met.agg(F.sum("_u").alias("a"), F.sum(F.col("_u") * F.col("_d")).alias("t"), F.sum("_d").alias("s")).first()
    n_aff, terms, n_sim = (int(r[c] or 0) for c in ("a", "t", "s"))
    cells = held.select("user").distinct().count() * both.select("dst").distinct().count()
    tasks = max(-(-min(terms, cells) // GRID_OUT), min(held.sparkSession.sparkContext.defaultParallelism, terms >> 16), 1)
    parts = max(1, min(tasks, round((tasks * n_sim / max(n_aff, 1)) ** 0.5)), -(-n_sim // GRID_SIM))
    blocks = max(1, -(-tasks // parts), -(-n_aff // GRID_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (held.withColumn("_p", every(parts))
            .withColumn("g", (F.pmod(F.xxhash64("user"), F.lit(blocks)) * parts + F.col("_p")).cast("int")).drop("_p"))
    right = (both.withColumn("_b", every(blocks))
             .select((F.col("_b") * parts + F.pmod(F.xxhash64("dst"), F.lit(parts))).cast("int").alias("g"), "src", "dst", F.col("sim").cast("double").alias("sim")))
    user = StructField(cols.user, kinds[cols.user])
    if spread:
        out = StructType([user, StructField("_umin", DoubleType()), StructField("_umax", DoubleType()), StructField("_nr", LongType())])
    else:
        out = StructType([user, StructField(cols.item, item), *(StructField(v, DoubleType()) for v in values), *(StructField(c, kinds[c]) for c in carried)])
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_all_sums(values, list(carried), spread, to_arrow_schema(out)), out)


def score(aff: DataFrame, sim: DataFrame, cols: Cols = DEFAULT, value: str = "affinity") -> DataFrame:
    """(user, item, score) = Σ_i affinity(user, i) · sim(i, item) over non-zero terms."""
    aff, sim = written(aff.select(cols.user, cols.item, F.col(value).alias("score")), "affinity"), written(sim.select("i1", "i2", "sim"), "sim")
    return _grid(aff, sim, ["score"], cols)


def score_normalized(train: DataFrame, sim: DataFrame, cols: Cols = DEFAULT,
                     half_life: float | None = None) -> DataFrame:
    """Scores rescaled per user to the rating range, as with unity-affinity min/max.

    A user's min over all catalogue items is 0 unless the user reaches every
    item. The spread of a user's unity scores is found first, so that scores are rescaled where they are made.
    """
    if half_life:
        decayed = train.withColumn("_one", F.lit(1.0))
        aff = affinity(train, cols, half_life).join(
            time_decay(decayed.select(cols.user, cols.item, "_one", cols.timestamp), half_life, "_one", cols)
            .select(cols.user, cols.item, "_one"), [cols.user, cols.item])
    else:
        aff = affinity(train, cols).withColumn("_one", F.lit(1.0))
    aff, sim = written(aff.select(cols.user, cols.item, "affinity", "_one"), "affinity"), written(sim.select("i1", "i2", "sim"), "sim")
    # one row: catalogue size and rating range
    whole = aff.agg(F.countDistinct(cols.item).alias("_ni"), F.min("affinity").alias("_rmin"), F.max("affinity").alias("_rmax"))
    per_user = (_grid(aff, sim, ["_one"], cols, spread=True).groupBy(cols.user)
                .agg(F.min("_umin").alias("_umin"), F.max("_umax").alias("_umax"), F.sum("_nr").alias("_nr"))
                .join(F.broadcast(whole))
                .withColumn("_umin", F.when(F.col("_nr") < F.col("_ni"), F.least(F.lit(0.0), F.col("_umin"))).otherwise(F.col("_umin"))))
    per_user = written(per_user.select(cols.user, (F.col("_umin") * F.col("_rmin")).alias("_lo"), (F.col("_umax") * F.col("_rmax")).alias("_hi"),
                                       "_rmin", "_rmax"), "spread")
    ends = ("_lo", "_hi", "_rmin", "_rmax")
    both = _grid(aff.join(per_user, cols.user), sim, ["affinity"], cols, ends)
    scaled = (F.col("affinity") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (F.col("_rmax") - F.col("_rmin")) + F.col("_rmin")
    return both.select(cols.user, cols.item, scaled.alias("score"))


def least_free(needs: DataFrame, taken: DataFrame, catalogue: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """(user, item): the first ``_need`` catalogue items, by id, that are not among the user's ``taken`` ones.

    needs: (user, _need); taken: (user, item); catalogue: (item). Gap search: the item at catalogue position p that is
    the user's j-th taken one has p - j free items before it, so the t-th free item stands at t plus the number of taken
    items with fewer than t free ones before them. Only counts per (user, gap) below the need are kept,
    at most ``_need`` a user; users x items is never built.
    """
    placed = global_rank(catalogue.select(cols.item).distinct(), [cols.item], rank_col="_p", total_col="_m")
    held = (taken.select(cols.user, cols.item).distinct().join(needs, cols.user)
            .join(placed.select(cols.item, "_p"), cols.item))
    ranked = rank_within(held, [cols.user], ["_p"], number_digits(held, "_p"), rank_col="_j", count_col="_c")
    gaps = (ranked.withColumn("_g", F.col("_p") - F.col("_j")).where(F.col("_g") < F.col("_need"))
            .groupBy(cols.user, "_g").agg(F.count(F.lit(1)).alias("_n")))
    told = gaps.groupBy(cols.user).agg(F.collect_list(F.struct("_g", "_n")).alias("_gs"))  # at most _need entries
    wanted = needs.join(told, cols.user, "left").select(cols.user, "_gs", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_need").cast("bigint"))).alias("_t"))
    passed = F.aggregate(F.filter(F.coalesce("_gs", F.array().cast("array<struct<_g:bigint,_n:bigint>>")), lambda x: x["_g"] < F.col("_t")),
                         F.lit(0).cast("bigint"), lambda acc, x: acc + x["_n"])
    return (wanted.select(cols.user, (F.col("_t") + passed).alias("_p")).join(placed.select(cols.item, "_p"), "_p")
            .select(cols.user, cols.item))


def recommend(train: DataFrame, sim: DataFrame, k: int = 10, remove_seen: bool = True,
              cols: Cols = DEFAULT, half_life: float | None = None, digits: int = 6, fill_zero: bool = False) -> DataFrame:
    """Top-k items per user by SAR score (rounded to ``digits`` for stable ties, then item).

    Items that share no user with any of a user's have score 0 and are left out; with ``fill_zero`` a
    user with fewer than k scored items gets the least ids among these others, at score 0, so everyone has k
    (or all unseen items of a smaller catalogue).
    """
    aff = affinity(train, cols, half_life)
    seen = aff.select(cols.user, cols.item)
    top = top_scores(aff, sim, k, remove_seen, digits, cols)
    if not fill_zero:
        return top
    ensure_checkpoint_dir(train.sparkSession)
    top = top.checkpoint(eager=True)  # at most k rows a user, read three times
    have = top.groupBy(cols.user).agg(F.count(F.lit(1)).alias("_h"))
    needs = (seen.select(cols.user).distinct().join(have, cols.user, "left")
             .select(cols.user, (F.lit(k) - F.coalesce("_h", F.lit(0))).alias("_need")).where("_need > 0"))
    needs = needs.checkpoint(eager=True)
    # a short user's scored items all are in its list, so seen and listed ones are what is taken
    short = top.select(cols.user, cols.item)
    taken = short.unionByName(seen) if remove_seen else short
    zero = least_free(needs, taken.join(needs.select(cols.user), cols.user, "left_semi"), train.select(cols.item), cols)
    return top.unionByName(zero.withColumn(cols.prediction, F.lit(0.0)).select(top.columns))


def item_based_topk(seeds: DataFrame, sim: DataFrame, k: int = 10, cols: Cols = DEFAULT,
                    weight: str | None = None, digits: int = 6) -> DataFrame:
    """Per seed set (user column groups the seeds): k most similar items, seeds removed."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aff = seeds.select(cols.user, cols.item, w.alias("affinity"))
    return top_scores(aff, sim, k, True, digits, cols)


BUSY_ITEMS = 4096  # items of a user from which asked pairs start from the item's neighbours


def predict(train: DataFrame, sim: DataFrame, pairs: DataFrame, cols: Cols = DEFAULT, busy_items: int = BUSY_ITEMS) -> DataFrame:
    """Scores of the requested (user, item) pairs; an item without a similar one of the user's scores 0.

    Each pair meets the user's own items and looks the similarity of the two up. The pairs of a user with more than
    ``busy_items`` items start from the asked item's neighbours instead and look the user's value up, so the work of a
    busy user does not grow with the square of the user's rows. A user without training data stops the job.
    """
    ensure_checkpoint_dir(train.sparkSession)
    aff = affinity(train, cols).select(cols.user, F.col(cols.item).alias("src"), "affinity")
    both = symmetric(sim).withColumnRenamed("dst", cols.item)
    asked = pairs.select(cols.user, cols.item).distinct()
    busy = (aff.groupBy(cols.user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > busy_items)
            .select(cols.user).checkpoint())
    met = asked.join(busy, cols.user, "left_anti").join(aff, cols.user).join(both, ["src", cols.item])
    if not busy.isEmpty():
        theirs = asked.join(busy, cols.user, "left_semi").join(both, cols.item).join(aff, [cols.user, "src"])
        met = met.unionByName(theirs)
    terms = met.groupBy(cols.user, cols.item).agg(F.sum(F.col("affinity") * F.col("sim")).alias("_s"))
    known = train.select(cols.user).distinct().withColumn("_known", F.lit(True))
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no training data for user "), F.col(cols.user).cast("string"))).cast("double"))
    return (pairs.join(known, cols.user, "left").join(terms, [cols.user, cols.item], "left")
            .withColumn(cols.prediction, checked.otherwise(F.coalesce("_s", F.lit(0.0)))).drop("_s", "_known"))
