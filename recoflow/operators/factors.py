"""Factor models and score post-processing: ALS, score shifts, re-ranks, vector scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from recoflow.cols import DEFAULT, Cols
from recoflow.functions.arrays import cosine, dot
from recoflow.functions.hashing import hash_key
from recoflow.operators.encode import blend_with_mean, index_ids, with_row
from recoflow.operators.topk import topk_items


@dataclass(frozen=True)
class AlsFit:
    """A fitted model and the dense numbers that stand for ids in it (so ids may be of any type and size)."""

    model: ALSModel
    users: DataFrame  # (user, _u)
    items: DataFrame  # (item, _i)


def als_fit(train: DataFrame, rank: int = 10, max_iter: int = 15, reg: float = 0.05, seed: int = 42,
            cols: Cols = DEFAULT, implicit: bool = False) -> AlsFit:
    users, items = index_ids(train, cols.user, "_u"), index_ids(train, cols.item, "_i")
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol="_u", itemCol="_i", ratingCol=cols.rating,
              coldStartStrategy="drop", nonnegative=False, implicitPrefs=implicit, seed=seed, checkpointInterval=2)  # exchanges of earlier iterations go then
    data = (train.join(users, cols.user).join(items, cols.item)
            .select(F.col("_u").cast("int"), F.col("_i").cast("int"), F.col(cols.rating).cast("float")))
    return AlsFit(als.fit(data), users, items)


GRID_USERS = 1 << 19  # users of a task of the grid, at most
GRID_ITEMS = 1 << 20  # items that meet them there, at most; every part returns k rows a user, so parts are few
GRID_RANK = 16  # beyond so many factors fewer users and items
STEP_USERS, STEP_ITEMS = 1 << 10, 1 << 12  # users and items that are scored at a time
_SCORED = StructType([StructField("_u", LongType()), StructField("_i", LongType()), StructField("_p", DoubleType())])


def _vectors(rows: pa.Table, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, their factors, the length of these), by falling length."""
    lists = rows.column("f").combine_chunks()
    f = np.asarray(lists.flatten(), np.float32).reshape(len(lists), -1)
    length = np.sqrt((f.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    return np.asarray(rows.column(of))[order], f[order], length[order]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of each row of x with that of y, summed in order and in single precision, as MLlib does."""
    total = np.zeros(len(x), np.float32)
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def _best_unseen(k: int, out: pa.Schema):
    """A block of users, what they have seen of a part of the items, and that part -> each user's k best unseen items of the part."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = left.filter(pc.is_valid(left.column("f")))
        if not known.num_rows or not right.num_rows:
            return out.empty_table()
        (users, uf, ul), (items, vf, vl) = _vectors(known, "u"), _vectors(right, "i")
        seen = left.filter(pc.is_null(left.column("f")))
        su, si = (np.asarray(pc.fill_null(pc.index_in(seen.column(c).combine_chunks(), value_set=pa.array(ids)), -1)).astype(np.int64)
                  for c, ids in (("u", users), ("i", items)))
        su, si = su[(su >= 0) & (si >= 0)], si[(su >= 0) & (si >= 0)]
        tile = su // STEP_USERS * len(items) + si // STEP_ITEMS
        order = np.argsort(tile, kind="stable")
        su, si, tile = su[order], si[order], tile[order]
        found, room = [], np.empty(STEP_USERS * STEP_ITEMS, np.float32)
        for lo in range(0, len(users), STEP_USERS):
            hi = min(lo + STEP_USERS, len(users))
            # sums in another order differ by less than the slack; the k-th best so far has ``least``
            slack, least = 1e-6 * uf.shape[1] * ul[lo:hi] * vl[0] + 1e-30, np.full(hi - lo, -np.inf)
            row, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            waiting = []
            for first in range(0, len(items), STEP_ITEMS):
                last = min(first + STEP_ITEMS, len(items))
                reach = (ul[lo:hi] * vl[first] >= least - slack).any()  # no product is over that of the lengths, and these fall
                if reach:
                    s = np.matmul(uf[lo:hi], vf[first:last].T, out=room[:(hi - lo) * (last - first)].reshape(hi - lo, last - first))
                    mine = slice(*np.searchsorted(tile, [lo // STEP_USERS * len(items) + first // STEP_ITEMS + j for j in (0, 1)]))
                    s[su[mine] - lo, si[mine] - first] = -np.inf
                    bound = np.partition(s, last - first - k, axis=1)[:, last - first - k] - slack if first == 0 and last > k else least
                    at = np.flatnonzero(s >= np.maximum(bound - slack, -3e38).astype(np.float32)[:, None])
                    waiting.append((at // (last - first), at % (last - first) + first))
                if waiting and (not reach or last == len(items) or first == 0 or sum(len(r) for r, _ in waiting) > k * (hi - lo)):
                    r, i = (np.concatenate(x) for x in zip(*waiting))
                    row, item, score = np.append(row, r), np.append(item, i), np.append(score, _products(uf[lo + r], vf[i]))
                    order = np.lexsort((items[item], -score, row))
                    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
                    row, item, score, waiting = row[order], item[order], score[order], []
                    have = np.bincount(row, minlength=hi - lo)
                    least[have == k] = score[np.cumsum(have)[have == k] - 1]
                if not reach:
                    break
            found.append((users[lo + row], items[item], score.astype(float)))
        return pa.table([np.concatenate(x) for x in zip(*found)], schema=out)
    return run


def als_recommend(fit: AlsFit, train: DataFrame, k: int = 10, cols: Cols = DEFAULT) -> DataFrame:
    """Top-k unseen items per user, exact: all users × items are scored, in blocks; no such table is stored or shuffled.

    Users are dealt into blocks and items into parts. A block meets a part in one task, with what its users have seen
    of the part; the task scores them piece by piece, long factors first, keeps what reaches a user's k-th best so far, and
    returns k rows a user. Factors are copied once per block or part, seen pairs not at all, so a heavy user lengthens no list.
    """
    spark = train.sparkSession
    user_f = fit.model.userFactors.select(F.col("id").cast("bigint").alias("u"), F.col("features").alias("f"))
    item_f = fit.model.itemFactors.select(F.col("id").cast("bigint").alias("i"), F.col("features").alias("f"))
    n_users, n_items = user_f.count(), item_f.count()
    wide = -(-int(item_f.agg(F.max(F.size("f"))).first()[0] or 1) // GRID_RANK)
    blocks = max(-(-n_users * wide // GRID_USERS), min(spark.sparkContext.defaultParallelism, -(-n_users // STEP_USERS)), 1)
    parts = max(-(-n_items * wide // GRID_ITEMS), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda b, p: (b * parts + p).cast("int").alias("g")
    block, part = F.col("u") % blocks, F.col("i") % parts
    seen = (train.select(cols.user, cols.item).distinct().join(fit.users, cols.user).join(fit.items, cols.item)
            .select(F.col("_u").cast("bigint").alias("u"), F.col("_i").cast("bigint").alias("i")))
    left = (user_f.withColumn("_c", every(parts)).select(cell(block, F.col("_c")), "u", F.lit(None).cast("bigint").alias("i"), "f")
            .unionByName(seen.select(cell(block, part), "u", "i", F.lit(None).cast("array<float>").alias("f"))))
    right = item_f.withColumn("_c", every(blocks)).select(cell(F.col("_c"), part), "i", "f")
    met = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_best_unseen(k, to_arrow_schema(_SCORED)), _SCORED)
    top = topk_items(met, k, Cols(user="_u", item="_i"), score="_p")  # numbers follow the order of ids: ties are by id
    return (top.join(fit.users, "_u").join(fit.items, "_i")
            .select(cols.user, cols.item, F.col("_p").alias(cols.prediction)))


def combination_recommend(train: DataFrame, k: int = 10, weight: float = 0.4, pool: int = 20, cols: Cols = DEFAULT) -> DataFrame:
    """ALS on ratings blended with their mean, then the pair-combination re-rank of each user's best ``pool``."""
    fit = als_fit(blend_with_mean(train, weight, cols=cols), cols=cols)
    return pair_combination_rerank(als_recommend(fit, train, pool, cols), pool, k, cols=cols)


def shift_scores(scored: DataFrame, k: int = 10, seed: int = 42, cols: Cols = DEFAULT) -> DataFrame:
    """Scores + global mean score; the top-k list re-ordered at random (md5), rank 1..k."""
    mean = scored.agg(F.avg(cols.prediction).alias("_mean"))
    top = topk_items(scored, k, cols)
    w = Window.partitionBy(cols.user).orderBy(hash_key(seed, cols.user, cols.item), cols.item)
    return (with_row(top, mean).withColumn(cols.prediction, F.col(cols.prediction) + F.col("_mean")).drop("_mean")
            .withColumn("rank", F.row_number().over(w).cast("bigint")))


def combined_shift_rerank(scored: DataFrame, k: int = 10, cols: Cols = DEFAULT) -> DataFrame:
    """Scores + global mean, then the k best per user."""
    mean = scored.agg(F.avg(cols.prediction).alias("_mean"))
    shifted = with_row(scored, mean).withColumn(cols.prediction, F.col(cols.prediction) + F.col("_mean")).drop("_mean")
    return topk_items(shifted, k, cols)


def pair_combination_rerank(scored: DataFrame, top_n: int = 20, k: int = 10, seed: int = 42,
                            cols: Cols = DEFAULT) -> DataFrame:
    """Per user: the top_n items; ordered pairs of different items with pair score = mean of
    the two; equal pair scores within a user kept once (smallest pair); pairs drawn in md5
    order and the second item of each drawn pair kept, first k distinct items.

    Work per user is bounded by top_n², a parameter, not by the user's data.
    """
    top = topk_items(scored, top_n, cols)
    a = top.select(cols.user, F.col(cols.item).alias("a_item"), F.col(cols.prediction).alias("a_pred"))
    b = top.select(cols.user, F.col(cols.item).alias("b_item"), F.col(cols.prediction).alias("b_pred"))
    pairs = (a.join(b, cols.user).where(F.col("a_item") != F.col("b_item"))
             .withColumn("comb", (F.col("a_pred") + F.col("b_pred")) / 2))
    dedup = (pairs.groupBy(cols.user, "comb")
             .agg(F.min(F.struct("a_item", "b_item", "b_pred")).alias("_p"))
             .select(cols.user, "_p.*"))
    drawn = dedup.withColumn("_h", hash_key(seed, cols.user, "a_item", "b_item"))
    per_item = drawn.groupBy(cols.user, "b_item").agg(F.min("_h").alias("_h"), F.first("b_pred").alias("b_pred"))
    w = Window.partitionBy(cols.user).orderBy("_h", "b_item")
    return (per_item.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .select(cols.user, F.col("b_item").alias(cols.item), F.col("b_pred").alias(cols.prediction)))


def factor_predict(pairs: DataFrame, user_f: DataFrame, item_f: DataFrame, mean: float,
                   cols: Cols = DEFAULT, feature_col: str = "features") -> DataFrame:
    """L_u · R_i + train mean for the requested pairs."""
    u = user_f.select(cols.user, F.col(feature_col).alias("_u"))
    i = item_f.select(cols.item, F.col(feature_col).alias("_i"))
    return (pairs.join(u, cols.user).join(i, cols.item)
            .withColumn(cols.prediction, dot("_u", "_i") + F.lit(mean)).drop("_u", "_i"))


def dot_scores(rows: DataFrame, user_f: DataFrame, item_f: DataFrame, cols: Cols = DEFAULT,
               feature_col: str = "features", out: str = "score") -> DataFrame:
    u = user_f.select(cols.user, F.col(feature_col).alias("_u"))
    i = item_f.select(cols.item, F.col(feature_col).alias("_i"))
    return rows.join(u, cols.user).join(i, cols.item).withColumn(out, dot("_u", "_i")).drop("_u", "_i")


def group_softmax_scores(rows: DataFrame, user_f: DataFrame, item_f: DataFrame, group: str,
                         cols: Cols = DEFAULT, feature_col: str = "features") -> DataFrame:
    """Cosine of source (user) and candidate vectors, softmax within each group.

    Cosines lie in [-1, 1], so they need no shift by the group's maximum; the group's sum is a partial aggregate.
    """
    u = user_f.select(cols.user, F.col(feature_col).alias("_u"))
    i = item_f.select(cols.item, F.col(feature_col).alias("_i"))
    s = rows.join(u, cols.user).join(i, cols.item).withColumn("_c", cosine("_u", "_i")).drop("_u", "_i")
    whole = s.groupBy(F.col(group).alias("_g")).agg(F.sum(F.exp("_c")).alias("_sum"))
    return (s.join(whole, F.col(group).eqNullSafe(F.col("_g"))).withColumn("score", F.exp("_c") / F.col("_sum"))
            .drop("_c", "_g", "_sum"))


def embedding_similar(vectors: DataFrame, query_id, n: int = 10, id_col: str = "item_id",
                      feature_col: str = "features") -> DataFrame:
    """The n items most cosine-similar to one given item vector (itself removed).

    The single query vector travels as a literal; the scan is one pass."""
    row = vectors.where(F.col(id_col) == F.lit(query_id)).select(feature_col).first()
    if row is None:
        raise ValueError(f"unknown id {query_id}")
    qv = F.array(*[F.lit(float(x)) for x in row[0]])  # one vector: a literal of fixed size
    s = vectors.where(F.col(id_col) != F.lit(query_id)).select(id_col, cosine(feature_col, qv).alias("similarity"))
    return s.orderBy(F.col("similarity").desc(), F.col(id_col)).limit(n)


def bilinear_scores(users: DataFrame, items: DataFrame, pairs: DataFrame, w: list[list[float]],
                    b: list[list[float]], w_items: list[list[float]] | None = None, output: str = "score", k: int = 10,
                    cols: Cols = DEFAULT, feature_col: str = "features") -> DataFrame:
    """score = (x W) B (z W')ᵀ of the requested pairs; W, W' (d×r) and the symmetric positive B (r×r) are small parameters.

    √B is split over both sides. output: "score"; "mean": 1 above the mean score
    of the pairs, else 0; "topk": 1 for a user's k best pairs (ties by item), else 0.
    """
    import numpy as np

    if output not in ("score", "mean", "topk"):
        raise ValueError(f"no such output: {output!r}")
    values, vectors = np.linalg.eigh(np.asarray(b, float))
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T

    def project(matrix):
        rows = (np.asarray(matrix, float) @ root).T.tolist()
        return F.array(*[F.aggregate(F.zip_with(F.col(feature_col), F.array(*[F.lit(v) for v in row]),
                                                lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, v: a + v)
                         for row in rows])
    u = users.select(cols.user, project(w).alias("_u"))
    i = items.select(cols.item, project(w if w_items is None else w_items).alias("_i"))
    out = pairs.join(u, cols.user).join(i, cols.item).withColumn("score", dot("_u", "_i")).drop("_u", "_i")
    if output == "mean":
        mean = out.agg(F.avg("score").alias("_m"))  # one row
        return out.join(F.broadcast(mean)).withColumn("score", (F.col("score") > F.col("_m")).cast("double")).drop("_m")
    if output == "topk":
        best = topk_items(out, k, cols, score="score").select(cols.user, cols.item, F.lit(1.0).alias("_b"))
        return out.join(best, [cols.user, cols.item], "left").withColumn("score", F.coalesce("_b", F.lit(0.0))).drop("_b")
    return out
