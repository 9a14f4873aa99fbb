"""Encoding and feature operators: indexes, vocabularies, rescaling, CTR encoders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from recoflow.cols import DEFAULT, Cols
from recoflow.functions.hashing import hash_bucket
from recoflow.operators.ordering import global_rank, rank_within

LESS, UNK = "<LESS>", "<UNK>"


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate, in the same plan (no job of its own)."""
    return df.join(F.broadcast(row))


def index_ids(df: DataFrame, col: str, idx_col: str | None = None, start: int = 0) -> DataFrame:
    """(value, index): contiguous index over the sorted distinct values (exact, distributed)."""
    idx_col = idx_col or f"{col}_idx"
    d = df.select(col).distinct()
    return global_rank(d, [col]).select(col, (F.col("_grank") - 1 + start).alias(idx_col))


def frequency_vocab(df: DataFrame, col: str, start: int = 0) -> DataFrame:
    """(value, count, index): values by descending count (ties by value), index from ``start``."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).withColumn("_neg", -F.col("count"))
    return global_rank(c, ["_neg", col]).select(col, "count", (F.col("_grank") - 1 + start).alias("index"))


def affinity_matrix(df: DataFrame, cols: Cols = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long-form sparse matrix (user_idx, item_idx, rating) plus the two index tables."""
    ui = index_ids(df, cols.user, "user_idx")
    ii = index_ids(df, cols.item, "item_idx")
    m = df.join(ui, cols.user).join(ii, cols.item).select("user_idx", "item_idx", cols.rating)
    return m, ui, ii


def sparsity(df: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """Share of empty cells of the user × item matrix, in percent."""
    s = df.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(cols.user).alias("_u"),
               F.countDistinct(cols.item).alias("_i"))
    return s.select(((1 - F.col("_n") / (F.col("_u") * F.col("_i"))) * 100).alias("sparsity"))


def affinity_to_ratings(m: DataFrame, ui: DataFrame, ii: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    return m.where(F.col(cols.rating) != 0).join(ui, "user_idx").join(ii, "item_idx").select(
        cols.user, cols.item, cols.rating)


def implicit_feedback(df: DataFrame, threshold: float = 3.0, cols: Cols = DEFAULT) -> DataFrame:
    """rating > threshold → 1 else 0."""
    return df.withColumn(cols.rating, F.when(F.col(cols.rating) > threshold, 1).otherwise(0))


def rescale(df: DataFrame, col: str, new_min: float = 0.0, new_max: float = 1.0, by: str | None = None,
            data_min: float | None = None, data_max: float | None = None) -> DataFrame:
    """Min-max rescale to [new_min, new_max], over the table or per ``by`` group."""
    if by:
        stats = df.groupBy(by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        base = df.join(stats, by)
    else:
        base = with_row(df, df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")))
    lo = F.lit(data_min) if data_min is not None else F.col("_lo")
    hi = F.lit(data_max) if data_max is not None else F.col("_hi")
    return base.withColumn(col, (F.col(col) - lo) / (hi - lo) * (new_max - new_min) + new_min).drop("_lo", "_hi")


def decayed_popularity(df: DataFrame, half_life: float, cols: Cols = DEFAULT) -> DataFrame:
    """Σ min(1, 0.5^((max_ts − ts)/half_life)) per item."""
    df = with_row(df, df.agg(F.max(cols.timestamp).alias("_now")))
    w = F.least(F.lit(1.0), F.pow(F.lit(0.5), (F.col("_now") - F.col(cols.timestamp)) / F.lit(float(half_life))))
    return df.groupBy(cols.item).agg(F.sum(w).alias("popularity"))


def blend_with_mean(df: DataFrame, alpha: float, train: DataFrame | None = None, cols: Cols = DEFAULT) -> DataFrame:
    """α·rating + (1−α)·mean(train rating)."""
    mean = (train if train is not None else df).agg(F.avg(cols.rating).alias("_mean"))
    return with_row(df, mean).withColumn(cols.rating, F.lit(alpha) * F.col(cols.rating) + F.lit(1 - alpha) * F.col("_mean")).drop("_mean")


def mean_center(df: DataFrame, train: DataFrame | None = None, cols: Cols = DEFAULT) -> DataFrame:
    mean = (train if train is not None else df).agg(F.avg(cols.rating).alias("_mean"))
    return with_row(df, mean).withColumn(cols.rating, F.col(cols.rating) - F.col("_mean")).drop("_mean")


def target_transform(df: DataFrame, mode: str = "normalize", cols: Cols = DEFAULT) -> DataFrame:
    """'normalize': rating / √Σ rating²; 'binarize': 1 if rating > 3 else 0."""
    if mode == "binarize":
        return df.withColumn(cols.rating, F.when(F.col(cols.rating) > 3, 1.0).otherwise(0.0))
    norm = df.agg(F.sqrt(F.sum(F.col(cols.rating) * F.col(cols.rating))).alias("_norm"))
    return with_row(df, norm).withColumn(cols.rating, F.col(cols.rating) / F.col("_norm")).drop("_norm")


def rare_to_less_table(df: DataFrame, col: str, threshold: int = 10, rate: float = 0.99) -> DataFrame:
    """(value) kept: among the first int(n·rate) values by count desc (ties by value), count > threshold."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = global_rank(c.withColumn("_neg", -F.col("_c")), ["_neg", col], total_col="_all")
    return ranked.where((F.col("_grank") <= F.floor(F.col("_all") * rate)) & (F.col("_c") > threshold)).select(col)


def apply_rare_to_less(df: DataFrame, col: str, kept: DataFrame) -> DataFrame:
    k = kept.select(F.col(col).alias("_kv"), F.lit(True).alias("_keep"))
    out = df.join(k, df[col] == k["_kv"], "left")
    return out.withColumn(col, F.when(F.col(col).isNull(), F.lit(UNK))
                          .when(F.col("_keep"), F.col(col)).otherwise(F.lit(LESS))).drop("_kv", "_keep")


def mean_impute(df: DataFrame, col: str, train: DataFrame | None = None) -> DataFrame:
    mean = (train if train is not None else df).agg(F.avg(col).alias("_mean"))
    return with_row(df, mean).withColumn(col, F.coalesce(F.col(col), F.col("_mean"))).drop("_mean")


def ordinal_table(df: DataFrame, col: str, order: str) -> DataFrame:
    """(value, code): 1..n by first appearance in ``order``."""
    first = df.groupBy(col).agg(F.min(order).alias("_first"))
    return global_rank(first, ["_first", col]).select(col, F.col("_grank").alias("code"))


def ordinal_encode(df: DataFrame, col: str, table: DataFrame, out: str | None = None) -> DataFrame:
    out = out or f"{col}_code"
    t = table.select(F.col(col).alias("_v"), F.col("code").alias("_code"))
    return (df.join(t, df[col].eqNullSafe(t["_v"]), "left")
            .withColumn(out, F.coalesce("_code", F.lit(-1)).cast("bigint")).drop("_v", "_code"))


def target_encode_online(df: DataFrame, col: str, label: str, order: str, bucket_rows: int = 1 << 16) -> DataFrame:
    """Per row: mean label and count (÷ 0-based row index) of its category over earlier rows only.

    Running sums use a two-level prefix: per (category, row-block) totals →
    exclusive prefix over blocks (small table) + running window inside a block,
    so a category holding a third of the rows is still split by blocks.
    """
    ranked = global_rank(df, [order], rank_col="_idx1")
    base = ranked.withColumn("_idx", F.col("_idx1") - 1).withColumn("_blk", F.floor(F.col("_idx") / bucket_rows))
    key = F.coalesce(F.col(col).cast("string"), F.lit("\u0000null"))
    base = base.withColumn("_k", key)
    blk = base.groupBy("_k", "_blk").agg(F.sum(label).alias("_bs"), F.count(F.lit(1)).alias("_bc"))
    wp = Window.partitionBy("_k").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blk = (blk.withColumn("_ps", F.coalesce(F.sum("_bs").over(wp), F.lit(0)))
           .withColumn("_pc", F.coalesce(F.sum("_bc").over(wp), F.lit(0))).drop("_bs", "_bc"))
    wi = Window.partitionBy("_k", "_blk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    inner = (base.withColumn("_is", F.coalesce(F.sum(label).over(wi), F.lit(0)))
             .withColumn("_ic", F.coalesce(F.count(F.lit(1)).over(wi), F.lit(0))))
    j = inner.join(blk, ["_k", "_blk"])
    s = F.col("_ps") + F.col("_is")
    c = F.col("_pc") + F.col("_ic")
    return (j.withColumn(f"{col}_t_mean", F.when(c > 0, s / c).otherwise(0.0))
            .withColumn(f"{col}_t_count", F.when(c > 0, c / F.col("_idx")).otherwise(0.0))
            .drop("_idx1", "_idx", "_blk", "_k", "_ps", "_pc", "_is", "_ic"))


def target_encode_frozen(df: DataFrame, train: DataFrame, col: str, label: str) -> DataFrame:
    """Transform with train totals: mean label and count/n_train; unseen → 0."""
    per = train.groupBy(F.col(col).alias("_v")).agg((F.sum(label) / F.count(F.lit(1))).alias("_m"), F.count(F.lit(1)).alias("_k"))
    tot = with_row(per, train.agg(F.count(F.lit(1)).alias("_n"))).select("_v", "_m", (F.col("_k") / F.col("_n")).alias("_c"))
    j = df.join(tot, df[col].eqNullSafe(tot["_v"]), "left")
    return (j.withColumn(f"{col}_t_mean", F.coalesce("_m", F.lit(0.0)))
            .withColumn(f"{col}_t_count", F.coalesce("_c", F.lit(0.0))).drop("_v", "_m", "_c"))


def binary_encode(df: DataFrame, col: str, width: int | None = None, out: str | None = None) -> DataFrame:
    """Integer code → array of bits, lowest bit first; width from the max code."""
    if width is None:
        mx = df.agg(F.max(col)).first()[0] or 0
        width = max(1, int(mx).bit_length())
    out = out or f"{col}_bits"
    return df.withColumn(out, F.expr(f"transform(sequence(0, {width - 1}), b -> CAST(shiftright(`{col}`, b) & 1 AS INT))"))


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, value=1) with feature = 'column=value' for each listed column."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns]
    return (df.select(key, F.explode(F.array(*parts)).alias("feature"))
            .where(F.col("feature").isNotNull()).withColumn("value", F.lit(1.0)))


def length_normalize(df: DataFrame, col: str) -> DataFrame:
    """Rows of the array column to unit L2 norm; zero rows kept as they are."""
    n = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return df.withColumn(col, F.when(n > 0, F.transform(F.col(col), lambda v: v.cast("double") / n))
                         .otherwise(F.transform(F.col(col), lambda v: v.cast("double"))))


def crossed_bucket(df: DataFrame, n: int, cols: Cols = DEFAULT, seed: int = 0) -> DataFrame:
    """Hash (user, item) into n buckets (deterministic md5)."""
    return df.withColumn("cross_bucket", hash_bucket(seed, n, cols.user, cols.item))


def metrics_long(wide: DataFrame, id_cols: Sequence[str], name_col: str = "metric",
                 value_col: str = "value") -> DataFrame:
    vals = [c for c in wide.columns if c not in id_cols]
    return wide.unpivot(list(id_cols), vals, name_col, value_col)


def covariance(df: DataFrame, col: str) -> DataFrame:
    """(i, j, mean_i, cov) of an array column: sample covariance of its dimensions, i and j from 0; null arrays are left out.

    Every task adds up the outer products of its rows, block by block, and returns one d x d matrix as rows;
    Spark adds the tasks' matrices (d² rows each, whatever the table's size).
    """
    def outer(batches):
        total = None
        for b in batches:
            c = b.column(0)
            if not len(c):
                continue
            x = np.asarray(c.flatten(), dtype=np.float64).reshape(len(c), -1)
            one = np.hstack([x, np.ones((len(x), 1))])
            total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            i, j = np.divmod(np.arange(total.size), total.shape[0])
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel()),
                                   pa.array(np.full(total.size, total.shape[0] - 1, np.int32))], names=["i", "j", "s", "d"])

    rows = df.where(F.col(col).isNotNull()).select(F.transform(F.col(col), lambda x: x.cast("double")).alias("x"))
    sums = rows.mapInArrow(outer, "i int, j int, s double, d int").groupBy("i", "j", "d").agg(F.sum("s").alias("s"))
    n = sums.where("i = d AND j = d").select(F.col("s").alias("n"))  # one row
    means = sums.where("j = d AND i < d").select("i", F.col("s").alias("t"))
    left, right = means.withColumnsRenamed({"t": "ti"}), means.withColumnsRenamed({"i": "j", "t": "tj"})
    return (sums.where("i < d AND j < d").join(left, "i").join(right, "j").join(F.broadcast(n))
            .select("i", "j", (F.col("ti") / F.col("n")).alias("mean_i"),
                    ((F.col("s") - F.col("ti") * F.col("tj") / F.col("n")) / (F.col("n") - 1)).alias("cov")))


def pca(df: DataFrame, col: str, k: int) -> DataFrame:
    """Project an array column to its k principal components, centred; components by falling variance.

    Sign rule: the entry of a component that is largest in size is positive (the first of equal ones). Only the
    d x d covariance reaches the driver; the projection is distributed.
    """
    cells = covariance(df, col).collect()  # d² numbers
    d = max((r["i"] for r in cells), default=-1) + 1
    if not 0 < k <= max(d, 1):
        raise ValueError(f"{k} components of {d} dimensions")
    mean, cov = np.zeros(d), np.zeros((d, d))
    for r in cells:
        mean[r["i"]], cov[r["i"], r["j"]] = r["mean_i"], r["cov"]
    _, vectors = np.linalg.eigh((cov + cov.T) / 2)
    axes = vectors[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).round(12).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    out = f"{col}_pca"
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def project(batches):
        for b in batches:
            c = b.column(b.schema.get_field_index(col))
            filled = c.drop_null()
            x = np.asarray(filled.flatten(), dtype=np.float64).reshape(len(filled), -1) if len(filled) else np.zeros((0, d))
            y = (x - mean) @ axes if len(x) else np.zeros((0, k))
            offsets = np.concatenate([[0], np.cumsum(np.asarray(c.is_valid()))]).astype(np.int32) * k
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(np.asarray(c.is_null()), False)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])
    return df.mapInArrow(project, schema)
