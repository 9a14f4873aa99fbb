"""Rating, classification, ranking and grouped (per-impression) metrics.

All metrics are SQL aggregates over joins; nothing goes through the driver
except the final scalar when a caller asks for a float. Per-user lists are
kept in long form ``(user, item, rank)``, so no unbounded group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols, require
from recoflow.operators.clean import check_inputs
from recoflow.operators.ordering import number_digits, rank_within, total_before
from recoflow.operators.topk import topk_items

# ------------------------------------------------------------------ rating metrics


def rating_pairs(truth: DataFrame, pred: DataFrame, cols: Cols = DEFAULT, strict: bool = False) -> DataFrame:
    """(user, item, label, prediction) for pairs present in both frames.

    With ``strict`` empty frames and wrong types raise now (``clean.check_inputs``), not later as empty metrics.
    """
    require(truth, cols.user, cols.item, cols.rating, what="truth")
    require(pred, cols.user, cols.item, cols.prediction, what="prediction")
    if strict:
        check_inputs(truth, pred, cols)
    t = truth.select(cols.user, cols.item, F.col(cols.rating).cast("double").alias("label"))
    p = pred.select(cols.user, cols.item, F.col(cols.prediction).cast("double").alias("prediction"))
    return t.join(p, [cols.user, cols.item])


def rating_metrics(pairs: DataFrame) -> DataFrame:
    """One row: rmse, mae, rsquared, exp_var."""
    err = F.col("label") - F.col("prediction")
    stats = pairs.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        F.var_pop("label").alias("_vl_pop"),
        F.count(F.lit(1)).alias("_n"),
        F.variance(err).alias("_ve"),
        F.variance("label").alias("_vl"))
    return stats.select(
        "rmse", "mae",
        (1 - F.col("_sse") / (F.col("_vl_pop") * F.col("_n"))).alias("rsquared"),
        (1 - F.col("_ve") / F.col("_vl")).alias("exp_var"))


# ------------------------------------------------------------ classification metrics


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC with tie-aware average ranks (Mann–Whitney), fully distributed.

    Rows are counted per score first; only the distinct scores are ordered.
    """
    by_score = df.groupBy(score).agg(F.sum(F.col(label)).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))
    placed = total_before(by_score, [score], "_cnt", "_below")
    s = placed.agg(F.sum(F.col("_pos") * (F.col("_below") + (F.col("_cnt") + 1) / 2.0)).alias("_rs"),
                   F.sum("_pos").alias("_np"), F.sum("_cnt").alias("_n"))
    n_neg = F.col("_n") - F.col("_np")
    return s.select(((F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2.0) / (F.col("_np") * n_neg)).alias("auc"))


def logloss(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-11) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(score)))
    y = F.col(label)
    return df.agg((-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"))


def accuracy_f1(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    pred = F.when(F.col(score) >= threshold, 1).otherwise(0)
    y = F.col(label)
    s = df.agg(F.avg((pred == y).cast("double")).alias("accuracy"),
               F.sum(((pred == 1) & (y == 1)).cast("double")).alias("_tp"),
               F.sum(((pred == 1) & (y == 0)).cast("double")).alias("_fp"),
               F.sum(((pred == 0) & (y == 1)).cast("double")).alias("_fn"))
    return s.select("accuracy", (2 * F.col("_tp") / (2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))).alias("f1"))


# ----------------------------------------------------------------- relevance sets


def relevant_topk(pred: DataFrame, k: int, cols: Cols = DEFAULT) -> DataFrame:
    """(user, item, rank): k best items per user by prediction (ties by item)."""
    return topk_items(pred, k, cols, rank_col="rank").select(cols.user, cols.item, "rank")


def relevant_by_threshold(pred: DataFrame, threshold: float, cols: Cols = DEFAULT) -> DataFrame:
    """(user, item, rank): all items with prediction >= threshold, ranked; a user with very many is cut by score."""
    kept = pred.where(F.col(cols.prediction) >= threshold)
    digits = [F.floor(-F.col(cols.prediction) * scale) for scale in (1, 1 << 10, 1 << 20)] + number_digits(kept, cols.item)
    ranked = rank_within(kept, [cols.user], [F.col(cols.prediction).desc(), F.col(cols.item)], digits, rank_col="rank", count_col="_c")
    return ranked.select(cols.user, cols.item, "rank")


def relevant_by_timestamp(pred: DataFrame, k: int, cols: Cols = DEFAULT) -> DataFrame:
    """(user, item, rank): the k latest items per user (ties by item)."""
    w = Window.partitionBy(cols.user).orderBy(F.col(cols.timestamp).desc(), F.col(cols.item))
    return (pred.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(cols.user, cols.item, F.col("rank").cast("bigint").alias("rank")))


def user_relevant_lists(ranked: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """Ordered item array per user, for consumers that need lists (bounded by k upstream)."""
    return (ranked.groupBy(cols.user)
            .agg(F.sort_array(F.collect_list(F.struct("rank", cols.item))).alias("_l"))
            .select(cols.user, F.transform("_l", lambda x: x[cols.item]).alias("items")))


# ------------------------------------------------------------------ ranking metrics


def ranking_hits(ranked: DataFrame, truth: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """Per common user: n_hits, n_actual, dcg, ap_sum (Σ hit_no / rank).

    Only users present in both the recommendations and the truth count.
    """
    t = truth.select(cols.user, cols.item).distinct()
    actual = t.groupBy(cols.user).agg(F.count(F.lit(1)).alias("n_actual"))
    users_pred = ranked.select(cols.user).distinct()
    common = actual.join(users_pred, cols.user, "inner")
    hits = ranked.join(t, [cols.user, cols.item], "inner")
    w = Window.partitionBy(cols.user).orderBy("rank")
    per_hit = hits.withColumn("_hit_no", F.row_number().over(w))
    per_user = per_hit.groupBy(cols.user).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.sum(1.0 / F.ln(1.0 + F.col("rank"))).alias("dcg"),
        F.sum(F.col("_hit_no") / F.col("rank")).alias("ap_sum"))
    return (common.join(per_user, cols.user, "left")
            .select(cols.user, F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"), "n_actual",
                    F.coalesce("dcg", F.lit(0.0)).alias("dcg"), F.coalesce("ap_sum", F.lit(0.0)).alias("ap_sum")))


def _idcg(n_actual: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(n_actual.cast("int"), F.lit(k))), F.lit(0.0),
                       lambda acc, i: acc + 1.0 / F.ln(1.0 + i))


def ranking_metrics(hits: DataFrame, k: int) -> DataFrame:
    """One row: precision@k, recall@k, ndcg@k, map (averaged over common users)."""
    return hits.agg(
        F.avg(F.col("n_hits") / k).alias("precision_at_k"),
        F.avg(F.col("n_hits") / F.col("n_actual")).alias("recall_at_k"),
        F.avg(F.col("dcg") / _idcg(F.col("n_actual"), k)).alias("ndcg_at_k"),
        F.avg(F.col("ap_sum") / F.col("n_actual")).alias("map_at_k"))


# ------------------------------------------------------------------ grouped metrics


def group_ranks(df: DataFrame, group: str, label: str = "label", score: str = "score",
                item: str = "item_id") -> DataFrame:
    """Adds rank by score (desc, ties by item) and ideal rank by label (desc, ties by item)."""
    w_s = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    w_l = Window.partitionBy(group).orderBy(F.col(label).desc(), F.col(item))
    return df.withColumn("_rank", F.row_number().over(w_s)).withColumn("_irank", F.row_number().over(w_l))


def group_mrr(ranked: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Mean over groups of Σ(label/rank)/Σlabel; groups without a positive are skipped."""
    per = ranked.groupBy(group).agg(F.sum(F.col(label) / F.col("_rank")).alias("_rr"),
                                    F.sum(label).alias("_np"))
    return per.where(F.col("_np") > 0).agg(F.avg(F.col("_rr") / F.col("_np")).alias("mean_mrr"))


def group_dcg(ranked: DataFrame, group: str, ks: list[int], label: str = "label") -> DataFrame:
    """Per group dcg@k: gain 2^label−1 over log2(rank + 1)."""
    gain = (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col("_rank") + 1.0)
    return ranked.groupBy(group).agg(*[F.sum(F.when(F.col("_rank") <= k, gain).otherwise(0.0)).alias(f"dcg_at_{k}") for k in ks])


def group_ndcg_hit(ranked: DataFrame, group: str, ks: list[int], label: str = "label") -> DataFrame:
    """ndcg@k (gain 2^label−1, log2 discount; groups with zero ideal skipped) and hit@k."""
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    aggs = []
    for k in ks:
        aggs += [F.sum(F.when(F.col("_rank") <= k, gain / F.log2(F.col("_rank") + 1.0)).otherwise(0.0)).alias(f"_d{k}"),
                 F.sum(F.when(F.col("_irank") <= k, gain / F.log2(F.col("_irank") + 1.0)).otherwise(0.0)).alias(f"_i{k}"),
                 F.max(F.when((F.col("_rank") <= k) & (F.col(label) == 1), 1).otherwise(0)).alias(f"_h{k}")]
    per = ranked.groupBy(group).agg(*aggs)
    out = []
    for k in ks:
        out += [F.avg(F.when(F.col(f"_i{k}") > 0, F.col(f"_d{k}") / F.col(f"_i{k}"))).alias(f"ndcg_at_{k}"),
                F.avg(F.col(f"_h{k}").cast("double")).alias(f"hit_at_{k}")]
    return per.agg(*out)


def group_auc(df: DataFrame, group: str, label: str = "label", score: str = "score") -> DataFrame:
    """Mean of per-group AUC (tie-aware); groups with one label class are skipped."""
    w = Window.partitionBy(group).orderBy(score)
    per_score = (df.groupBy(group, score).agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_p")))
    cum = per_score.withColumn("_before", F.coalesce(
        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    avg_rank = F.col("_before") + (F.col("_c") + 1) / 2.0
    per_group = cum.groupBy(group).agg(F.sum(F.col("_p") * avg_rank).alias("_rs"), F.sum("_p").alias("_np"),
                                       F.sum("_c").alias("_n"))
    nn = F.col("_n") - F.col("_np")
    valid = per_group.where((F.col("_np") > 0) & (nn > 0))
    return valid.agg(F.avg((F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2.0) / (F.col("_np") * nn))
                     .alias("group_auc"))


def group_labels(df: DataFrame, group: str, label: str = "label", score: str = "score",
                 item: str = "item_id") -> DataFrame:
    """Label and score arrays per group, in item order (for consumers that need them)."""
    return (df.groupBy(group)
            .agg(F.sort_array(F.collect_list(F.struct(item, label, score))).alias("_l"))
            .select(group, F.transform("_l", lambda x: x[label]).alias("labels"),
                    F.transform("_l", lambda x: x[score]).alias("scores")))


def user_exact_accuracy_rmse(truth: DataFrame, pred: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """Per-user share of exact predictions over rated items, averaged; and √(mean(per-user MSE)/2)."""
    p = rating_pairs(truth, pred, cols)
    per_user = p.groupBy(cols.user).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("_acc"),
        F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("_mse"))
    return per_user.agg(F.avg("_acc").alias("user_exact_accuracy"),
                        F.sqrt(F.avg("_mse") / 2).alias("user_masked_rmse"))
