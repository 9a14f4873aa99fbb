"""Sinks: text formats for downstream trainers, and result tables.

Line numbers, when a format needs them, come from an explicit key, never
from the physical row order. Nothing is coalesced to one file.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.operators.encode import ordinal_table
from recoflow.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> str:
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("overwrite").text(path, compression=compression)
    return path


def delimited_lines(df: DataFrame, sep: str) -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def to_libffm(df: DataFrame, label: str, fields: list[str], order: str) -> DataFrame:
    """`label f:i:v ...`: string fields get one index per distinct value (first appearance in
    ``order``), numeric fields one index per field; string values are written as 1. A null
    field has no token on its line."""
    kinds = dict(df.dtypes)
    strings = [f for f in fields if kinds[f] == "string"]
    counts = df.agg(*[F.countDistinct(f).alias(f) for f in strings]).first() if strings else None
    out = df
    offset = 1
    parts = []
    for fi, f in enumerate(fields, start=1):
        if kinds[f] == "string":
            t = ordinal_table(df.where(F.col(f).isNotNull()), f, order).withColumnRenamed("code", f"_{fi}")
            out = out.join(t, f, "left").withColumn(f"_{fi}", F.col(f"_{fi}") + (offset - 1))
            parts.append(F.concat(F.lit(f"{fi}:"), F.col(f"_{fi}").cast("string"), F.lit(":1")))
            offset += counts[f]
        else:
            parts.append(F.concat(F.lit(f"{fi}:{offset}:"), F.col(f).cast("string")))
            offset += 1
    return out.select(order, F.concat_ws(" ", F.col(label).cast("string"), *parts).alias("line"))


def to_vw_lines(df: DataFrame, user: str, item: str, rating: str, index: str, train: bool = True,
                logistic: bool = False) -> DataFrame:
    """`rating index|user u |item i`; train ratings as integers, logistic → 2·round(r/max)−1, test blank."""
    if not train:
        r = F.lit("")
    elif logistic:
        mx = df.agg(F.max(F.col(rating).cast("bigint"))).first()[0]
        r = (2 * F.bround(F.col(rating).cast("bigint") / F.lit(mx), 0) - 1).cast("bigint").cast("string")
    else:
        r = F.col(rating).cast("bigint").cast("string")
    return df.select(index, F.format_string("%s %s|user %s |item %s", r, F.col(index).cast("string"),
                                            F.col(user).cast("string"), F.col(item).cast("string")).alias("line"))


def embedding_lines(df: DataFrame, key: str, vec: str, sep: str = " ") -> DataFrame:
    return df.select(F.concat(F.col(key).cast("string"), F.lit("\t"),
                              F.concat_ws(sep, F.transform(vec, lambda x: x.cast("string")))).alias("value"))


def impression_lines(pairs: DataFrame, prefix: str = "train_") -> DataFrame:
    """`label prefix+user item[%imp]` lines for positives and sampled negatives."""
    return pairs.select(F.format_string("%d %s%s %s%%%s", F.col("label"), F.lit(prefix), F.col("user_id").cast("string"),
                                        F.col("item_id").cast("string"), F.col("imp_id").cast("string")).alias("value"))


def sequence_lines(hist: DataFrame) -> DataFrame:
    """8-column TSV instance lines (histories comma-joined)."""
    j = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return hist.select(F.concat_ws("\t", F.col("label").cast("string"), F.col("user_id").cast("string"),
                                   F.col("item_id").cast("string"), F.col("cate"), F.col("ts").cast("string"),
                                   j("item_history"), j("cate_history"), j("time_history")).alias("value"))


def doc_feature_lines(df: DataFrame, id_col: str, words: str, entities: str) -> DataFrame:
    """`doc w1,…,wn e1,…,en`."""
    j = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return df.select(F.concat_ws(" ", F.col(id_col).cast("string"), j(words), j(entities)).alias("value"))


def train_lines(clicks: DataFrame, negatives: DataFrame, prefix: str = "train_") -> DataFrame:
    """`1 train_user item` for each click and `0 train_user item` for each of its sampled negatives.

    clicks: (user_id, item_id); negatives: (user_id, neg_item).
    """
    one = lambda label, item: F.format_string("%d %s%s %s", F.lit(label), F.lit(prefix), F.col("user_id").cast("string"),
                                              F.col(item).cast("string")).alias("value")
    return clicks.select(one(1, "item_id")).unionByName(negatives.select(one(0, "neg_item")))


def valid_lines(rows: DataFrame, prefix: str = "valid_") -> DataFrame:
    """`label valid_user item%session` for every candidate; rows: (label, user_id, item_id, session)."""
    return rows.select(F.format_string("%d %s%s %s%%%s", F.col("label"), F.lit(prefix), F.col("user_id").cast("string"),
                                       F.col("item_id").cast("string"), F.col("session").cast("string")).alias("value"))


def user_history_lines(train: DataFrame, valid: DataFrame, history: str = "history") -> DataFrame:
    """`train_user i1,i2,…` and `valid_user i1,i2,…`."""
    def part(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col("user_id").cast("string"), F.lit(" "), F.concat_ws(",", history)).alias("value"))
    return part(train, "train_").unionByName(part(valid, "valid_"))


#: Heads of the experiment's table (fixed values), after the running number of the row.
RESULT_HEADS = {
    "data": "Data", "algo": "Algo", "k": "K", "precision_at_k": "Precision@k", "recall_at_k": "Recall@k", "ndcg_at_k": "NDCG@k",
    "map_at_k": "Mean average precision", "catalog_coverage": "catalog_coverage", "distributional_coverage": "distributional_coverage",
    "novelty": "novelty", "diversity": "diversity", "serendipity": "serendipity",
}


def write_results(results: DataFrame, folder: str, data_size: str) -> str:
    """The experiment's table (one row a recommender, ``plans.suite``) as CSV with heads, under ``results<data size>.csv``.

    Rows are numbered from 1 in the order of algorithm and k; the table of an earlier run of that size is replaced. Returns the path.
    """
    if not re.fullmatch(r"[0-9A-Za-z._-]+", data_size):
        raise ValueError(f"a data size names a file, {data_size!r} does not")
    missing = [c for c in RESULT_HEADS if c not in results.columns]
    if missing:
        raise ValueError(f"the results lack {', '.join(missing)}")
    # a row for every recommender and k of one experiment: a window over all of them is small
    number = F.row_number().over(Window.orderBy("algo", "k"))
    path = f"{folder.rstrip('/')}/results{data_size}.csv"
    (results.select(number.alias("_c0"), *(F.col(c).alias(head) for c, head in RESULT_HEADS.items()))
     .write.mode("overwrite").csv(path, header=True))
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The table as ``write_results`` left it, typed, with its row numbers."""
    kinds = {"data": "string", "algo": "string", "k": "int"}
    schema = ", ".join(["`_c0` int", *(f"`{head}` {kinds.get(c, 'double')}" for c, head in RESULT_HEADS.items())])
    return spark.read.csv(path, header=True, schema=schema)
