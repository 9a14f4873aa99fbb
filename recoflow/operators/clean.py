"""Cleaning and validation: projections, filters, data-quality aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.cols import DEFAULT, Cols, require
from recoflow.functions.text import clean_text_col, tokens_col


def min_rating_filter(df: DataFrame, min_rating: int = 1, filter_by: str = "user",
                      cols: Cols = DEFAULT) -> DataFrame:
    """Keep users (or items) with at least ``min_rating`` rows.

    Counted with a partial aggregate and applied with a semi join, so a hot
    user is never gathered in one window task.
    """
    if not (isinstance(min_rating, int) and min_rating >= 1):
        raise ValueError(f"the least number of ratings is a whole number from 1 on, not {min_rating!r}")
    if filter_by not in ("user", "item"):
        raise ValueError(f"ratings are counted per 'user' or per 'item', not per {filter_by!r}")
    by = cols.user if filter_by == "user" else cols.item
    require(df, by)
    if min_rating == 1:
        return df
    keep = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rating).select(by)
    return df.join(keep, by, "left_semi")


def positive_filter(df: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    return df.where(F.col(cols.rating) > 0)


def drop_duplicates_seq(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each column in turn keep the first row (by ``order``) per value; nulls are one value.

    ``min_by`` is a partial aggregate: each map task keeps one row per value
    before the shuffle, so a value shared by a third of the rows stays cheap.
    """
    out = df
    for c in columns:
        names = out.columns
        out = (out.groupBy(F.col(c).alias("_g"))
               .agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
               .select("_r.*"))
    return out


def drop_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """'' → null, then drop rows with null in any listed column."""
    for c in columns:
        df = df.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return df.dropna(subset=list(columns))


def clean_metadata(df: DataFrame, order: Sequence[str],
                   dedupe_cols=("cord_uid", "doi"),
                   required=("cord_uid", "doi", "title", "license", "url")) -> DataFrame:
    return drop_blank(drop_duplicates_seq(df, dedupe_cols, order), required)


def clean_text(df: DataFrame, columns: Sequence[str], out_col: str = "cleaned_text",
               for_bert: bool = False) -> DataFrame:
    """Concatenate columns with a space (null → ''), NFC, strip tags/symbols, lower-case."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.withColumn(out_col, clean_text_col(joined, lower=not for_bert))


def token_frequency(df: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """Token counts: per document if ``id_col`` is given, else over all documents."""
    toks = df.select(*( [id_col] if id_col else []), F.explode(tokens_col(F.col(text_col))).alias("token"))
    keys = ([id_col] if id_col else []) + ["token"]
    return toks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


_BASE = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float"}
_WHOLE = ("tinyint", "smallint", "int", "bigint")
DENSE = 64  # ids are dense when their range is at most so many times the rows


def base_type(dtype: str) -> str:
    """Whole numbers of any width are one type, and so are fractions; other types stand for themselves."""
    return "float" if dtype.startswith("decimal") else _BASE.get(dtype, dtype)


def distinct_count(df: DataFrame, name: str, dense: bool) -> DataFrame:
    """One row, ``n``: the exact number of distinct values (nulls left out), by partial aggregates only.

    Dense whole numbers set bits: one bitmap per 32,768 neighbouring ids, merged by OR; other values are grouped.
    """
    value = df.where(F.col(name).isNotNull()).select(F.col(name).alias("v"))
    if not dense:
        return value.groupBy("v").agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("n"))
    v = F.col("v").cast("bigint")
    bits = value.groupBy(F.bitmap_bucket_number(v).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("m"))
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).cast("bigint").alias("n"))


def check_inputs(truth: DataFrame, pred: DataFrame, cols: Cols = DEFAULT, truth_value: str | None = None,
                 pred_value: str | None = None) -> None:
    """Refuse inputs no metric can be computed from: a missing column, an empty frame, ids of different base types, a value that is no number.

    Looks at the schemas first; then one row of each frame is asked for.
    """
    values = {"truth": truth_value or cols.rating, "prediction": pred_value or cols.prediction}
    frames = {"truth": truth, "prediction": pred}
    for what, df in frames.items():
        require(df, cols.user, cols.item, values[what], what=what)
        dtype = dict(df.dtypes)[values[what]]
        if base_type(dtype) not in ("int", "float"):
            raise TypeError(f"{what}.{values[what]} is {dtype}, not a number")
    for role in (cols.user, cols.item):
        left, right = (dict(df.dtypes)[role] for df in frames.values())
        if base_type(left) != base_type(right):
            raise TypeError(f"{role} is {left} in the truth and {right} in the prediction")
    for what, df in frames.items():
        if df.isEmpty():
            raise ValueError(f"the {what} has no rows")


def contract_report(df: DataFrame, cols: Cols = DEFAULT, other: DataFrame | None = None,
                    roles: Sequence[str] = ("user", "item", "rating"), strict: bool = False) -> DataFrame:
    """One data-quality row per role column: rows, nulls, distinct values, duplicate
    (user,item) keys and whether the base type matches ``other`` (if given).

    With ``strict`` an empty table raises ValueError and a base type that differs TypeError.
    Rows, nulls and ranges come from one pass (numbers that decide how distinct values are counted);
    distinct values from one partially aggregated count a column (``distinct_count``).
    """
    names = [getattr(cols, r) for r in roles]
    require(df, *names)
    types = dict(df.dtypes)
    other_types = types if other is None else dict(other.dtypes)
    match = {n: base_type(types[n]) == base_type(other_types.get(n, "")) for n in names}
    if strict and not all(match.values()):
        raise TypeError("; ".join(f"{n} is {types[n]}, but {other_types.get(n, 'absent')} in the other table" for n in names if not match[n]))
    whole = [n for n in names if types[n] in _WHOLE]
    aggs = [F.count(F.lit(1)).alias("rows"), *(F.count(n).alias(f"filled__{n}") for n in names),
            *(F.min(n).alias(f"low__{n}") for n in whole), *(F.max(n).alias(f"high__{n}") for n in whole)]
    seen = df.agg(*aggs).first()
    if strict and not seen["rows"]:
        raise ValueError("the table has no rows")
    dup = (df.groupBy(cols.user, cols.item).agg(F.count(F.lit(1)).alias("_c"))
           .agg(F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1)), F.lit(0)).cast("bigint").alias("dup_keys")))
    out = None
    for n in names:
        dense = n in whole and seen[f"low__{n}"] is not None and seen[f"high__{n}"] - seen[f"low__{n}"] < DENSE * max(1, seen["rows"])
        row = distinct_count(df, n, dense).select(
            F.lit(n).alias("column"), F.lit(types[n]).alias("dtype"), F.lit(seen["rows"]).cast("bigint").alias("rows"),
            F.lit(seen["rows"] - seen[f"filled__{n}"]).cast("bigint").alias("nulls"), F.col("n").alias("distinct_values"),
            F.lit(match[n]).alias("dtype_match"))
        out = row if out is None else out.unionByName(row)
    return (out.join(F.broadcast(dup))  # one row
            .select("column", "dtype", "rows", "nulls", "distinct_values", "dup_keys", "dtype_match"))


def no_overlap_count(reco: DataFrame, train: DataFrame, cols: Cols = DEFAULT) -> DataFrame:
    """Number of recommended (user, item) pairs already in train (must be 0)."""
    r = reco.select(cols.user, cols.item)
    t = train.select(cols.user, cols.item)
    return r.join(t, [cols.user, cols.item], "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


def assert_no_overlap(reco: DataFrame, train: DataFrame, cols: Cols = DEFAULT) -> None:
    r = reco.select(cols.user, cols.item)
    if r.join(train.select(cols.user, cols.item), [cols.user, cols.item], "left_semi").limit(1).count():
        raise ValueError("recommendations contain user-item pairs that are in train")
