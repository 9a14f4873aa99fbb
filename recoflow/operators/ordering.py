"""Exact ranks without single-task windows.

``rank_within``: 1-based position of each row inside its group, where the
group may be huge (one user holding a third of all rows, on one day). Groups are
cut by *digits* of the sort order, from coarse to fine: a bucket over a row
bound is cut again by the next digit, from counts alone (``cut``). The counts become
offsets, so the full-data window runs per (group, path) and no task sees a whole hot group.

``global_rank``: 1-based position in a total order over the whole table, via
range partitioning (which splits hot keys, as the order key is unique) plus
per-partition offsets joined from a table with one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.session import dealt, ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


ROW_BOUND = 1 << 18  # rows of one (group, bucket) that a window may hold before it is cut again


def _digits(bucket: Column | Sequence[Column]) -> list[Column]:
    return [bucket] if isinstance(bucket, Column) else list(bucket)


def number_digits(df: DataFrame, name: str, width: int = 1 << 10) -> list[Column]:
    """Digits of a whole-number column, monotone in it, from coarse to fine; none for other types."""
    if dict(df.dtypes)[name] not in ("tinyint", "smallint", "int", "bigint"):
        return []
    value = F.col(name).cast("bigint")
    return [F.floor(value / (width * width)), F.floor(value / width), value]


def time_digits(name: str, bucket_seconds: int = 86400) -> list[Column]:
    """Digits of a time in seconds: bucket, minute, second."""
    t = F.col(name)
    return [F.floor(t / bucket_seconds), F.floor(t / 60), t]


def hex_digits(name: str, levels: int = 4) -> list[Column]:
    """Digits of a hex key: two letters each, 256 ways."""
    return [F.substring(name, 1 + 2 * i, 2) for i in range(levels)]


def cut(df: DataFrame, keys: Sequence[str], bucket: Column | Sequence[Column], bound: int = ROW_BOUND,
        measure: Column | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Radix refinement: (rows with path columns, leaves, path columns).

    ``bucket`` holds digits of the sort order from coarse to fine. Each group is cut
    by the first one; a (group, bucket) of more than ``bound`` rows is cut again by the
    next, and so on, from counts alone. A digit that was not needed is null, so
    paths compare as the rows do. ``leaves`` has one row per (group, path): ``_bc`` (its
    rows, or the sum of ``measure``), ``_off`` (that of the group's earlier leaves) and ``_all``
    (that of the group). Without a crowded bucket this is one counting pass; every
    level more reads only the crowded buckets' rows. Counts are checkpointed, so each is made once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys, digits = list(keys), _digits(bucket)
    path: list[str] = []
    rows, leaves, crowded = df, None, None
    for level, digit in enumerate(digits):
        name = f"_b{level}"
        if crowded is None:
            rows = deeper = rows.withColumn(name, digit)
        else:
            side = {c: f"_o_{i}" for i, c in enumerate([*keys, *path])}
            same = reduce(and_, (F.col(c).eqNullSafe(F.col(o)) for c, o in side.items()))
            marks = crowded.select(*keys, *path, F.lit(True).alias("_deep")).withColumnsRenamed(side)
            deeper = rows.join(marks.drop("_deep"), same, "left_semi").withColumn(name, digit)
            rows = (rows.join(marks, same, "left").withColumn(name, F.when(F.col("_deep"), digit))
                    .drop("_deep", *side.values()))
        path.append(name)
        total = F.count(F.lit(1)) if measure is None else F.sum(measure)
        counts = deeper.groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("_rows"), total.alias("_bc")).checkpoint(eager=True)
        last = level == len(digits) - 1
        crowded = None if last else counts.where(F.col("_rows") > bound)
        done = counts if last else counts.where(F.col("_rows") <= bound)
        done = done.drop("_rows")
        leaves = done if leaves is None else leaves.withColumn(name, F.lit(None)).unionByName(done)
        if last or crowded.isEmpty():
            break
    before = Window.partitionBy(*keys).orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    leaves = (leaves.withColumn("_off", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
              .withColumn("_all", F.sum("_bc").over(Window.partitionBy(*keys))))
    return rows, leaves, path


def _with_offsets(rows: DataFrame, leaves: DataFrame, on: list[str]) -> DataFrame:
    """Null keys and buckets are groups like any other, so every row finds its offset."""
    side = {c: f"_o_{i}" for i, c in enumerate(on)}
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(o)) for c, o in side.items()))
    return rows.join(leaves.withColumnsRenamed(side), same).drop(*side.values())


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column | Sequence[Column],
                rank_col: str = "_rn", count_col: str = "_cnt", bound: int = ROW_BOUND) -> DataFrame:
    """1-based position (``rank_col``) of each row in its group and the group's size (``count_col``).

    ``bucket``: one monotone bucket or digits of the order from coarse to fine (``cut``). Without a group of more
    than ``bound`` rows nothing is cut: a window per group, over tasks of a bounded number of rows.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (n[0] or 0) <= bound:
        group = Window.partitionBy(*keys)
        return (dealt(df, n[1] or 0, *keys).withColumn(rank_col, F.row_number().over(group.orderBy(*order)).cast("bigint"))
                .withColumn(count_col, F.count(F.lit(1)).over(group)))
    rows, leaves, path = cut(df, keys, bucket, bound)
    inside = Window.partitionBy(*keys, *path).orderBy(*order)
    ranked = rows.withColumn("_rn0", F.row_number().over(inside))
    return (_with_offsets(ranked, leaves.drop("_bc"), [*keys, *path])
            .withColumn(rank_col, (F.col("_off") + F.col("_rn0")).cast("bigint"))
            .withColumnRenamed("_all", count_col).drop("_off", "_rn0", *path))


def count_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column | Sequence[Column],
                 flag: Column, out: str, bound: int = ROW_BOUND) -> DataFrame:
    """``out``: how many flagged rows of the group stand before the row, in (bucket, order).

    Cut as in ``rank_within``: a window per (group, path), and offsets from the leaves' flag counts.
    """
    keys = list(keys)
    rows, leaves, path = cut(df.withColumn("_f", F.when(flag, 1).otherwise(0).cast("bigint")), keys, bucket, bound, F.col("_f"))
    inside = Window.partitionBy(*keys, *path).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_in", F.coalesce(F.sum("_f").over(inside), F.lit(0)))
    return (_with_offsets(counted, leaves.drop("_bc", "_all"), [*keys, *path]).withColumn(out, F.col("_off") + F.col("_in"))
            .drop("_f", "_in", "_off", *path))


def global_rank(df: DataFrame, order: Sequence[str], rank_col: str = "_grank",
                num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """Exact 1-based rank of rows ordered by ``order`` (must be a unique key).

    With ``total_col`` the table's row count is attached as well (from the same
    per-partition counts, so no second pass over the data).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from sampling, which depends on the input row order; the
    # tagged rows are therefore written once (reliable checkpoint in the shared
    # checkpoint folder) so counts and positions see the same partitioning,
    # even if executors are lost and tasks re-run.
    ensure_checkpoint_dir(spark)
    tagged = (df.repartitionByRange(n, *order)
              .sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
              .checkpoint(eager=True))
    # One row per partition: the broadcast side is bounded by the partition count.
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"))
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_pc").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    if total_col:
        offsets = offsets.withColumn(total_col, F.sum("_pc").over(Window.partitionBy()))
    offsets = offsets.drop("_pc")
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, (F.col("_off") + pos + 1).cast("bigint"))
            .drop("_mid", "_pid", "_off"))


_BLOCK = 4096


def total_before(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the rows before each row in ``order`` (a unique key)."""
    return totals_before(df, order, {value: out})


def totals_before(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """For every (value, out): ``out`` is the sum of ``value`` over the rows before each row in ``order`` (a unique key).

    Rows are ranked, summed in blocks of consecutive ranks, and the block totals
    (one row per 4,096) are prefixed; no window spans the table.
    """
    ranked = global_rank(df, list(order), rank_col="_tr").withColumn("_tb", F.floor((F.col("_tr") - 1) / _BLOCK))
    names = list(enumerate(sums.items()))
    totals = ranked.groupBy("_tb").agg(*(F.sum(v).alias(f"_tv{i}") for i, (v, _) in names))
    before = Window.orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_tb", *(F.coalesce(F.sum(f"_tv{i}").over(before), F.lit(0)).alias(f"_ts{i}") for i, _ in names))
    inside = Window.partitionBy("_tb").orderBy("_tr").rowsBetween(Window.unboundedPreceding, -1)
    within = ranked.withColumns({f"_ti{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, (v, _) in names})
    placed = within.join(starts, "_tb").withColumns({out: F.col(f"_ts{i}") + F.col(f"_ti{i}") for i, (_, out) in names})
    return placed.drop("_tr", "_tb", *(f"_{t}{i}" for i, _ in names for t in ("ts", "ti")))


def median_row(df: DataFrame, value: str) -> DataFrame:
    """One row, column ``median``: the least value that half of the rows do not exceed (nulls left out).

    Rows are counted per value first; only distinct values are ordered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = total_before(counts, [value], "_n", "_before")
    whole = counts.agg(F.sum("_n").alias("_all"))
    half = placed.join(F.broadcast(whole)).where(2 * (F.col("_before") + F.col("_n")) >= F.col("_all"))
    return half.agg(F.min(value).alias("median"))
