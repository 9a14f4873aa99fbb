"""Sharding by histogram sort: shards of near-equal bytes, cut at splitters of a sorted order.

Rows are ordered by a key of three words: a hash of the text, a hash of the
document's id, and a number given to the row when it was stored. So copies of a text
lie side by side, copies of a row still have an order, and a source or a group of copies
of any size can be cut. Splitters are found by counting: every
round probes the open cells (at most one a splitter) at up to ``PROBES`` candidate key
boundaries, sums the exact bytes below each across all partitions, and keeps a
splitter whose nearest boundary is within ``tolerance`` of its target; the others go on
inside the one cell that holds the target. A cut falls inside a group of equal texts only
where no boundary between texts meets the tolerance. Then the rows are exchanged once, by
shard and range of keys; a shard's slots are positions in key order (``ordering.rank_within``).

Main path: DataFrame functions only. The driver sees at most 15 x PROBES sums a round, whatever the input.

Defined results: a null text has size 1 and crc32 0; null ids, empty and very
long texts, ties and repeated rows are rows like any other (repeated rows are told apart by
their stored number only, so which of them gets which slot is open); a text larger than a shard is
never cut, so shards can differ by the largest text; an empty table gives no rows. The
input's columns stay in one struct ``row``, so no name can clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.operators.ordering import rank_within

SHARDS = 16
PROBES = 1024
TOLERANCE = 0.005  # of a shard's share of the bytes
WORD_BITS = 62
WORDS = ("_w0", "_w1", "_w2")


def _word(c: Column) -> Column:
    """A hash in [0, 2**62)."""
    return F.shiftrightunsigned(F.xxhash64(c), 64 - WORD_BITS)


def stored(rows: DataFrame, size: Column, group: Column, member: Column) -> DataFrame:
    """(row, size, key words), written once to the shared folder: later passes read what they need, and row numbers stay."""
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), size.cast("bigint").alias("size"),
                        _word(group).alias(WORDS[0]), _word(member).alias(WORDS[1]))
    path = f"{C.shared_dir(rows.sparkSession)}/shards-{uuid.uuid4().hex}"
    keyed.withColumn(WORDS[2], _word(F.monotonically_increasing_id())).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Cell:
    """Keys that begin with ``prefix`` and whose next word lies in [low, high); ``below``: bytes before them."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // PROBES))

    def holds(self) -> Column:
        word = F.col(WORDS[len(self.prefix)])
        cond = (word >= self.low) & (word < self.high)
        for name, value in zip(WORDS, self.prefix):
            cond = cond & (F.col(name) == value)
        return cond

    def probe(self) -> Column:
        return F.expr(f"({WORDS[len(self.prefix)]} - {self.low}L) div {self.step}L")


def _count(keys: DataFrame, cells: list[Cell]) -> dict[int, list]:
    """Exact bytes between neighbouring candidate boundaries of each cell, in key order."""
    which, probe, word = F.lit(None), F.lit(None), F.lit(None)
    for i, cell in reversed(list(enumerate(cells))):
        inside = cell.holds()
        which = F.when(inside, F.lit(i)).otherwise(which)
        probe = F.when(inside, cell.probe()).otherwise(probe)
        word = F.when(inside, F.col(WORDS[len(cell.prefix)])).otherwise(word)
    counted = (keys.select(which.cast("int").alias("cell"), probe.cast("bigint").alias("probe"), word.cast("bigint").alias("word"), "size")
               .where("cell IS NOT NULL").groupBy("cell", "probe")
               .agg(F.sum("size").alias("bytes"), F.min("word").alias("first"), F.max("word").alias("last")))
    out: dict[int, list] = {i: [] for i in range(len(cells))}
    for r in sorted(counted.collect(), key=lambda r: (r["cell"], r["probe"])):
        out[r["cell"]].append(r)
    return out


def _settle(cell: Cell, bins: list, target: float, slack: float) -> tuple[tuple[int, ...] | None, Cell | None]:
    """The boundary nearest to the target if it is near enough or nothing finer exists, else the cell to go on in."""
    below = cell.below
    for r in bins:
        if target < below + r["bytes"] or r is bins[-1]:
            break
        below += r["bytes"]
    pad = (0,) * (len(WORDS) - len(cell.prefix) - 1)
    low, high = target - below, below + r["bytes"] - target
    edge = (*cell.prefix, r["first"], *pad) if low <= high else (*cell.prefix, r["last"] + 1, *pad)
    single = r["first"] == r["last"]
    if min(low, high) <= slack or (single and not pad):
        return edge, None
    if single:
        return None, Cell((*cell.prefix, r["first"]), 0, 1 << WORD_BITS, below)
    return None, Cell(cell.prefix, r["first"], r["last"] + 1, below)


def splitters(keys: DataFrame, total: int, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """The first key of every shard but shard 0, ascending."""
    share = total / shards
    found: dict[int, tuple[int, ...]] = {}
    open_ = {i: Cell((), 0, 1 << WORD_BITS, 0) for i in range(1, shards)} if total else {}
    while open_:
        cells = sorted(set(open_.values()), key=lambda c: (c.prefix, c.low))
        bins = _count(keys, cells)
        after = {}
        for i, cell in open_.items():
            edge, deeper = _settle(cell, bins[cells.index(cell)], share * i, share * tolerance)
            if edge is None:
                after[i] = deeper
            else:
                found[i] = edge
        open_ = after
    return sorted(found.values())


def _digits() -> list[Column]:
    """The key from coarse to fine, for ranks inside a shard."""
    cuts = [(WORDS[0], 50), (WORDS[0], 38), (WORDS[0], 0), (WORDS[1], 50), (WORDS[1], 38), (WORDS[1], 0), (WORDS[2], 50), (WORDS[2], 0)]
    return [F.shiftright(F.col(w), bits) for w, bits in cuts]


def shard_rows(rows: DataFrame, size: Column, group: Column, member: Column, shards: int = SHARDS,
               tolerance: float = TOLERANCE) -> DataFrame:
    """(row, size, shard, slot): the input's rows in ``shards`` shards of near-equal total ``size``.

    ``size`` is a positive whole number a row; rows of equal ``group`` are kept side by side, in the order of ``member``'s hash.
    """
    if shards < 1 or not 0 <= tolerance < 1:
        raise ValueError(f"needs a shard or more and a tolerance in [0, 1): {shards!r}, {tolerance!r}")
    keys = stored(rows, size, group, member)
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()  # two numbers
    cuts = splitters(keys, int(whole["b"] or 0), shards, tolerance)
    key = F.struct(*WORDS)
    shard = sum((F.when(key >= F.struct(*(F.lit(w).cast("bigint").alias(n) for n, w in zip(WORDS, cut))), 1).otherwise(0) for cut in cuts),
                F.lit(0))
    # a range of keys takes some 4,096th of the rows, never more than fit a task
    bound = max(64, min(1 << 18, int(whole["n"]) // 4096))
    placed = rank_within(keys.withColumn("shard", shard.cast("int")), ["shard"], list(WORDS), _digits(), bound=bound)
    return placed.select("row", "size", "shard", (F.col("_rn") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(row, size, shard, slot) for whole documents; size: bytes of the text plus 1, groups: equal texts."""
    return shard_rows(docs, F.octet_length(C.whole_text()) + 1, C.whole_text(), F.col("doc_id"), shards, tolerance)


def write_shards(placed: DataFrame, path: str) -> None:
    """The shards as Parquet folders ``shard=<n>``; files hold runs of slots."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, checksum, shard of 16 and slot, by near-equal bytes."""
    text = C.whole_text()
    # the digest needs no texts: what is stored and exchanged is the id, the checksum and the key
    slim = C.documents(spark, sf_dir).select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).alias("n"),
                                             F.xxhash64(text).alias("g"))
    placed = shard_rows(slim, F.col("n") + 1, F.col("g"), F.col("doc_id"))
    return placed.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "size", F.col("row.text_crc32").alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
