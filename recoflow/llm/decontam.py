"""Benchmark decontamination by the q-gram lemma, in diagonal bands.

Texts and items are normalised (ASCII and Latin-1 letters in lower case, each run of
white space one blank). An item of m bytes within e edits of a region shares at
least m - q + 1 - q*e of its q-grams with it, on diagonals no more than e apart.
So hits are counted per item in overlapping bands of 2*(e+1) diagonals (each
hit in two bands, so every e+1 neighbouring diagonals share one), bands that
reach the bound are kept, and each kept region is verified by a
banded alignment of at most e = ``rate`` * m edits.

The benchmark is cut into blocks of bounded size; each block's q-gram index goes
to all tasks, which pass over the texts once per block (one block up to
``BLOCK_BYTES`` of items). No document is shuffled or cut.

Defined cases: null or empty items match nothing; an item of fewer than q
bytes matches only a text that equals it; e falls where the bound would be under
1; null and empty texts match nothing; rows that repeat are matched one by
one, repeated rows of the benchmark once; extra columns of either table
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import common as C

Q = 12
RATE = 0.05
BLOCK_BYTES = 8 << 20
OUT = "doc_id long, item_id long, start long, end long, edits int"


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, their row offsets, original place of each byte)."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += 32
    space = C._SPACE[data]
    low[space] = 32
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = ~(space[1:] & space[:-1])
        keep[offs[:-1][np.diff(offs) > 0]] = True
    at = np.flatnonzero(keep)
    return low[at], np.searchsorted(at, offs), at


def normalise_text(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")


@dataclass
class Index:
    """q-grams of a block of items: sorted hashes, postings (item, place), and budgets."""

    item_ids: list[int | None]
    items: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    short: dict[bytes, list[int]]


def build_index(rows: list[tuple[int | None, str | None]], q: int = Q, rate: float = RATE) -> Index:
    items = [normalise_text(t) for _, t in rows]
    ids = [i for i, _ in rows]
    m = np.array([len(x) for x in items], np.int64)
    budget = np.maximum(0, np.minimum((rate * m).astype(np.int64), (m - q) // q))
    short: dict[bytes, list[int]] = {}
    hs, owner, place = [], [], []
    for k, x in enumerate(items):
        if 0 < len(x) < q:
            short.setdefault(x, []).append(k)
        elif x:
            h = C.rolling(C._BYTE[np.frombuffer(x, np.uint8)], q)
            hs.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
    h = np.concatenate(hs) if hs else np.zeros(0, C.U64)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    cat = lambda xs: np.concatenate(xs)[order] if xs else np.zeros(0, np.int64)
    bits = max(16, int(len(keys) * 16).bit_length())
    maybe = np.zeros(1 << bits, bool)
    maybe[(keys >> C.U64(64 - bits)).astype(np.int64)] = True
    return Index(ids, items, budget, m - q + 1 - q * budget, keys, np.append(first, len(h)), cat(owner), cat(place), maybe, short)


def align(pattern: np.ndarray, text: np.ndarray, free_start: bool) -> tuple[int, int]:
    """(edits, end in text) of the best alignment of the whole pattern; the start is free or at 0.

    Rows of the pattern over all diagonals of the text window, which is as
    narrow as the band plus the pattern.
    """
    n, m = len(text), len(pattern)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64) if free_start else ramp.copy()
    for j in range(m):
        nxt = np.empty(n + 1, np.int64)
        nxt[0] = row[0] + 1
        nxt[1:] = np.minimum(row[:-1] + (text != pattern[j]), row[1:] + 1)
        row = np.minimum.accumulate(nxt - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Like ``align`` with a free start, on diagonals (text place - pattern place) low..high only."""
    n, m, width = len(text), len(pattern), high - low + 1
    big = m + n + 1
    ramp = np.arange(width)
    pad = np.full(m + n + 2 * width + abs(low) + abs(high) + 2, 256, np.int64)
    base = abs(low) + width
    pad[base:base + n] = text
    k = low + ramp
    row = np.where((k >= 0) & (k <= n), 0, big)
    for j in range(m):
        here = pad[base + low + j:base + low + j + width]  # text place of each diagonal at row j
        nxt = row + (here != pattern[j])
        nxt[:-1] = np.minimum(nxt[:-1], row[1:] + 1)
        nxt = np.where((k + j + 1 >= 0) & (k + j + 1 <= n), nxt, big)
        row = np.minimum.accumulate(nxt - ramp) + ramp
        row = np.where((k + j + 1 >= 0) & (k + j + 1 <= n), row, big)
    d = int(np.argmin(row))
    return int(row[d]), m + low + d


def find(index: Index, data: np.ndarray, offs: np.ndarray, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) in bytes of the given texts; overlapping finds of an item are one."""
    text, rows, back = normalise(data, offs)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    if index.short:
        for r in np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) <= q + 1)):
            whole = text[rows[r]:rows[r + 1]].tobytes().strip(b" ")
            for k in index.short.get(whole, ()):
                lead = int(text[rows[r]] == 32)
                found[(int(r), k)] = [(int(rows[r]) + lead, int(rows[r]) + lead + len(whole), 0)]
    if len(index.keys) and len(text) >= q:
        h = C.rolling(C._BYTE[text], q)
        shift = C.U64(64 - (len(index.maybe).bit_length() - 1))
        p = np.flatnonzero(index.maybe[(h >> shift).astype(np.int64)])
        k = np.minimum(np.searchsorted(index.keys, h[p]), len(index.keys) - 1)
        row = np.searchsorted(rows, p, side="right") - 1
        ok = (index.keys[k] == h[p]) & (p + q <= rows[row + 1])
        p, k, row = p[ok], k[ok], row[ok]
        many = index.first[k + 1] - index.first[k]
        p, row = np.repeat(p, many), np.repeat(row, many)
        posting = np.repeat(index.first[k], many) + (np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many))
        item, diagonal = index.item[posting], p - index.place[posting]
        step = index.budget[item] + 1
        band = diagonal // step
        pair = row * len(index.items) + item
        key = np.concatenate([pair, pair]) << np.int64(32) | (np.concatenate([band, band - 1]) + (1 << 30))
        key, count = np.unique(key, return_counts=True)
        item = (key >> np.int64(32)) % len(index.items)
        for kk in np.flatnonzero(count >= index.bound[item]):
            r, i = divmod(int(key[kk]) >> 32, len(index.items))
            e, x = int(index.budget[i]), index.items[i]
            low = ((int(key[kk]) & 0xFFFFFFFF) - (1 << 30)) * (e + 1)
            a, z = max(int(rows[r]), low - e), min(int(rows[r + 1]), low + 2 * (e + 1) + len(x) + e)
            span = _verify(text[a:z], x, e, low - a)
            if span:
                found.setdefault((r, i), []).append((a + span[0], a + span[1], span[2]))
    out = []
    for (r, i), spans in found.items():
        last = None
        for s, z, e in sorted(spans):
            if last and s < last[1]:  # the same copy, seen from two bands: the better one stays
                last = min(last, (s, z, e), key=lambda v: (v[2], v[0]))
                continue
            if last:
                out.append((r, i, *last))
            last = (s, z, e)
        out.append((r, i, *last))
    return [(r, i, int(back[s]), int(back[z - 1]) + 1, e) for r, i, s, z, e in out]


def _verify(window: np.ndarray, item: bytes, budget: int, low: int) -> tuple[int, int, int] | None:
    at = window.tobytes().find(item)
    if at >= 0:
        return at, at + len(item), 0
    if not budget:
        return None
    pattern = np.frombuffer(item, np.uint8).astype(np.int64)
    wide = window.astype(np.int64)
    edits, end = banded(pattern, wide, low - budget, low + 2 * (budget + 1) + budget)
    if edits > budget:
        return None
    # the start: the same alignment backwards from its end
    back = wide[max(0, end - len(item) - budget):end][::-1]
    _, size = align(pattern[::-1], back, free_start=False)
    return end - size, end, edits


def benchmark_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of at most ``block_bytes`` (or one item); each is a list of rows."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = max(1, -(-C.text_size(rows)[1] // block_bytes))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        worst = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.countDistinct("item_id", "text").alias("k")).where(
            (F.col("b") > 2 * block_bytes) & (F.col("k") > 1)).limit(1).count()
        if not worst:
            break
        n *= 2
    for k in range(n):
        got = dealt.where(F.col("block") == k).select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        if got:
            yield [(r["item_id"], r["text"]) for r in got]


def matches(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """One row per leaked passage: doc_id, item_id, start and end (code points), edits.

    With several blocks, each one's matches are written before the next index is built.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
    out, last = None, None
    for rows in benchmark_blocks(items):
        if last is not None:
            last = C.checkpointed(last)
            out = last if out is None else out.union(last)
        last = texts.mapInArrow(_scan(build_index(rows, q, rate), q), OUT)
    if last is None:
        return spark.createDataFrame([], OUT)
    return last if out is None else out.union(last)


def _scan(index: Index, q: int):
    def run(batches):
        for b in batches:
            rows = []
            for i, j, data, offs in C.chunks(b.column("text")):
                for r, k, s, e, edits in find(index, data, offs, q):
                    point = (data[offs[r]:offs[r + 1]] & 0xC0) != 0x80
                    s, e = s - offs[r], e - offs[r]
                    rows.append((b.column("doc_id")[i + r].as_py(), index.item_ids[k], int(point[:s].sum()), int(point[:e].sum()), edits))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(),))],
                                  names=["doc_id", "item_id", "start", "end", "edits"])
    return run


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows without a leaked passage, all columns as they came."""
    schema, items = docs.schema, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    for rows in benchmark_blocks(items):
        docs = docs.mapInArrow(_filter(build_index(rows), Q), schema)
    return docs


def _filter(index: Index, q: int):
    def run(batches):
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for i, _, data, offs in C.chunks(b.column("text")):
                for r, *_ in find(index, data, offs, q):
                    clean[i + r] = False
            yield b.filter(pa.array(clean))
    return run
