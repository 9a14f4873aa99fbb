"""Shared helpers: whole-table access, Arrow text chunks, vectorised words and hashes.

Words are the maximal runs ``[^\\x20\\x09-\\x0D]+`` of a text, found on its UTF-8
bytes (the six separators are single bytes, so byte and character views agree).
All helpers work on numpy arrays inside Spark tasks; Spark partitions the rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20
WORD_SQL = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def crc_mod(column: str, mod: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text); one aggregate, two numbers reach the driver."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(whole_text(column))).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    return ensure_checkpoint_dir(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer held.

    Spark's cleaner removes a shuffle's files once the driver's JVM has collected the plan; a driver with little
    to do collects rarely, and the executors' disks fill meanwhile. Call it after a checkpoint that ends a large exchange.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8_of(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    n = len(arr)
    _, off, data = arr.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, dtype=np.int64 if large else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets).

    A row longer than the limit makes a run of its own; no text is cut.
    """
    data, offs = utf8_of(arr)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
_POW: dict[int, np.ndarray] = {_BASE: np.ones(1, U64), _INV: np.ones(1, U64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (grown by doubling, kept per worker)."""
    p = _POW.setdefault(base, np.ones(1, U64))
    while len(p) < n:
        p = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
    _POW[base] = p
    return p[:n]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total); words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: polynomial over random byte codes, then mixed."""
    if not len(starts):
        return np.zeros(0, U64)
    acc = np.empty(len(data) + 1, U64)
    acc[0] = 0
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=acc[1:])
    h = (acc[ends] - acc[starts]) * powers(_INV, len(data))[starts]
    return mix64(h ^ ((ends - starts).astype(U64) * U64(0xA0761D6478BD642F)))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` values (polynomial modulo 2**64).

    Rolled with running sums: sum(v[i+j] * B**j) = (S[i+width] - S[i]) * B**-i.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    acc = np.empty(n + 1, U64)
    acc[0] = 0
    np.cumsum(values * powers(_BASE, n), out=acc[1:])
    return mix64((acc[width:] - acc[:-width]) * powers(_INV, n)[:n - width + 1])


def inside_rows(first: np.ndarray, width: int) -> np.ndarray:
    """Mask of the window starts (over all words) whose window stays in one row."""
    total = int(first[-1])
    ok = np.ones(max(0, total - width + 1), dtype=bool)
    if len(ok):
        # the last width-1 words of each row start no window
        for k in range(1, width):
            bad = first[1:-1] - k
            lo = first[:-2]
            bad = bad[bad >= lo]
            ok[bad[bad < len(ok)]] = False
    return ok
