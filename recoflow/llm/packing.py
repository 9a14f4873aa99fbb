"""Packing by Karmarkar-Karp multiway differencing.

A document's ids (with the end id) are cut into full windows of ``capacity`` and a
rest, the rest into pieces of at most ``piece`` ids. Full windows stand alone.
The other pieces of a task are gathered into groups of some ``windows`` windows'
worth; in a group, every piece starts as a partial partition of k slots; the
two partitions with the largest spread merge, largest slot on smallest slot,
until one is left: k near-equal windows. k starts at the least that the total
allows and rises while a window exceeds the capacity. Nothing is shuffled: the
windows of a group hold pieces of one task's rows, and memory is bounded by a
group and one Arrow batch.

Defined cases: a null or empty text is its end id alone; rows that repeat a
``doc_id``, or have none, are packed one by one; no document, no sequence;
extra columns of the input are ignored. ``sequence_id`` has the task in its high
bits, so it is unique and the same when a task runs again on the same input.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import common as C
from recoflow.llm import tokens as T

CAPACITY = 2048
END_ID = 1
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k slots with near-equal sums (Karmarkar-Karp, k-way)."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, ma = heapq.heappop(heap)
        _, _, b, mb = heapq.heappop(heap)
        sums = a + b[::-1]  # both descend: the largest meets the smallest
        order = np.argsort(-sums, kind="stable")
        slots = [x + y if y else x for x, y in zip(ma, reversed(mb))]
        sums = sums[order]
        tie += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, [slots[i] for i in order.tolist()]))
    return heap[0][3] if heap else [[] for _ in range(k)]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least number of windows, from the total upwards, whose differencing fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        slots = differencing(sizes, k)
        most = max((sum(sizes[i] for i in s) for s in slots), default=0)
        if most <= capacity:
            return [s for s in slots if s]
        k += max(1, k * (most - capacity) // (4 * capacity))


def _packer(path: str, capacity: int, end_id: int, piece: int, windows: int, with_ids: bool):
    def run(batches):
        enc, end = T.encoder(path), np.array([end_id], "<u2").tobytes()
        next_id = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        load = 0
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
        rows: dict[str, list] = {k: [] for k in names}

        def put(sequence: list[tuple]) -> None:
            nonlocal next_id
            at = 0
            for doc, start, ids, total in sequence:
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                n = len(ids) // 2
                for name, v in zip(names, (doc, start, n, zlib.crc32(wide), total, next_id, at, wide if with_ids else None)):
                    rows[name].append(v)
                at += n
            next_id += 1

        def settle() -> None:
            nonlocal waiting, load
            for slot in windows_of([len(x[2]) // 2 for x in waiting], capacity):
                put([waiting[i] for i in slot])
            waiting, load = [], 0

        def flush():
            batch = pa.record_batch([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=list(names))
            for v in rows.values():
                v.clear()
            return batch

        for b in batches:
            for i, j, data, offs in C.chunks(b.column("text")):
                raw, docs = data.tobytes(), b.column("doc_id")[i:j].to_pylist()
                for doc, ids in zip(docs, enc.encode([raw[offs[k]:offs[k + 1]] for k in range(j - i)])):
                    ids += end
                    total = len(ids) // 2
                    full = total // capacity * capacity
                    for s in range(0, full, capacity):
                        put([(doc, s, ids[2 * s:2 * (s + capacity)], total)])
                    parts = -(-(total - full) // piece)
                    cuts = [full + (total - full) * p // parts for p in range(parts + 1)] if parts else []
                    for s, e in zip(cuts, cuts[1:]):
                        waiting.append((doc, s, ids[2 * s:2 * e], total))
                        load += e - s
                    if load >= windows * capacity:
                        settle()
                if len(rows["doc_id"]) >= 4096:
                    yield flush()
        settle()
        yield flush()
    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = 512,
         windows: int = 64, with_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place and ids, its sequence and offset there."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
            .mapInArrow(_packer(path or T.vocabulary_path(), capacity, end_id, piece, windows, with_ids), OUT))


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir), with_ids=False).drop("ids")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of what is kept, with their ids."""
    return pack(docs)
