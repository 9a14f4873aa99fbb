"""Substring dedup: Rabin-Karp hashes of every 13-word window, counted in Spark.

A word goes when a window that covers it repeats a window that starts in a
document with a smaller ``doc_id``; windows are judged on the input texts.

Plan. Documents are dealt into blocks (a hash of ``doc_id``). A block hashes
all its windows, keeps each distinct hash once with its smallest document, and
sends them grouped by hash range as packed arrays; so a passage that a third of
all documents share costs at most one entry per block. One task per range finds
the smallest document of each hash and answers each block with one bit per
entry ("a smaller document elsewhere has it"). The block (same exchange of the
texts, reused) recomputes its entries and turns bits into maximal removal
intervals. Rows without ``doc_id`` stay where they are. The answer is exact up to collisions of 64-bit hashes.

Defined cases: a null or blank text has no words; texts under 13 words lose
nothing; a row without ``doc_id`` neither removes nor loses words; rows that
repeat a ``doc_id`` don't remove each other's words (no id is smaller), though
a smaller id removes from both; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm import common as C

WINDOW = 13
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, intervals array<struct<start:long,end:long>>"


def _windows(table: pa.Table, width: int):
    """Rows of a block by doc_id; for its windows: hash, word position, document."""
    ids = table.column("doc_id")
    null = np.asarray(ids.is_null())
    key = np.asarray(ids.fill_null(0)).astype(np.int64)
    order = np.lexsort((key, null))
    table = table.take(pa.array(order))
    key, null = key[order], null[order]
    hashes, docs, where, firsts, base = [], [], [], [0], 0
    for i, j, data, offs in C.chunks(table.column("text").combine_chunks()):
        starts, ends, first = C.word_spans(data, offs)
        roll = C.rolling(C.word_hashes(data, starts, ends), width)
        at = np.flatnonzero(C.inside_rows(first, width))
        doc = np.searchsorted(first, at, side="right") - 1 + i
        at, doc = at[~null[doc]], doc[~null[doc]]
        hashes.append(roll[at])
        docs.append(doc)
        where.append(at + base)
        firsts.extend((first[1:] + base).tolist())
        base += int(first[-1])
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return table, key, cat(hashes, C.U64), cat(docs, np.int64), cat(where, np.int64), np.array(firsts, np.int64)


def _entries(h: np.ndarray):
    """Distinct hashes sorted, index of the first window of each, entry of each window."""
    order = np.argsort(h, kind="stable")  # stable: the first is the smallest document
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(new) - 1
    return s[new], order[new], entry


def _range_bounds(distinct: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ends of equal hash ranges in sorted hashes; n_ranges is a power of two."""
    if n_ranges == 1:
        return np.array([0, len(distinct)])
    shift = 64 - (n_ranges.bit_length() - 1)
    cuts = np.arange(1, n_ranges, dtype=C.U64) << C.U64(shift)
    return np.concatenate([[0], np.searchsorted(distinct, cuts), [len(distinct)]])


def _pack(h: np.ndarray) -> bytes:
    """The low 56 bits; the range holds the others when there are 256 ranges or more."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view(C.U64).ravel()


def ask(width: int, n_ranges: int):
    def run(key, table):
        block = key[0].as_py()
        _, ids, h, doc, _, _ = _windows(table, width)
        distinct, first, _ = _entries(h)
        rows = {"rng": [], "block": [], "hashes": [], "docs": []}
        ends = _range_bounds(distinct, n_ranges)
        # within a range the entries go by document, so that ids are sent once each
        for r in np.flatnonzero(np.diff(ends)):
            part = slice(ends[r], ends[r + 1])
            o = np.argsort(first[part], kind="stable")
            owner = ids[doc[first[part][o]]]
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            runs = np.stack([owner[cut], np.diff(np.concatenate([cut, [len(owner)]]))])
            rows["rng"].append(int(r))
            rows["block"].append(block)
            rows["hashes"].append(_pack(distinct[part][o]))
            rows["docs"].append(runs.astype("<i8").tobytes())
        return pa.table(rows, schema=pa.schema([("rng", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())]))
    return run


def answer(table):
    """For one range: which entries of each block also start in a smaller document."""
    hs, ds, sizes = [], [], []
    for hb, db in zip(table.column("hashes").to_pylist(), table.column("docs").to_pylist()):
        h = _unpack(hb)
        runs = np.frombuffer(db, "<i8").reshape(2, -1)
        hs.append(h)
        ds.append(np.repeat(runs[0], runs[1]))
        sizes.append(len(h))
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((d, h))
    s, sd = h[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    least = sd[new][np.cumsum(new) - 1]
    hit = np.empty(len(h), dtype=bool)
    hit[order] = least < sd
    rows = {"rng": [], "block": [], "bits": []}
    at = 0
    for block, rng, n in zip(table.column("block").to_pylist(), table.column("rng").to_pylist(), sizes):
        if hit[at:at + n].any():
            rows["rng"].append(rng)
            rows["block"].append(block)
            rows["bits"].append(np.packbits(hit[at:at + n]).tobytes())
        at += n
    return pa.table(rows, schema=pa.schema([("rng", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())]))


def apply_bits(width: int, n_ranges: int, texts: bool):
    def run(table, bits):
        table, ids, h, doc, at, first_word = _windows(table, width)
        distinct, first, entry = _entries(h)
        flag = np.zeros(len(distinct), dtype=bool)
        ends = _range_bounds(distinct, n_ranges)
        for r, b in zip(bits.column("rng").to_pylist(), bits.column("bits").to_pylist()):
            n = int(ends[r + 1] - ends[r])
            o = np.argsort(first[ends[r]:ends[r + 1]], kind="stable")
            flag[ends[r] + o] = np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        gone = flag[entry] | (ids[doc] > ids[doc[first[entry]]]) if len(h) else np.zeros(0, bool)
        total = int(first_word[-1])
        cover = np.zeros(total + 1, np.int32)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + width, -1)
        removed = np.cumsum(cover)[:total] > 0
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "intervals")}
        out["doc_id"] = table.column("doc_id").to_pylist()
        for i, text in enumerate(table.column("text").cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            mask = removed[first_word[i]:first_word[i + 1]]
            n = int(mask.sum())
            spans = []
            if n:
                words = list(compress(words, (~mask).tolist()))
                d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]
            kept = b" ".join(words)
            out["n_words"].append(len(mask))
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode() if texts else None)
            out["intervals"].append(spans)
        return pa.table(out, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
            ("kept_text", pa.string()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
    return run


def _alone(width: int, n_ranges: int, texts: bool):
    """Rows without doc_id, which no window of another row touches: where they are, 512 at a time."""
    none = pa.table({"rng": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                yield from apply_bits(width, n_ranges, texts)(pa.Table.from_batches([b.slice(i, 512)]), none).to_batches()
    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW, block_bytes: int = 8 << 20, texts: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, kept text, removed word intervals.

    ``block_bytes`` bounds the text that a task holds at once; ``texts=False``
    leaves ``kept_text`` null when only the digest is needed.
    """
    _, size = C.text_size(docs)
    n_blocks = max(1, -(-size // block_bytes))
    # 256 ranges at least, so that the 56 bits sent and the range make up the whole hash
    n_ranges = 256
    while n_ranges * block_bytes < size:
        n_ranges *= 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text"))
    blocks = (rows.where("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
              .repartition(n_blocks, "block"))
    asked = blocks.groupBy("block").applyInArrow(ask(width, n_ranges), "rng long, block long, hashes binary, docs binary")
    answers = asked.groupBy("rng").applyInArrow(answer, "rng long, block long, bits binary")
    judged = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply_bits(width, n_ranges, texts), OUT)
    return judged.union(rows.where("doc_id IS NULL").mapInArrow(_alone(width, n_ranges, texts), OUT))


def op10(spark, sf_dir: str) -> DataFrame:
    return (remove_repeats(C.documents(spark, sf_dir), texts=False)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM bad, (SELECT unnest(generate_series(0, 12)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS t, count(*) AS n
         FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
