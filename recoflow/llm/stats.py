"""Statistics of whole texts, vectorised over Arrow chunks, and the labelled sample.

Line and window equality is decided by 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import common as C

#: Structure features and the direction in which quality may move with each (0: free).
FEATURES = (
    ("log_words", 0), ("mean_word_len", 0), ("symbol_ratio", -1), ("dup_line_ratio", -1), ("repeat_ratio", -1),
    ("upper_ratio", -1), ("digit_ratio", 0), ("mark_ratio", -1), ("distinct_ratio", 0), ("words_per_line", 0),
    ("short_word_ratio", 0), ("symbol_word_ratio", -1),
)
NAMES = tuple(n for n, _ in FEATURES)
DIRECTION = tuple(d for _, d in FEATURES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    acc = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return acc[offs[1:]] - acc[offs[:-1]]


def _row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return C.mix64(values ^ C.mix64(row.astype(C.U64) + C.U64(0x51ED27)))


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Per row: words inside windows of ``width`` words found twice or more in the row."""
    total = int(first[-1])
    at = np.flatnonzero(C.inside_rows(first, width))
    cover = np.zeros(total + 1, np.int32)
    if len(at):
        row = np.searchsorted(first, at, side="right") - 1
        key = _in_row(C.rolling(hashes, width)[at], row)
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        cover[:total] += np.bincount(hit, minlength=total)[:total].astype(np.int32)
        cover -= np.bincount(hit + width, minlength=total + 1)[:total + 1].astype(np.int32)
    return _per_row(np.cumsum(cover)[:total] > 0, first)


def text_stats(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(counts per row, word hashes, first word of each row) of one chunk."""
    starts, ends, first = C.word_spans(data, offs)
    hashes = C.word_hashes(data, starts, ends)
    n_rows = len(offs) - 1
    point = (data & 0xC0) != 0x80
    space = C._SPACE[data]
    out = {"n_words": np.diff(first), "word_chars": _per_row(point & ~space, offs), "n_symbols": _per_row(_SYMBOL[data], offs),
           "n_repeat_words": repeated_words(hashes, first)}
    # a line runs from its row's start or a line feed to the next line feed or the row's end
    feed = np.flatnonzero(data == 10)
    begin = np.concatenate([offs[:-1], feed + 1])
    row = np.concatenate([np.arange(n_rows), np.searchsorted(offs, feed, side="right") - 1])
    end = np.minimum(np.append(feed, len(data))[np.searchsorted(feed, begin)], offs[row + 1])
    wordy = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    row = row[wordy]
    key = _in_row(C.word_hashes(data, begin[wordy], end[wordy]), row)
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    out["n_lines"] = np.bincount(row, minlength=n_rows)
    out["n_dup_lines"] = np.bincount(row[again], minlength=n_rows)
    out["n_upper"], out["n_letters"], out["n_digits"] = (_per_row(m[data], offs) for m in (_UPPER, _LETTER, _DIGIT))
    out["n_marks"] = _per_row(data == 33, offs)
    size = ends - starts
    out["n_short"] = _per_row(size <= 3, first)
    tail = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    out["n_symbol_words"] = _per_row(tail, first)
    if len(hashes):
        wrow = _row_of(first)
        u = np.unique(_in_row(hashes, wrow), return_index=True)[1]
        out["n_distinct"] = np.bincount(wrow[u], minlength=n_rows)
    else:
        out["n_distinct"] = np.zeros(n_rows, np.int64)
    return out, hashes, first


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x FEATURES, finite for every text (an empty one has zeros)."""
    words = np.maximum(s["n_words"], 1).astype(np.float64)
    chars = np.maximum(s["word_chars"], 1)
    cols = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            s["n_repeat_words"] / words, s["n_upper"] / np.maximum(s["n_letters"], 1), s["n_digits"] / chars, s["n_marks"] / words,
            s["n_distinct"] / words, np.log1p(s["n_words"] / np.maximum(s["n_lines"], 1)), s["n_short"] / words, s["n_symbol_words"] / words]
    return np.stack(cols, axis=1).astype(np.float32)


def labelled_ids(spark: SparkSession, sf_dir: str, bound: int, label: str = "quality") -> DataFrame:
    """At most ``bound`` labelled ids of the learning rows (crc32(doc_id) mod 3 is not 1).

    The ids with the smallest hashes are taken, so the sample does not depend on
    the layout. Null ids or labels and ids labelled both ways are left out.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    one = (labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
           .where(C.crc_mod("doc_id", 3) != 1)
           .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
