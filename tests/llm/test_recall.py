"""Measured recall of the MinHash bands on planted pairs, small sets included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recoflow.llm import line_dedup as L
from recoflow.llm import ngram_join as J

PAIRS = 1000


def planted(union, seed):
    """Pairs of hash sets at Jaccard 0.8 exactly."""
    rng = np.random.default_rng(seed)
    common = union * 8 // 10
    for _ in range(PAIRS):
        h = rng.integers(0, 1 << 64, union, dtype=np.uint64)
        half = (union - common) // 2
        yield np.sort(h[:common + half]), np.sort(np.concatenate([h[:common], h[common + half:]]))


@pytest.mark.parametrize("union", [10, 20, 40, 80])
def test_ngram_join_recall(union):
    bands, rows = J.banding()
    flat = [s for pair in planted(union, union) for s in pair]
    _, band = J.signatures(flat, bands, rows)
    found = (band[0::2] == band[1::2]).any(axis=1).mean()
    assert found >= J.RECALL - 0.004  # four standard deviations of 1,000 pairs


def test_line_dedup_recall(spark):
    bands = L.bands_for(L.THRESHOLD, L.ROWS, L.RECALL)
    rows = [(f"{union} {k} {side}", x) for union in (10, 20, 40, 80) for k, pair in enumerate(planted(union, union)) for side, s in enumerate(pair)
            for x in s.view(np.int64).tolist()]
    h = spark.createDataFrame(rows, "line_id string, h long")
    mins = h.groupBy("line_id").agg(*L._minima(bands * L.ROWS))
    got = mins.select(F.split("line_id", " ").alias("at"), F.array(*(f"m{k}" for k in range(bands * L.ROWS))).alias("m")).collect()
    sig = {tuple(r["at"]): np.array(r["m"]).reshape(bands, L.ROWS) for r in got}
    for union in ("10", "20", "40", "80"):
        found = np.mean([(sig[union, str(k), "0"] == sig[union, str(k), "1"]).all(axis=1).any() for k in range(PAIRS)])
        assert found >= L.RECALL - 0.013, (union, found)


def test_edited_lines_are_found(spark):
    """One changed character in 40-80 characters, and one changed short word, whatever the shingle width in use."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(300):
        size = int(rng.integers(40, 81))
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), size))
        if k % 2:
            at = int(rng.integers(0, size))
            other = line[:at] + "#" + line[at + 1:]
        else:  # a word of three letters, at the line's end
            line, other = f"{line} now", f"{line} yet"
        rows += [(2 * k, line), (2 * k + 1, other)]
    got = {r.doc_id: r.class_doc_id for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [k for k in range(300) if got[2 * k + 1] != 2 * k]
    assert len(missed) <= 3 * (1 - L.RECALL) * 300, missed
