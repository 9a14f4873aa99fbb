"""Removal of repeated windows against a plain dictionary of windows."""

import hashlib
import random
import re

import pytest

from recoflow.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - width + 1) for j in range(width) if i is not None and least[tuple(w[k:k + width])] < i}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_equals_plain_windows(spark, block_bytes):
    rng = random.Random(5)
    words = ["a", "b", "çé", "日本", "x y", "a"]
    shared = " ".join(rng.choice(words) for _ in range(9))
    rows = [(None, shared), (1, None), (2, ""), (3, "a b"), (4, shared), (4, shared), (4, "other " + shared), (9, shared), (2**40, "z " * 700 + shared)]
    rows += [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(3)) + (" " + shared if i % 3 else ""))
             for i in range(10, 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS block", "1 AS kept_text")
    got = remove_repeats(df, width=4, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=repr) == plain(rows, 4)
    for r in got:
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:]))  # maximal
    assert remove_repeats(df.limit(0)).count() == 0
