"""Leaks against brute-force alignment of every item with every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from recoflow.llm import common as C
from recoflow.llm import decontam as D
from recoflow.llm.common import documents
from tests.conftest import SF_SMALL


def edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(pattern):
        nxt = [j + 1]
        for k, t in enumerate(text):
            nxt.append(min(row[k] + (c != t), row[k + 1] + 1, nxt[k] + 1))
        row = nxt
    return min(row)


def damage(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        op = rng.randrange(3)
        if op == 0:
            s[k] = rng.choice("xyz ")
        elif op == 1:
            s.insert(k, rng.choice("xyz"))
        else:
            s.pop(k)
    return "".join(s)


@pytest.mark.parametrize("limit", [1, 4000, 1 << 20])
def test_equals_brute_force(limit):
    rng = random.Random(8)
    syllables = ["the", "ing", "ér", "on", "ly", "an", "ß", "of", " ", " ", "\n", "  "]
    make = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [make(rng.randrange(25, 80)) for _ in range(8)] + ["tiny one", "", None, "Sîxteen letters!"]
    texts = ["", "tiny one", " Tiny  ONE ", "not tiny one", "SÎXTEEN   letters!"]
    for k in range(60):
        item = items[k % 8]
        texts.append(make(20) + (damage(rng, item, rng.randrange(12)).upper() if k % 3 else "") + make(20))
    index = D.build_index(list(enumerate(items)))
    got = set()
    for i, _, data, offs in C.chunks(pa.array(texts), limit):
        for r, k, s, e, n in D.find(index, data, offs):
            got.add((i + r, k))
            assert edits(D.normalise_text(items[k]), D.normalise_text(texts[i + r])) <= n <= index.budget[k]
            part = data[s:e].tobytes().decode()
            assert edits(D.normalise_text(part), D.normalise_text(items[k])) <= n
    want = set()
    for t, text in enumerate(texts):
        n = D.normalise_text(text)
        for k, item in enumerate(items):
            x = D.normalise_text(item)
            if len(x) >= D.Q and edits(x, n) <= index.budget[k] or 0 < len(x) < D.Q and x == n:
                want.add((t, k))
    assert got == want


def test_banded_equals_whole_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p = rng.integers(0, 3, rng.integers(3, 20))
        t = rng.integers(0, 3, rng.integers(1, 30))
        n, _ = D.align(p, t, free_start=True)
        assert n == D.banded(p, t, -len(p), len(t))[0] == edits(p.tolist(), t.tolist())


def test_op_finds_planted_passages(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, items).where("edits = 0").collect()}
    texts = [(r.doc_id, D.normalise_text(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = {(i, r.item_id) for r in items.collect() for i, t in texts if D.normalise_text(r.text) in t}
    assert want and want <= got
    for r in D.matches(docs, items).collect():
        assert 0 <= r.start < r.end


def test_blocks_and_odd_rows(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, words), (1, words), (2, words[::-1]), (None, "null id passage of some length here"), (4, None), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"é {words}!"), (1, f"é {words}!"), (None, words[::-1]), (3, None), (4, ""), (5, "null id passage of some length here")],
                                 "doc_id long, text string").selectExpr("*", "'a' AS item_id", "1 AS edits")
    want = {(1, 1, 2, 2 + len(words)), (None, 2, 0, len(words)), (5, None, 0, 35)}
    for size in (D.BLOCK_BYTES, 40):
        assert len(list(D.benchmark_blocks(items, size))) == (1 if size > 40 else len(list(D.benchmark_blocks(items, 40))))
        got = D.matches(docs, items).collect()
        assert {(r.doc_id, r.item_id, r.start, r.end) for r in got} == want and len(got) == 4
    assert D.matches(docs, items.limit(0)).count() == 0 and D.matches(docs.limit(0), items).count() == 0
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = D.keep_clean(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4] and kept[0].__fields__ == docs.columns
