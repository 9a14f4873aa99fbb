"""Union-find, n-gram join and line dedup against brute force over all pairs."""

import random
import re

import pytest

from recoflow.llm import line_dedup as L
from recoflow.llm import ngram_join as J
from recoflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 230)]
    rng.shuffle(edges)
    nodes = {n for e in edges for n in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    want = {n: r for n, r in classes(nodes, edges).items() if n != r}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(rng, n_groups, words):
    out = []
    for g in range(n_groups):
        base = [f"{rng.choice(words)}{rng.randrange(200)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(999)}"
            out.append(" ".join(t))
    return out


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("block", [3, 256])
def test_ngram_join_equals_all_pairs(spark, block):
    rng = random.Random(4)
    texts = near_texts(rng, 25, ["lorem", "ipsum", "dolor"])
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[0]), (501, texts[0] + "\n"), (502, "two words"), (503, "two  words"), (504, ""), (505, None),
                                                    (None, texts[0]), (None, "solo null row here now yes"), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS comp")
    sets = [grams(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = classes(range(len(rows)), links)
    groups = {}
    for k, r in root.items():
        groups.setdefault(r, []).append(rows[k][0])
    head = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = sorted(((rows[k][0], head[root[k]], count[k]) for k in range(len(rows))), key=repr)
    got = J.join_copies(df, block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == want
    kept = J.keep_first(spark, df, "").collect()
    assert len(kept) == len(groups) and kept[0].__fields__ == df.columns
    assert J.join_copies(df.limit(0)).count() == 0


def test_banding_reaches_recall():
    bands, rows = J.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 256


def shingles(line):
    u = line.encode("utf-16-be")
    n = len(u) // 2
    return {u[2 * i:2 * i + 2 * L.SHINGLE] for i in range(max(1, n - L.SHINGLE + 1))}


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(6)
    lines = near_texts(rng, 20, ["lorem", "ipsümß", "日本"]) + ["a", "a", "short", " pad ", "Page 1 of 100 in the long report of the year", "Page 2 of 100 in the long report of the year"]
    rows, k = [], 0
    rng.shuffle(lines)
    while k < len(lines):
        n = rng.randrange(1, 5)
        rows.append((len(rows), "\n".join(lines[k:k + n]) + rng.choice(["", "\n", "\n\n \n"])))
        k += n
    rows += [(900, rows[0][1]), (901, None), (902, ""), (903, "\n \n"), (None, rows[1][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) AS long) AS n_chars", "1 AS line", "2 AS kept")
    cells = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if WORD.search(line)]
    sets = [shingles(c[2]) for c in cells]
    links = [(a, b) for a in range(len(cells)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = classes(range(len(cells)), links)
    key = lambda c: (c[0] is not None, -1 if c[0] is None else c[0], c[1])
    head = {}
    for k, r in root.items():
        head[r] = min(head.get(r, cells[k]), cells[k], key=key)
    want = sorted(((c[0], c[1], head[root[k]][0], head[root[k]][1], key(c) == key(head[root[k]])) for k, c in enumerate(cells)), key=repr)
    got = L.dedup_lines(df).collect()
    assert sorted(((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.kept) for r in got), key=repr) == want
    out = L.drop_lines(spark, df, "").collect()
    keep = {(w[0], w[1]) for w in want if w[4]}
    texts = []
    for i, t in rows:
        parts = (t or "").split("\n")
        wordy = [k for k, x in enumerate(parts) if WORD.search(x)]
        if wordy and not any((i, k) in keep for k in wordy):
            continue
        texts.append((i, t if t is None else "\n".join(x for k, x in enumerate(parts) if k not in wordy or (i, k) in keep)))
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(texts, key=repr)
    assert all(r.text is None or r.n_chars == len(r.text) for r in out) and out[0].__fields__ == df.columns
    assert L.dedup_lines(df.limit(0)).count() == 0
