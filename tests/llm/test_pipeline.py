"""Each stage on its own input against brute force; the guard of the driver contract."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from recoflow.llm import common, decontam, quality_fm
from tests.conftest import SF_SMALL
from tests.llm.test_pairs import grams, shingles
from tests.llm.test_tokens import check_packed, crc, plain  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = [common.documents(spark, SF_SMALL)]
    root = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_SMALL).write.parquet(f"{root}/{k}")
        out.append(spark.read.parquet(f"{root}/{k}"))
    return [s.collect() for s in out], out


def test_quality_stage(spark, steps):
    rows, frames = steps
    score = {r.doc_id: r.predicted for r in quality_fm.op5(spark, SF_SMALL).collect()}
    assert sorted(r.doc_id for r in rows[1]) == sorted(r.doc_id for r in rows[0] if score[r.doc_id])
    assert frames[1].columns == frames[0].columns and {r.doc_id: r for r in rows[0]}[rows[1][0].doc_id] == rows[1][0]


def test_line_stage(steps):
    rows, frames = steps
    after = {r.doc_id: r.text for r in rows[2]}
    seen, kept_sets = {}, []
    cells = sorted((r.doc_id, k, x) for r in rows[1] for k, x in enumerate((r.text or "").split("\n")) if WORD.search(x))
    kept = {x for t in after.values() for x in (t or "").split("\n") if WORD.search(x)}
    # every line that is left is unlike all others that are left; every line has one like it that is left
    sets = {x: shingles(x) for x in kept | {c[2] for c in cells}}
    by_gram = {}
    for x in kept:
        for g in sets[x]:
            by_gram.setdefault(g, []).append(x)
    for _, _, x in cells:
        common = Counter(y for g in sets[x] for y in by_gram.get(g, ()) if y != x)
        near = [y for y, c in common.items() if 10 * c >= 8 * (len(sets[x]) + len(sets[y]) - c)]
        if x in kept:
            assert not near
        else:
            seen[x] = near
    assert sum(not n for n in seen.values()) <= 0.2 * max(1, len(seen))  # reached through a chain
    flat = [x for t in after.values() for x in (t or "").split("\n") if WORD.search(x)]
    assert len(flat) == len(set(flat)) and frames[2].columns == frames[0].columns


def test_near_copy_stage(steps):
    rows, frames = steps
    sets = {r.doc_id: grams(r.text) for r in rows[2]}
    kept = {r.doc_id for r in rows[3]}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept == {i for i in ids if find(i) == i} and len(rows[3]) == len(kept)
    assert frames[3].columns == frames[0].columns


def test_benchmark_stage(spark, steps):
    rows, frames = steps
    items = [decontam.normalise_text(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    left = {r.doc_id for r in rows[4]}
    gone = {r.doc_id for r in decontam.matches(frames[3], spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
    assert left == {r.doc_id for r in rows[3]} - gone
    assert all(not any(x in decontam.normalise_text(r.text) for x in items) for r in rows[4])
    assert frames[4].columns == frames[0].columns


def test_packing_stage(steps, plain):  # noqa: F811
    rows, _ = steps
    check_packed([(r.doc_id, r.text) for r in rows[4]], rows[5], plain)


def test_registration():
    import __spark_entry__ as entry
    q = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(n[2:].split("_")[0]) for n in q] == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
