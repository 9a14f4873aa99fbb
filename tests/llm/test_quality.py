"""Statistics against a plain count, trees and machine on held-out rows, odd inputs."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from recoflow.llm import common as C
from recoflow.llm import quality_fm as fm
from recoflow.llm import quality_rules as rules
from recoflow.llm import stats as S
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = WORD.findall(text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    hit = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "bé", "the", "x#", " ", "日本", "\n", "\n\n", " ", "\t", "\r", "$", "a", "a", "\u0085", "!"]
    out = ["", "\n", "a", "a\na\n", "\na\na", " a \n a \n a ", "x" * 5000, "a " * 3000, "é" * 40 + "\n" + "é" * 40]
    return out + [" ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 90))) for _ in range(300)]


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_stats_equal_plain_counts(limit):
    texts = odd_texts()
    got = []
    for _, _, data, offs in C.chunks(pa.array(texts), limit):
        s, _, _ = S.text_stats(data, offs)
        assert np.isfinite(S.features(s)).all()
        got += list(zip(*(s[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [plain(t) for t in texts]


def test_trees_obey_direction_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3)).astype(np.float32)
    y = ((x[:, 0] < 0.6) & (x[:, 1] + 0.2 * rng.random(800) > 0.3)).astype(float)
    f = rules.grow(x, y, (-1, 1, 0))
    assert ((f.probability(x) >= 0.5) == y).mean() > 0.95
    grid = np.linspace(0, 1, 50, dtype=np.float32)
    for fixed in rng.random((20, 3)).astype(np.float32):
        for j, sign in ((0, -1), (1, 1)):
            line = np.repeat(fixed[None], 50, 0)
            line[:, j] = grid
            assert (np.diff(f.probability(line)) * sign >= -1e-9).all()


def test_machine_identity_equals_pairwise_sum():
    rng = np.random.default_rng(1)
    d = fm.BUCKETS + len(S.FEATURES) + 1
    m = fm.Machine(np.zeros(d), np.ones(d), 0.3, rng.random(d), rng.random((d, 3)) * 0.1)
    x = np.zeros((1, d))
    x[0, [1, 5, 9, d - 1]] = [0.5, 1, 2, 3]
    want = 0.3 + x[0] @ m.w + sum(x[0, i] * x[0, j] * (m.v[i] @ m.v[j]) for i in range(d) for j in range(i) if x[0, i] and x[0, j])
    assert abs(m.logit(x)[0] - want) < 1e-9


def _accuracy(spark, df, col):
    labels = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/labels.parquet").toPandas()
    got = df.toPandas().merge(labels, on="doc_id")
    got = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    bad = got[got["quality"] == 0]
    return (got[col].astype(int) == got["quality"]).mean(), (bad[col].astype(int) == 0).mean()


def test_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    acc, recall = _accuracy(spark, fm.op5(spark, sf), "predicted")
    assert acc > 0.97 and recall > 0.9
    docs = C.documents(spark, sf)
    judged = rules.judge(docs, rules.fit(docs, sf)).selectExpr("doc_id", "probability >= 0.5 AS good")
    acc, recall = _accuracy(spark, judged, "good")
    assert acc > 0.97 and recall > 0.9


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "x", "en", None, 1), (5, "", "en", "s", 0),
            (6, "w " * 60, "en", "s", 120)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS score", "1 AS n_words")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rules.judge(docs, rules.fit(docs, str(tmp_path))).collect()
    assert len(got) == 6 and [r.kept for r in got] == [False] * 6 and all(r.base_failed for r in got)
    got = fm.classify(docs, fm.fit(docs, str(tmp_path))).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
    none = docs.limit(0)
    assert rules.judge(none, rules.fit(none, str(tmp_path))).count() == 0
    assert fm.keep_good(spark, none, str(tmp_path)).count() == 0
    assert fm.keep_good(spark, docs, str(tmp_path)).columns == docs.columns
