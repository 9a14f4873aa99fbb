"""Base spans against the plain patterns; the field against enumeration; added spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from recoflow.llm import pii as P
from recoflow.llm.common import documents
from tests.conftest import SF_SMALL

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]")


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return (kind == 0 or kind == 1 and all(int(x) <= 255 for x in s.split(".")) or kind == 2 and 13 <= len(d) <= 19 and P.luhn(d)
            or kind == 3 and 9 <= len(d) <= 15)


def plain(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m.group())]


def test_base_equals_patterns(spark):
    rng = random.Random(9)
    alphabet = ["1", "25", "0", ".", ".", "-", " ", "@", "a", "é", "+", "(", ")", "_", "%", "٣", "4111111111111111", "a@b.co", "1.2.3.4", "+1 555 123 4567"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [r.text for r in documents(spark, SF_SMALL).select("text").collect()] + ["", "1" * 9000, "a" * 9000 + "@", "+1" + " " * 9000]
    for t in texts:
        assert P.base_spans(t) == plain(t), t


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def segmentations(w, n):
    """All segmentations of n tokens: lists of segment numbers."""
    def go(t):
        if t == n:
            yield []
            return
        yield from go(t + 1)
        for k, (i, j, _) in enumerate(w.segments):
            if i == t:
                for rest in go(j):
                    yield [k, *rest]
    return list(go(0))


def test_field_equals_enumeration():
    rng = np.random.default_rng(4)
    w = P.window_at("x 555-123-4567 2 at b dot c", 2, 14)
    assert w.segments
    scores = rng.normal(size=(len(w.segments), 4))
    total, post, best = 0.0, np.zeros_like(scores), (0.0, [])
    for seg in segmentations(w, len(w.bounds) - 1):
        for kinds in itertools.product(range(4), repeat=len(seg)):
            v = sum(scores[k, c] for k, c in zip(seg, kinds))
            total += np.exp(v)
            for k, c in zip(seg, kinds):
                post[k, c] += np.exp(v)
            best = max(best, (v, list(zip(seg, kinds))))
    z, got = P.marginals(w, scores)
    assert abs(z - np.log(total)) < 1e-9 and np.allclose(got, post / total)
    want = [(c, w.bounds[w.segments[k][0]], w.bounds[w.segments[k][1]]) for k, c in best[1]]
    assert P.decode(w, scores, []) == want
    assert P.decode(w, scores, [(0, 40)]) == []


@pytest.fixture(scope="module")
def weights(spark):
    return P.fit(documents(spark, SF_SMALL.replace("0.001", "0.1")))


def found(text, weights):
    base = P.base_spans(text)
    return [(P.KINDS[k], text[s:e]) for k, s, e in P.added_spans(text, base, weights)]


def test_added_spans(weights):
    assert found("call me on 555-867-5309 today please", weights) == [("phone", "555-867-5309")]
    assert found("or (212) 555-0187, any time", weights) == [("phone", "(212) 555-0187")]
    assert found("write to jane.roe (at) example (dot) org now", weights) == [("email", "jane.roe (at) example (dot) org")]
    assert found("the number 4111.1111.1111.1111 was used", weights) == [("card", "4111.1111.1111.1111")]
    clean = ["born 2021-05-13 10:22:33 in town", "id 3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1 ok", "there were 1234567 of them", "version 1.22.333", "we met at noon dot",
             "4111111111111112 is not valid", "300.1.2.3 is no address", "a plain text without any"]
    for t in clean:
        assert found(t, weights) == [], t


def test_op_rows(spark, weights):
    rows = [(1, "mail a.b@c.org and +1 (136) 555-7479, 4111 1111 1111 1111"), (1, None), (None, ""), (4, "é 10.0.0.1 é " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    for w in (weights, None):
        got = P.find_pii(df, w).collect()
        assert len(got) == 4
        for r, (i, t) in zip(got, rows):
            base = plain(t or "")
            say = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base)
            assert r.doc_id == i and r.base_sha256 == hashlib.sha256(say.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in range(4)]
            assert {f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base} <= set(filter(None, r.spans.split(",")))
    assert P.fit(df.limit(0)) is None and P.find_pii(df.limit(0), None).count() == 0


def test_clean_documents_get_nothing(spark, weights):
    docs = documents(spark, SF_SMALL.replace("0.001", "0.01")).where("NOT text RLIKE '[0-9@]'")
    assert P.find_pii(docs, weights).where("spans <> ''").count() == 0
