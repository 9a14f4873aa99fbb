"""Numbers beside base spans and long runs of numbers."""

import numpy as np
import pytest

from recoflow.llm import pii as P
from recoflow.llm.common import documents
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def weights(spark):
    return P.fit(documents(spark, SF_SMALL.replace("0.001", "0.1")))


def found(text, weights):
    return [(P.KINDS[k], text[s:e]) for k, s, e in P.added_spans(text, P.base_spans(text), weights)]


def test_number_beside_a_base_span(weights):
    assert found("Card 4111 1111 1111 1111 (212) 555-0187", weights) == [("phone", "(212) 555-0187")]
    assert found("host 10.0.0.12 (212) 555-0187", weights) == [("phone", "(212) 555-0187")]
    assert found("host 10.0.0.12 (212) 555-0187 (10.0.0.13) 212-555-0188 end", weights) == [("phone", "(212) 555-0187"), ("phone", "212-555-0188")]


@pytest.mark.parametrize("n", [40, 400])
def test_directory_line(weights, n):
    numbers = [f"(212) 555-{k:04}" for k in range(n)]
    assert found(" ".join(numbers), weights) == [("phone", x) for x in numbers]


def test_candidates_in_steps_equal_the_whole_window(monkeypatch):
    rng = np.random.default_rng(8)
    text = "x " + " ".join(f"{rng.integers(200, 999)}-{rng.integers(200, 999)}-{rng.integers(1000, 9999)}" for _ in range(30)) + " jo at b dot c end"
    weights = rng.normal(size=(4, len(P._NAMES)))
    taken = [(30, 41)]
    w = P.window_at(text, 2, len(text) - 4)
    want = P.decode(w, P._scores(w, weights), taken)
    assert want
    for step in (1, 7, 512):
        monkeypatch.setattr(P, "STEP", step)
        assert P.decode_at(text, 2, len(text) - 4, weights, *P._merged(taken), 0) == want
