"""ALS top-k: blocks of users meet parts of items; nothing is asked of MLlib but the factors."""

from types import SimpleNamespace

import numpy as np
import pytest

from recoflow.operators import factors as fa


@pytest.mark.parametrize("sizes", [(1 << 10, 1 << 12, 1 << 17, 1 << 18), (4, 7, 9, 13)])
def test_k_best_unseen_items_of_every_user(spark, monkeypatch, sizes):
    for name, n in zip(("STEP_USERS", "STEP_ITEMS", "GRID_USERS", "GRID_ITEMS"), sizes):
        monkeypatch.setattr(fa, name, n)
    draw = np.random.default_rng(3)
    n_users, n_items, k = 23, 41, 6
    u = np.round(draw.normal(size=(n_users, 2)), 1)
    v = np.round(draw.normal(size=(n_items, 2)), 1)
    v[5] = v[17]  # a tie goes to the smaller id
    u[4] = 0.0  # all items tie
    seen = {(0, i) for i in range(n_items - 3)} | {(a, b) for a in range(1, n_users) for b in draw.choice(n_items, 8).tolist()}
    factors = lambda m: spark.createDataFrame([(j, [float(x) for x in r]) for j, r in enumerate(m)], "id int, features array<float>")
    number = lambda n, names: spark.createDataFrame([(10 * j, j) for j in range(n)], names)
    fit = fa.AlsFit(SimpleNamespace(userFactors=factors(u), itemFactors=factors(v)), number(n_users, "user_id long, _u long"), number(n_items, "item_id long, _i long"))
    train = spark.createDataFrame([(10 * a, 10 * b) for a, b in sorted(seen)] * 2 + [(None, 10), (10, None)], "user_id long, item_id long")
    got: dict[int, list] = {}
    for r in fa.als_recommend(fit, train, k).collect():
        got.setdefault(r["user_id"] // 10, []).append((r["prediction"], r["item_id"] // 10))
    s = (u.astype(np.float32)[:, None, 0] * v.astype(np.float32)[None, :, 0]) + (u.astype(np.float32)[:, None, 1] * v.astype(np.float32)[None, :, 1])
    for a in range(n_users):
        want = sorted(((float(s[a, b]), b) for b in range(n_items) if (a, b) not in seen), key=lambda x: (-x[0], x[1]))[:k]
        assert sorted(got[a], key=lambda x: (-x[0], x[1])) == want
    assert len(got[0]) == 3


def test_few_parts_and_few_exchanges_at_a_time(spark, monkeypatch):
    """Every part of the items returns k rows a user: with 28 parts of 7.2 million items these outweighed the rest."""
    assert -(-7_200_000 // fa.GRID_ITEMS) <= 8
    asked = {}
    monkeypatch.setattr(fa.ALS, "fit", lambda self, data: asked.setdefault("interval", self.getCheckpointInterval()))
    train = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], "user_id long, item_id long, rating double")
    fa.als_fit(train)
    assert 0 < asked["interval"] <= 2
