"""The tagger's gradient against differences, its learning, and the queries over whole turns."""

from __future__ import annotations

import numpy as np

import __spark_entry__
from spanloom.operators.tagger import TAGS, Tagger, train

SMALL = "/root/testdata/sf0.001"


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    f, v, y = rng.normal(size=(2, 5, 3)), rng.normal(size=(2, 5, 4)), rng.integers(0, len(TAGS), (2, 5))
    m = Tagger(3, 4, channels=4, units=3)
    grad, _, _ = m.gradient(f, v, y)
    assert grad.keys() == m.w.keys()
    for k, g in grad.items():
        for at in {tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)}:
            was, sides = m.w[k][at], []
            for e in (1e-5, -1e-5):
                m.w[k][at] = was + e
                sides.append(m.gradient(f, v, y)[1])
            m.w[k][at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-6, k


def test_training_learns_a_tag_of_the_neighbour():
    rng = np.random.default_rng(2)
    rows = []
    for n in rng.integers(1, 9, 80):
        f = rng.integers(0, 2, (n, 2)).astype(float)
        rows.append((f, np.zeros((n, 1)), np.concatenate(([0], f[:-1, 0])).astype(int)))
    for batch in (None, 4):
        m = Tagger(2, 1)
        history = train(m, rows, 30, batch)
        assert history[-1][2] > 0.95 and history[-1][1] < history[0][1]
    assert m.tags([np.zeros((0, 2))], [np.zeros((0, 1))]) == [""]


def test_queries_tag_every_token_of_every_turn(spark):
    q = __spark_entry__.queries()
    want = {r.turn_id: len(r.tags) for r in q["lab_1"](spark, SMALL).collect()}
    for name in ("ml_6", "ml_7"):
        got = {r.turn_id: r.tags for r in q[name](spark, SMALL).collect()}
        assert {k: len(t) for k, t in got.items()} == want and set("".join(got.values())) <= set(TAGS)
    history = q["ml_8"](spark, SMALL).collect()
    assert sorted((r.model, r.epoch) for r in history) == [("a", e) for e in range(30)] + [("b", e) for e in range(10)]
