"""The nearest signature against all pairs, and how many pairs pivots leave."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import layout, nearest

SCHEMA = "{} int, sig array<float>, label int"


def clusters(seed, n, width=6):
    rng = random.Random(seed)
    centres = [[rng.random() * 9 for _ in range(width)] for _ in range(12)]
    return [(i, [float(np.float32(round(x + rng.random() / 4, 2))) for x in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("block", [7, 2048])
def test_like_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "STRIP", 5)
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (903, [1.0] * 3, 1), (904, [1.0] * 6, None), (905, [1.0] * 6, 77)]
    assets, observed = clusters(1, 80) + odd, clusters(2, 200) + odd[:5] + [(950, [5.0] * 6, 1), (951, [5.0] * 6, 1)]
    observed += [(1000 + i, s, g) for i, s, g in observed[:20]]  # ties
    got = layout.signature_match(spark.createDataFrame(assets, SCHEMA.format("asset_id")), spark.createDataFrame(observed, SCHEMA.format("observed_id")), ["label"], 0.95)
    want, whole = {}, lambda s: s and None not in s
    for a, s, g in assets:
        own = [(-round(1 - sum(abs(x - y) for x, y in zip(s, t)) / len(s), 6), o) for o, t, h in observed if g is not None and g == h and whole(s) and whole(t) and len(s) == len(t)]
        if own:
            want[a] = (min(own)[1], -min(own)[0], -min(own)[0] >= 0.95)
    assert {r.asset_id: (r.observed_id, r.score, r.matched) for r in got.collect()} == want and len(want) == 81


def test_pivots_leave_out_most_of_clustered_signatures(monkeypatch):
    rows = [np.array(s) for _, s, _ in clusters(3, 600)]
    sig, others = np.stack(rows[:200]), np.stack(rows[200:])
    far = lambda x, p: np.abs(x[:, None, :] - p[None]).mean(axis=2)
    pivots = others[[3, 50, 170, 260]]
    d = far(sig, pivots)
    open_ = (np.abs(d[:, None, :] - far(others, pivots)[None]) <= (d.min(axis=1) + nearest.SLACK)[:, None, None]).all(axis=2)
    assert open_.mean() < 0.6
    ids = pa.array(range(200)), pa.array(range(400))
    got = {}
    for batch in nearest.compared(sig, d, d.min(axis=1) + nearest.SLACK, ids[0], others, far(others, pivots), ids[1]):
        for a, o, x in zip(*(c.to_pylist() for c in batch.columns)):
            got[a] = min(got.get(a, (9, 9)), (x, o))
    full = far(sig, others)
    assert all(np.isclose(got[a][0], full[a].min()) for a in range(200))
