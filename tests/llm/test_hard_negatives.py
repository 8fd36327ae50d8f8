"""Hard negatives against brute force over all pairs, with odd rows, ties and long and short vectors, and against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from lectern.llm import hard_negatives as hn
from lectern.llm import queries_text
from tests.llm.helpers import stored

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def brute(rows):
    """Result rows without places; ties among equal ids give equal rows."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        kept.append((i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m == label) for b, (j, w, m) in enumerate(kept) if b != a and len(w) == len(v)]
        for p, j, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            for rank, (s, k, _) in enumerate(sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=key)[:10], 1):
                out.append((i, j, rank, k, p, s))
    return sorted(map(str, out))


def vectors(seed, n, width, spread):
    """Clustered vectors of many lengths, so that bounds have something to leave out; coarse, so that scores tie."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c, size = rng.choice(centres), 2 ** rng.uniform(-3, 3)
        rows.append((i * 4, [round(size * (x + rng.gauss(0, spread)), 1) for x in c], rng.randrange(4)))
    return rows


ODD = [
    (5, None, 1), (200, [1.0, 2.0, 0.5], None), (300, [1.0, None, 2.0], 1), (400, [1.0, NAN, 2.0], 1), (500, [1.0, INF, 2.0], 2), (None, [0.5, 1.0, 1.5], 1), (None, [0.5, 1.0, 1.5], 2),
    (600, [0.0, 0.0, 0.0], 1), (700, [1.0, 1.0], 1), (701, [1.0, 0.9], 1), (702, [1.0, 0.5], 2), (800, [], 1), (801, [], 1), (802, [], 2), (900, [1.0, 1.0, 1.0], 1), (900, [1.0, 1.0, 1.0], 1),
    (901, [0.7, 0.7, 0.7], 2), (901, [0.7, 0.7, 0.7], 2), (902, [0.7, 0.7, 0.7], 3), (1000, [-1.0, -1.0, 0.0], 5), (1001, [1.0, 1.0, 0.0], 5),
]


@pytest.mark.parametrize("small", [False, True])
def test_like_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of rows and of anchors
        monkeypatch.setattr(hn, "ROWS", 7)
        monkeypatch.setattr(hn, "ANCHORS", 3)
    rows = vectors(1, 300, 3, 0.3) + vectors(2, 40, 5, 1) + ODD
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS norm", "3 AS rank")
    got = hn.hard_negatives(d).drop("anchor_row", "positive_row", "negative_row").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows) and len(got) > 500


def test_bounds_leave_out_only_what_cannot_be_found():
    rng = np.random.default_rng(3)
    fewer = 0
    for width in (1, 2, 8, 30):
        v = rng.integers(-40, 40, (500, width)) + 60 * np.sign(rng.normal(size=(500, 1))).astype(np.int64)
        none = np.zeros(500, bool)
        block = hn.Block(np.arange(500), none, np.arange(500), none.astype(int), v.astype(np.int64), np.sqrt((v * v).sum(axis=1)))
        for a in v[:40]:
            unit = a / np.linalg.norm(a)
            for cosine in (0.2, 0.7, 0.95, 0.999):
                places = block.candidates(unit, cosine)
                real = np.flatnonzero(block.units @ unit >= cosine)
                assert places is None or set(real) <= set(places.tolist())
                fewer += places is not None and len(places) < 250
    assert fewer > 200


def test_large_components_are_bounded(spark):
    rows = [(100, [3e38, 1.0], 1), (101, [3e38, 2.0], 1), (102, [1.0, 0.0], 2), (103, [-3e38, 3e38], 2), (104, [1e6, 1e6], 2)]
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    bound = math.floor(2**31 / math.sqrt(2))
    assert {r.positive_score for r in got} <= {bound * bound + 256 * 512} and len(got) == len({r.negative_id for r in got})


def test_nothing_and_sql(spark, tmp_path):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, v, label) for i, (_, v, label) in enumerate(vectors(4, 500, 6, 0.5))] + [r for r in ODD[:5]]
    stored(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), "embeddings")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries_text.op11_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(str, c.sql(hn.ORACLE_HARD).fetchall())) == sorted(str(tuple(r)) for r in got)
