"""Propositions that several questions of a set share, against brute force."""

import random
from collections import defaultdict

import pytest

from lectern.operators import bank, quality


def brute(items, uses):
    props, found = defaultdict(set), defaultdict(set)
    for q, p in uses:
        if p is not None:
            props[q].add(p)
    for s, q in items:
        for p in props[q]:
            found[s, p].add(q)
    return sorted(((s, p, len(qs), ",".join(map(str, sorted(qs)))) for (s, p), qs in found.items() if len(qs) > 1), key=str)


def drawn(seed):
    r = random.Random(seed)
    items = [(s, r.randrange(40)) for s in range(60) for _ in range(r.randrange(6))] + [(7, q) for q in range(40)] * 3 + [(None, 1), (None, 2), (99, None)]
    uses = [(r.randrange(40), r.choice([None, *range(-30, 30)])) for _ in range(300)] + [(3, p) for p in range(500)] + [(5, p) for p in range(200, 900)]
    return items, uses


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("limits", [{}, {"LEAST": 500, "EACH": 1}, {"TOGETHER": 10, "CHUNK": 7}])
def test_duplicates_like_brute_force(spark, monkeypatch, limits, kind):
    for k, x in limits.items():
        monkeypatch.setattr(bank, k, x)
    items, uses = drawn(1)
    typed = (lambda rows: [tuple(x if x is None else str(x) for x in r) for r in rows]) if kind == "string" else list
    i = spark.createDataFrame(typed(items), f"set_id {kind}, question_id {kind}")
    u = spark.createDataFrame(typed(uses), f"question_id {kind}, proposition_id {kind}")
    got = sorted((tuple(r) for r in bank.duplicate_usage(i, u).select("set_id", "proposition_id", "n", "questions").collect()), key=str)
    assert got == brute(typed(items), typed(uses))
    few = quality.set_duplicates(i, u, 2).groupBy("set_id").count().collect()
    assert {r["set_id"] for r in few} == {g[0] for g in got} and max(r["count"] for r in few) == 2


def test_slices_bound_what_is_shuffled(spark, monkeypatch):
    """Each slice is written by itself, and nothing joins rows of single propositions."""
    monkeypatch.setattr(bank, "LEAST", 500)
    made = []
    real = bank.written
    monkeypatch.setattr(bank, "written", lambda df, name: (made.append(name), real(df, name))[1])
    i, u = (spark.createDataFrame(rows, schema) for rows, schema in zip(drawn(2), ("set_id long, question_id long", "question_id long, proposition_id long")))
    assert bank.duplicate_usage(i, u).count() == len(brute(*drawn(2)))
    assert made.count("duplicates") > 5


def test_no_items(spark):
    i, u = spark.createDataFrame([], "set_id long, question_id long"), spark.createDataFrame([(1, 2)], "question_id long, proposition_id long")
    assert bank.duplicate_usage(i, u).collect() == []
