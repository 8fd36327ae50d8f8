"""Components of similar n-gram sets against brute force over all pairs; signatures never miss a similar pair."""

import random

import numpy as np
import pytest

from lectern.llm import partenum as pe
from tests.llm.helpers import ROWS, docs, empty
from tests.llm.test_near_copies import edited


def shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def brute(rows):
    sets, label = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    return sorted(str((r[0], len(s), least.get(label[i]))) for i, (r, s) in enumerate(zip(rows, sets)))


def mixed_rows(seed, groups=25):
    """Texts of many lengths with copies of one to many edited words, chains of copies, and passages that many share."""
    rng, texts = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for k in range(groups):
        size = rng.choice([3, 6, 8, 12, 20, 40, 90, 200, 600])
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        texts.append(base)
        texts += [edited(rng, base, e) for e in range(0, max(2, size // 30), max(1, size // 150)) for _ in range(2)]
        texts.append([*passage, *(f"x{rng.randrange(10**6)}" for _ in range(k))])
        texts += [base[: size - c] for c in (1, 2, size // 12)]
    for _ in range(15):
        texts.append(edited(rng, texts[-1], 2))
    texts += [["a"] * n for n in (1, 2, 5, 9)]
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_like_brute_force(spark, monkeypatch, small):
    if small:  # many batches and ranges
        monkeypatch.setattr(pe, "BATCH", 500)
        monkeypatch.setattr(pe, "RANGE", 2000)
        monkeypatch.setattr(pe, "BLOCK", 3)
        monkeypatch.setattr(pe, "SEEN", 5)
        monkeypatch.setattr(pe, "LEADERS", 1)
    rows = mixed_rows(1) + [(1000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(ROWS)]
    d = docs(spark, rows).selectExpr("*", "1 AS node", "2 AS digest", "3 AS n")
    got = sorted(str(tuple(r)) for r in pe.similar_sets(d).collect())
    assert got == brute(rows)
    assert len({x.rsplit(",", 1)[1] for x in got}) < len(rows) - 60


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    met, far = 0, 0
    for size in [*range(1, 40), 60, 100, 250, 700, 2000]:
        for wanted in (2.0, 6.5, 12.0):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                most = pe.most_apart(2 * len(a))
                gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                keys, places = pe.signatures([a, b], wanted)
                share = bool(set(keys[places == 0]) & set(keys[places == 1]))
                if len(b) and 100 * shared >= 85 * (len(a) + len(b) - shared):
                    met += 1
                    assert share, (size, gone, new)
                if size > 80:
                    c = np.unique(np.concatenate([a[len(a) // 2 :], rng.integers(0, 2**63, size // 2).astype(np.uint64)]))
                    keys, places = pe.signatures([a, c], 12.0)
                    far += not set(keys[places == 0]) & set(keys[places == 1])
    assert met > 300 and far > 60


def test_parity_never_exceeds_the_differences():
    rng = np.random.default_rng(6)
    for n in (0, 1, 50, 3000):
        a, b = (np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for _ in "ab")
        b = np.union1d(a[: n // 2], b)
        assert int(np.bitwise_count(pe.parity(a) ^ pe.parity(b)).sum()) <= len(np.setxor1d(a, b))


def test_odd_tables(spark):
    assert pe.similar_sets(empty(spark)).count() == 0
    rows = [(None, None, "a", "s", None)] * 3 + [(None, "one two three four five", "a", "s", None)] * 2
    got = sorted(str(tuple(r)) for r in pe.similar_sets(docs(spark, rows)).collect())
    assert got == brute(rows)
