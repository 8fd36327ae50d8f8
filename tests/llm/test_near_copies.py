"""Near copies of five-word shingles against brute force over all pairs, and what stays of odd tables."""

import random

import numpy as np
import pytest
import xxhash

from lectern import scratch
from lectern.llm import simhash
from tests.llm.helpers import ROWS, docs, empty, stored

MASK = (1 << 64) - 1


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_print(text):
    """The wide fingerprint as one integer, bit by bit."""
    bits, hashes = 0, [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingle_set(text)]
    for k in range(simhash.WIDE):
        own = []
        for h in hashes:
            h = (h + (k + 1) * 0x9E3779B97F4A7C15) & MASK
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
            own.append(h ^ (h >> 31))
        bits |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) << 64 * k
    return bits


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_ids(rows):
    """The smallest id of each component, by brute force."""
    sets, prints, label = [shingle_set(r[1]) for r in rows], [slow_print(r[1]) for r in rows], list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j]) and (prints[i] ^ prints[j]).bit_count() <= simhash.WIDE_RADIUS]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            least = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = least
    order = {i: min((r[0] for k, r in enumerate(rows) if label[k] == i)) for i in set(label)}
    return sorted(order.values())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def near_rows():
    """Texts of 150 words, copies of them with 1 to 9 edited words, chains of copies, and one passage in many texts."""
    rng, texts = random.Random(5), []
    passage = [f"p{i}" for i in range(100)]
    for k in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        texts.append(base)
        texts += [edited(rng, base, e) for e in (1, 3, 5, 6, 7, 9)]
        texts.append([*passage, *(f"x{rng.randrange(10**6)}" for _ in range(5 + k * 4))])
    texts += [edited(rng, texts[0], 2) for _ in range(40)]
    for _ in range(8):
        texts.append(edited(rng, texts[-1], 4))
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)]


def test_wide_prints():
    for text in ("", "one", "a b c d e f", near_rows()[0][1]):
        got = simhash.wide_print(simhash.shingle_set(text))
        assert sum(int(w) << 64 * k for k, w in enumerate(got)) == slow_print(text)


@pytest.mark.parametrize("small", [False, True])
def test_one_of_near_copies_stays(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks of fingerprints, and of candidates' sets
        monkeypatch.setattr(simhash, "BLOCK", 7)
        monkeypatch.setattr(simhash, "STRIP", 3)
        monkeypatch.setattr(simhash, "SHINGLES_A_BLOCK", 1000)
    rows = near_rows()
    got = simhash.without_near_copies(stored(spark, tmp_path, docs(spark, rows)))
    want = kept_ids(rows)
    assert len(want) < len(rows) - 50
    assert sorted(r.doc_id for r in got.collect()) == want


def test_recall_of_links():
    """Of pairs with a similarity of 0.8 and more, how many have fingerprints near enough."""
    rng, near, far = random.Random(9), [], []
    for size in (40, 100, 150, 400):
        for edits in range(1, size // 25):
            for _ in range(20):
                a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
                x, y = " ".join(a), " ".join(edited(rng, a, edits))
                apart = int(np.bitwise_count(simhash.wide_print(simhash.shingle_set(x)) ^ simhash.wide_print(simhash.shingle_set(y))).sum())
                (near if similar(shingle_set(x), shingle_set(y)) else far).append(apart <= simhash.WIDE_RADIUS)
    assert len(near) > 200 and np.mean(near) > 0.99


def test_odd_rows(spark, tmp_path):
    rows = [(3, None, "a", "s", None), (1, " \n", "b", "s", None), (None, "One two", "c", "s", None), (7, "one  two", "d", "s", None), (8, "one", "e", "s", None)]
    got = simhash.without_near_copies(stored(spark, tmp_path, docs(spark, rows)))
    assert sorted(r.lang for r in got.collect()) == ["b", "d", "e"]
    assert simhash.without_near_copies(stored(spark, tmp_path, empty(spark), "none")).count() == 0


def test_clashing_names(spark, tmp_path):
    extra = "*", "1 AS row", "2 AS Row_", "3 AS fp", "4 AS w0", "5 AS root", "6 AS source_text"
    d = stored(spark, tmp_path, docs(spark).selectExpr(*extra))
    got = simhash.without_near_copies(d)
    assert got.columns == d.columns
    assert {(r.row, r["Row_"], r.fp, r.root) for r in got.collect()} == {(1, 2, 3, 5)}
    assert len(simhash.near_components(d).collect()) == len(ROWS)


def test_tables_are_deleted_when_done(spark, tmp_path):
    d = stored(spark, tmp_path, docs(spark))
    kept = scratch.written(d, "example")
    folder = kept._lectern_path.removesuffix("/rows")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(place) and kept.count() == len(ROWS)
    scratch.forget(kept)
    assert not files.exists(place)
