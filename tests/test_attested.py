"""Phrases against brute force, few and many, in one block and in several; whole items like SQL."""

import random

import duckdb
import pytest

from lectern.operators import search
from lectern.plans import ORACLES, QUERIES
from tests.test_entry import FOLDER
from tests.test_operators import rows

PHRASES = [(1, "fox"), (2, ""), (3, "quick brown fox"), (4, "absent phrase"), (5, "zzz"), (6, "12345678"), (7, "x"), (8, None), (9, "fox")]
CORPUS = [(1, "a quick brown fox"), (1, "a quick brown fox"), (2, "fox"), (3, None), (4, ""), (5, "0123456789"), (6, "x")]
WANT = [(1, 2, "1,2"), (2, 5, "1,2,4,5,6"), (3, 1, "1"), (4, 0, ""), (5, 0, ""), (6, 1, "5"), (7, 3, "1,2,6"), (8, 0, ""), (9, 2, "1,2")]


@pytest.mark.parametrize("letters", [1 << 22, 10])
def test_odd_phrases(spark, monkeypatch, letters):
    monkeypatch.setattr(search, "LETTERS", letters)
    phrases, corpus = spark.createDataFrame(PHRASES, "phrase_id int, phrase string"), spark.createDataFrame(CORPUS, "doc_id long, text string")
    assert rows(search.attested(phrases, corpus)) == WANT
    assert rows(search.attested(phrases.limit(0), corpus)) == []
    assert {r.documents for r in search.attested(phrases, corpus.limit(0)).collect()} == {0}


@pytest.mark.parametrize("many", [3, 3000])
def test_like_brute_force(spark, many):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randrange(400))) for _ in range(120)]
    phrases = []
    for i in range(many):  # half are cut from a text
        size, text = rng.randint(1, 60), rng.choice(texts)
        at = rng.randrange(max(1, len(text) - size))
        phrases.append((i, text[at : at + size] if i % 2 else "".join(rng.choice("abc d") for _ in range(size))))
    got = search.attested(spark.createDataFrame(phrases, "phrase_id long, phrase string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = []
    for i, p in phrases:
        found = [k for k, t in enumerate(texts) if p in t]
        want.append((i, len(found), ",".join(map(str, found[:5]))))
    assert rows(got) == sorted(want, key=str)


def test_whole_items_like_sql(spark):
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name in ("attested", "attested_whole"):
        assert rows(QUERIES[name](spark, FOLDER)) == sorted(c.execute(ORACLES[name]).fetchall(), key=str)
