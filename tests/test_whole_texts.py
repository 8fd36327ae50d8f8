"""Queries read whole texts."""

import time

from lectern.operators import layout
from lectern.plans import layout_queries
from lectern.plans.views import Views
from tests.test_operators import rows


def test_highlights_in_every_line(spark, tmp_path):
    texts = [(1, "The end\nof a nation\n\nother", ), (2, "none\nstation",), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(layout_queries.highlight_boxes(Views(spark, str(tmp_path))).select("doc_id", "line", "term", "at"))
    assert got == [(1, 0, "the", 1), (1, 1, "ation", 5), (1, 3, "the", 2), (2, 1, "ation", 3)]


def test_highlights_of_even_characters(spark, monkeypatch):
    """Hits overlap, blanks lie within them, lines are apart, capitals keep their places, and a long line takes no longer than short ones."""
    monkeypatch.setattr(layout, "LETTERS", 40)
    lines = [(1, "A a aAx"), (1, "a"), (2, "İ Σa ab"), (3, None), (4, ""), (5, "  "), (6, "xaé \U0001f600 ab"), (7, "ba" * 200)]
    d = spark.createDataFrame(lines, "k long, body string")
    got = rows(layout.highlight_texts(d, ["k"], ["aa", "AB", "σa", "😀a"], 2.0))
    want = [
        (k, t, p + 1, at[p] * 2.0, at[p + len(t) - 1] * 2.0 + 2.0)
        for k, body in lines for at in [[i for i, c in enumerate(body or "") if c != " "]] for low in ["".join(c.lower()[0] for c in body or "" if c != " ")]
        for t in ("aa", "AB", "σa", "😀a") for p in range(len(low)) if low[p : p + len(t)] == t.lower()
    ]
    assert got == sorted(want, key=str) and len(want) > 200


def test_a_long_line_takes_time_in_proportion(spark, tmp_path):
    spark.createDataFrame([(1, "the nation " * 60_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    assert layout_queries.highlight_boxes(Views(spark, str(tmp_path))).count() == 120_000
    assert time.time() - began < 60
