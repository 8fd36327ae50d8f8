"""Contracts of panels, choices and blocks, spread of answers, lint, envelopes, orders of panels and reports, by literal tables."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import bank, layout, quality
from lectern.sources import corpus

PANEL = "item_id long, owner_id long, idx int, asset_count int, arrangement string, x0 double, y0 double, x1 double, y1 double, width_px int, height_px int, caption string, caption_y0 double, recorded string, observed string"


def panel(at, **kw):
    base = {"item_id": 1, "owner_id": 1, "idx": at, "asset_count": 3, "arrangement": "row", "x0": at * 20.0, "y0": 0.0, "x1": at * 20.0 + 10, "y1": 10.0, "width_px": 40, "height_px": 40, "caption": "ABC"[at - 1], "caption_y0": 11.0, "recorded": "a", "observed": "a"}
    return tuple((base | kw).values())


@pytest.mark.parametrize("change,codes", [
    ({}, []), ({"idx": 4}, ["panel_caption_place", "panel_captions", "panel_index"]), ({"idx": None}, ["panel_caption_place", "panel_captions", "panel_index"]), ({"asset_count": 2}, ["panel_assets"]),
    ({"asset_count": None}, ["panel_assets"]), ({"owner_id": None}, ["panel_owner"]), ({"arrangement": "column"}, ["panel_arrangement"]), ({"x1": 60.0}, ["panel_box", "panel_ratio"]), ({"height_px": 44}, ["panel_ratio"]),
    ({"height_px": 0}, ["panel_ratio"]), ({"observed": None}, ["panel_digest"]), ({"caption": "(다)"}, ["panel_captions"]), ({"caption": " C "}, []), ({"caption_y0": 9.0}, ["panel_caption_place"]),
    ({"caption_y0": None}, ["panel_caption_place"]), ({"x0": 45.0, "x1": 55.0}, ["panel_overlap"]), ({"x0": 50.0, "x1": 60.0}, []),
])
def test_panels(spark, change, codes):
    d = spark.createDataFrame([panel(1), panel(2), panel(3, **change)], PANEL)
    assert sorted(r.code for r in quality.panel_contract(d).collect()) == codes


def test_two_panels_and_none(spark):
    d = spark.createDataFrame([panel(1, asset_count=2, caption=None), panel(2, asset_count=2, caption="x", caption_y0=None)], PANEL)
    assert quality.panel_contract(d).count() == 0 and quality.panel_contract(d.limit(0)).count() == 0


def test_graphical_choices(spark):
    schema = "item_id long, owner_id long, ord int, needs_review boolean, reason string, recorded string, observed string"
    rows = [(1, 1, k, False, None, "a", "a") for k in range(1, 6)] + [(2, 2, k, k > 3, "blurred" if k == 4 else " ", "a", "a") for k in range(1, 6)]
    rows += [(3, 3, k, k > 3, "cut" if k > 4 else "blurred", "a", "b" if k == 1 else "a") for k in range(1, 6)] + [(4, 4 if k else 5, 1, None, None, "a", None) for k in range(5)] + [(5, 5, 1, False, "", "a", "a")]
    got = sorted(tuple(r) for r in quality.graphical_choice_contract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, "choice_review", "error", "blurred"), (3, "choice_digest", "error", ""), (3, "choice_review", "error", "blurred; cut"), (4, "choice_digest", "error", ""), (4, "choice_order", "error", ""), (4, "choice_owner", "error", ""),
                   (5, "choice_count", "error", ""), (5, "choice_order", "error", "")]


def test_blocks(spark):
    schema = "doc_id long, kind string, text string, page_no int, expected_pages int"
    rows = [(1, "text", "⑤ end", 1, 2), (1, "table", "< 보\n기 > ㄱ ㄴ ㄷ", 2, 2), (2, "image", None, 1, 2), (3, "text", " ", 1, None), (4, "table", "<보기> ㄱ ㄴ", 1, 1), (4, "text", "ㄷ end", 1, 1)]
    d = spark.createDataFrame(rows, schema)
    got = {k: sorted(x.code for x in g) for k, g in itertools.groupby(sorted(quality.block_contract(d, ["end"], True, True, True).collect()), lambda r: r.doc_id)}
    rest = ["claims_missing", "fifth_choice", "no_box", "no_text"]
    assert got == {2: sorted([*rest, "images_only", "page_count", "required_0"]), 3: sorted([*rest, "required_0"]), 4: ["fifth_choice", "no_box"]}
    assert sorted(r.code for r in quality.block_contract(d, [], box=True).where("doc_id = 4").collect()) == []


def spread(spark, answers, widths=(5,)):
    """Issues of a set whose questions have an answer at the given places (None: no single one)."""
    items = [(1, q, q, q) for q in range(len(answers))]
    choices = [(q, o, o == a) for q, a in enumerate(answers) for o in range(1, widths[q % len(widths)] + 1)]
    d = quality.answer_spread(spark.createDataFrame(items, "set_id long, question_id long, ord long, item_id long"), spark.createDataFrame(choices, "question_id long, ord long, is_answer boolean"))
    return sorted((r.code, r.detail) for r in d.collect())


@pytest.mark.parametrize("answers,widths,want", [
    ((1, 2, 3, 4, 5), (5,), []), ((1, 2, 3, 4), (4,), []), ((1, 1, 1, 2, 3), (3,), [("answer_bias", "1: 3/5")]), ((1, 1, 2, 2, 3), (3,), []), ((3, 3, 3, 1, 1, 1), (3,), [("answer_bias", "3: 3/6"), ("answer_unused", "2")]),
    ((1, 2, 1, None, None), (5,), []), ((2, 4, 2, 4, 2, 4, None), (4,), [("answer_bias", "2: 3/6"), ("answer_unused", "1 3")]), ((1, 1, 1, 1, 1), (1,), []), ((), (1,), []), ((1, 2, 3, 1, 2), (3, 4), [("answer_unused", "4")]),
])
def test_spread_of_answers(spark, answers, widths, want):
    assert spread(spark, answers, widths) == want


@pytest.mark.parametrize("text,markup,choices,pictures,want", [
    ("x", "\\수능원문1대사진\\ x", 5, 0, "picture of the whole item"), (None, None, 5, 0, "empty text"), ("x", None, 4, None, "not five choices"), ("x", None, 4, 5, None), ("x", "[26023-1234]", 5, 0, "source id"),
    ("x", ";3!;", 5, 0, "fraction code"), ("x`", "", 5, 0, "backtick"), ("é", "", 5, 0, "private or control character"), ("5° ±1 ×2 ·\t\n", "", 5, 0, None), ("[[formula:{]]", "", 5, 0, "formula: braces"), ("x", "[[formula:{]]", 5, 0, None),
])
def test_text_lint(spark, text, markup, choices, pictures, want):
    d = spark.createDataFrame([(text, markup, choices, pictures)], "t string, m string, c int, p int")
    assert d.select(quality.text_lint(F.col("t"), F.col("m"), F.col("c"), F.col("p"))).first()[0] == want


@pytest.mark.parametrize("text,meta,want", [
    ('{"text":"a","frame_id":"F"}', None, ("a", {"t": {"frame_id": "F", "sources": []}}, True)), ('{"text":"a","frame_id":"F","style_sources":[],"sources":[{"x":1}]}', "{}", ("a", {"t": {"frame_id": "F", "sources": [{"x": 1}]}}, True)),
    ('{"frame_id":"F","style_sources":["s"],"sources":[1]}', '{"ask":{"k":[1,"2"]},"t":1}', ("", {"ask": {"k": [1, "2"]}, "t": {"frame_id": "F", "sources": ["s"]}}, True)), ('{"text":"a"}', '{"k":1}', ("a", {"k": 1}, True)),
    (" [object Object] ", None, ("", None, True)), ("{a}", None, ("{a}", None, False)), (None, None, (None, None, False)), ("plain", '{"k":1}', ("plain", {"k": 1}, False)),
])
def test_envelopes(spark, text, meta, want):
    r = bank.unwrap_text_envelope(spark.createDataFrame([(text, meta)], "t string, m string"), "t", "m").first()
    assert (r.t, r.m and json.loads(r.m), r.changed) == want


LEFT, RIGHT, TALL = [(0, 0, 10, 10), (0, 20, 10, 30)], [(20, 0, 30, 10), (20, 20, 30, 30)], (20, 5, 30, 25)


@pytest.mark.parametrize("boxes,order", [
    ([*LEFT, TALL], [0, 1, 2]), ([TALL, *LEFT], [1, 2, 0]), ([(0, 5, 10, 25), *reversed(RIGHT)], [0, 2, 1]), ([(5, 20, 25, 30), (0, 0, 10, 10), (20, 0, 30, 10)], [1, 2, 0]), ([(5, 0, 25, 10), (20, 20, 30, 30), (0, 20, 10, 30)], [0, 2, 1]),
    ([(20, 0, 30, 10), (0, 5, 10, 15), (40, 5, 50, 15), (40, 0, 45, 4)], [0, 3, 1, 2]), ([(9, 9, 10, 10), (0, 0, 1, 1), (4, 4, 5, 5)], [1, 2, 0]),
])
def test_order_of_panels(spark, boxes, order):
    d = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(boxes)], "page long, box_id long, x0 double, y0 double, x1 double, y1 double")
    got = layout.reading_order(d, ["page"], F.lit(False), F.lit(True))
    assert got.columns == [*d.columns, "place"] and [r.box_id for r in got.orderBy("place").collect()] == order


def test_report_in_markdown(spark, tmp_path):
    d = spark.createDataFrame([("b|c", 2), (None, 1), ("a\nb", 10)], "name string, n long")
    corpus.publish_report(d, str(tmp_path / "r"), ["n"], "md")
    lines = [line for f in sorted((tmp_path / "r").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["| name | n |", "| --- | --- |", "|  | 1 |", "| b\\|c | 2 |", "| a b | 10 |"]
    corpus.publish_report(d.limit(0), str(tmp_path / "r"), ["n"], "md")
    assert spark.read.text(str(tmp_path / "r")).count() == 2
