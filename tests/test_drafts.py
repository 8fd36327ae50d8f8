"""Rules for drafts, texts of items, and the stored search index, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.formulas import formula_spans
from lectern.operators import drafts, layout, search
from tests.test_operators import pages, rows  # noqa: F401

CLAIM = "text string, evidence string, explanation string, proposition_id long, variant_id long"
CHOICE = "text string, is_answer boolean, proposition_id long, variant_id long, custom_evidence string, combo string"
SCHEMA = f"id int, qtype string, passage string, ask string, explanation string, style_meta string, claims array<struct<{CLAIM}>>, choices array<struct<{CHOICE}>>"
ASK = "이에 대한 설명으로 옳은 것만을 <보기>에서 있는 대로 고른 것은?"
GOOD = ("물체는 움직인다.", "책", "까닭", None, None)
RIGHT, LEFT = ("가", True, 1, None, "", ""), ("나", False, None, 2, None, None)


def codes(spark, *row):
    d = spark.createDataFrame([row], SCHEMA)
    return sorted((r.code, r.field, r.place) for r in drafts.draft_check(d, ["frac"]).collect())


def test_a_whole_draft_is_quiet(spark):
    assert codes(spark, 1, "합답형", "그림은 물체의 운동을 나타낸 것이다.", ASK, "", None, [GOOD] * 3, [RIGHT, LEFT]) == []


def test_claims_without_evidence(spark):
    bad = [GOOD, ("물체는 크다.", " ", "", None, None), ("물체", "책", None, 5, None)]
    got = codes(spark, 1, "합답형", "", ASK, None, "", bad, [RIGHT, LEFT])
    assert got == [("bogi_no_evidence", "claims", 2), ("bogi_no_explanation", "claims", 2), ("bogi_no_explanation", "claims", 3), ("choice_ending", "claims", 3), ("evidence_missing", "claims", 2)]


def test_choices_without_evidence_and_frames(spark):
    got = codes(spark, 1, "정답형", "아무 말.", "무엇?", "[[formula:α]]", "{", None, [RIGHT, ("나", False, None, None, " ", ""), ("다", False, None, None, None, "ㄱ")])
    assert got == [("choice_no_evidence", "choices", 2), ("evidence_missing", "choices", 2), ("evidence_missing", "choices", 3), ("formula_invalid", "explanation", None),
                   ("style_frame_unattested", "ask", None), ("style_frame_unattested", "passage", None)]


def test_reconstructions_are_exempt_and_codes_come_once(spark):
    restored = '{"reconstruction": {"enabled": true}}'
    assert codes(spark, 1, "합답형", "아무 말.", "무엇?", "[[formula:x", restored, [("물체", "책", "까닭", None, None)], [RIGHT]) == [("formula_invalid", "explanation", None)]
    assert codes(spark, 1, "서술형", None, " ", None, None, None, None) == [("no_ask", "ask", None)]
    assert ("bogi_reference_orphan", "ask", None) in codes(spark, 1, "정답형", "", ASK, "", '{"reconstruction": {"enabled": false}}', [], [RIGHT])


def test_cited_references(spark):
    cite = lambda e: ("물체는 크다.", e, "까닭", None, None)
    claims = [cite("reference_id=3: 책"), cite("[ref:007] 책"), cite("책 3쪽"), cite(None), cite("reference_id = 3, [ref:9"), cite("reference_id=99999999999999999999")]
    row = (1, "합답형", "", ASK, None, "", claims, [RIGHT, LEFT], [3, 7])
    d = spark.createDataFrame([row, (2, "정답형", "", "x", None, "", None, [("가", True, 1, None, "[ref:3]", ""), LEFT], None)], SCHEMA + ", attached array<bigint>")
    got = sorted((r.id, r.code, r.field, r.place) for r in drafts.draft_check(d, ["frac"], attached="attached").collect() if r.code.startswith("evidence_reference"))
    missing, unknown = "evidence_reference_id_missing", "evidence_reference_unknown"
    assert got == [(1, missing, "claims", 3), (1, missing, "claims", 4), (1, unknown, "claims", 5), (1, unknown, "claims", 6), (2, missing, "choices", 2), (2, unknown, "choices", 1)]


def test_formulas_over_line_ends(spark):
    assert ("formula_invalid", "explanation", None) in codes(spark, 1, "정답형", "", "x", "[[formula:a\nα]]", "", None, [RIGHT])
    d = spark.createDataFrame([("[[formula:a\nb]] [[formula:]] x]]",), ("[[formula:a",)], "t string")
    assert [r[0] for r in d.select(formula_spans(F.col("t"))).collect()] == [["a\nb", "]] x"], []]


def test_items_and_numbers(spark):
    items = spark.createDataFrame([(1, 7, 2, 5, "AI초안", "초안"), (1, 8, 1, 6, " ", "완성"), (1, 9, 1, 7, None, None), (2, 7, 1, 8, "직접", "완성")], "set_id int, question_id int, ord int, item_id int, origin string, status string")
    issues = spark.createDataFrame([(7, "no_ask", "error"), (99, "x", "warn")], "id int, code string, level string")
    assert rows(drafts.propagated(items, issues)) == [(1, 3, 7, "no_ask", "error"), (2, 1, 7, "no_ask", "error")]
    assert rows(drafts.flagged_numbers(items, 1)) == [(1, 1, "3", 2, "1 외"), (2, 0, "", 0, "")]


@pytest.mark.parametrize("combo,text,shown", [('["ㄱ","ㄷ"]', "x", "ㄱ, ㄷ"), ("ㄱ, ㄴ,", "x", "ㄱ, ㄴ"), ("[ㄱ", None, "[ㄱ"), ("[]", "x", "x"), (None, "x", "x"), ("", "", "-"), (None, None, "-")])
def test_choice_text(spark, combo, text, shown):
    d = spark.createDataFrame([(combo, text)], "combo string, text string")
    assert d.select(drafts.choice_text(F.col("combo"), F.col("text"))).first()[0] == shown


@pytest.mark.parametrize("text,want", [
    ("다음 중 옳은 것은? [2점] ① 가", ("정답형", "다음 중 옳은 것은? ① 가", 2, [])),
    ("옳은 것은? (단, 없다.) <보 기> ㄱ. 가 나\nㄴ. 다 ㄷ. 라. [3점]", ("합답형", "옳은 것은? (단, 없다.)", 3, ["가 나", "다", "라."])),
    ("<보기>에서 고른 것은? ㄱ. 가 ㄴ. 나 ㄷ. 다", ("합답형", "<보기>에서 고른 것은?", 3, ["가", "나", "다"])),
    ("옳은 것은? <보기> ㄱ. 가 ㄴ. 나", ("정답형", "옳은 것은? <보기> ㄱ. 가 ㄴ. 나", 3, [])),
])
def test_stem_and_claims(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(drafts.split_stem_claims(F.col("t")).alias("x")).select("x.*").first()
    assert tuple(got) == want


def test_warnings(spark):
    d = spark.createDataFrame([(1, 2, None, ["a"]), (1, 1, 9, ["a", "b"]), (1, 3, 4, []), (2, 1, 1, None)], "job_id int, ord int, number int, unplaced array<string>")
    assert rows(drafts.warnings_of(d)) == [(1, ["9번 문항에 미배치 자료가 2개 있습니다.", "2번 문항에 미배치 자료가 1개 있습니다."])]


def test_types(spark):
    catalog = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", "B", ["y"])], "domain string, label string, types array<string>")
    asked = spark.createDataFrame([("b", "y"), ("b", "x"), ("a", "z"), (None, "x")], "domain string, type_id string")
    assert rows(drafts.compatible_types(asked, catalog)) == sorted([("b", "y", True, True, "A"), ("b", "x", True, False, "A"), ("a", "z", False, False, None), (None, "x", True, False, "A")], key=str)


def slow_merge(boxes, gap):
    live = [[*b, 1] for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(live)) for j in range(i) if live[i][0] - gap <= live[j][2] and live[j][0] <= live[i][2] + gap and live[i][1] - gap <= live[j][3] and live[j][1] <= live[i][3] + gap), None)
        if pair is None:
            return sorted(live)
        b, a = live.pop(pair[0]), live.pop(pair[1])
        live.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]])


def test_merged_boxes_like_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 2, 30, 60):
        boxes = [(x, y, x + rng.random() * 30, y + rng.random() * 30) for x, y in ((rng.random() * 600, rng.random() * 600) for _ in range(n))]
        for strip in (4, 256):
            assert layout.merged_boxes(boxes, 6.0, strip) == slow_merge(boxes, 6.0)


def test_figures(spark):
    sizes = spark.createDataFrame([(1, 400.0, 400.0)], "page int, width double, height double")
    images = spark.createDataFrame([(1, 10.0, 10.0, 60.0, 60.0), (1, 300.0, 5.0, 303.0, 8.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    strokes = [(1, 50.0, 50.0, 80.0 + k, 90.0) for k in range(4)] + [(1, 250.0, 100.0, 300.0, 150.0 + k) for k in range(4)] + [(1, 0.0, 200.0, 400.0, 200.5), (1, 250.0, 300.0, 300.0, 350.0)]
    got = layout.figure_regions(images, spark.createDataFrame(strokes, images.schema), sizes, "page")
    assert rows(got) == [(1, 10.0, 10.0, 83.0, 90.0, "image", 1), (1, 250.0, 100.0, 300.0, 153.0, "vector", 2)]


def test_text_of_spans(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 10.0, 5.0, 10.0, "a "), (1, 2, 14.0, 20.0, 5.5, 10.0, " b"), (1, 3, 21.0, 30.0, 5.5, 10.0, "c"), (1, 4, 0.0, 5.0, 20.0, 10.0, "d"), (2, 1, 0.0, 1.0, 0.0, 1.0, None)], "page int, k int, x0 double, x1 double, y double, h double, text string")
    assert rows(layout.assemble_text(d, ["page"], ["k"])) == [(1, "a bc\nd"), (2, "")]


def test_items_at_points(spark):
    items = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 2, 1, 20.0, 0.0, 30.0, 10.0)], "page int, item_id int, col int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 1, 25.0, 5.0), (1, 2, 15.0, 5.0), (1, 3, 5.0, 50.0), (2, 4, 5.0, 5.0)], "page int, point_id int, x double, y double")
    assert rows(layout.item_at(points, items, ["page"])) == [(1, 1, 2, True), (1, 2, 1, False), (1, 3, None, None), (2, 4, None, None)]


def test_index_gives_what_the_scan_gives(spark, pages, tmp_path):  # noqa: F811
    more = pages.unionByName(spark.createDataFrame([(5, "book", 1, "!!"), (6, "book", 1, None)], pages.schema))
    index = search.build_index(more, str(tmp_path / "index"))
    assert index.pages == more.count()
    for query in ("빛", "빛 굴절", "거울", "없는말", "", "물"):
        cols = ["document_id", "page_no", "doc_type", F.round("score", 9).alias("score"), "match_pct", "total"]
        assert rows(search.search_index(index, query).select(*cols)) == rows(search.search(more, query).select(*cols)), query
    asked = spark.createDataFrame([(1, "빛"), (2, "물"), (2, "굴"), (3, "물에서"), (4, "없는말")], "query_id int, term string")
    got = {(r.query_id, r.document_id, r.page_no) for r in search.search_many(index, asked).collect()}
    assert got == {(1, 1, 1), (1, -1, 1), (2, 1, 1), (3, 1, 1)}
