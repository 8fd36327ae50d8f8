"""Operators on literal rows: positive and quiet cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text, windows
from lectern.operators import bank, layout, lineage, mining, quality, search
from lectern.sources import corpus
from lectern.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PAGES = [(1, "book", 1, "빛은 거울에서 반사하고 물에서 굴절이 일어난다"), (1, "book", 2, "평면거울 앞의 물체"), (-1, "lesson", 1, "오늘은 빛과 그림자")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "document_id long, doc_type string, page_no int, body string")


@pytest.mark.parametrize("query,found", [("빛 굴절", [(1, 1)]), ("#빛 #굴절", [(1, 1)]), ("없는말", []), ("", []), ("거울", [(1, 1)]), ("빛", [(-1, 1), (1, 1)])])
def test_prefix_search(pages, query, found):
    assert sorted((r.document_id, r.page_no) for r in search.search(pages, query).collect()) == found


def test_query_terms():
    assert text.query_terms("[9과10-01]") == ["9과10", "01"] and text.query_terms(" # ") == []


def test_search_pct_and_total(pages):
    got = search.search(pages, "빛", limit=1).collect()
    assert len(got) == 1 and got[0].match_pct == 100 and got[0].total == 2


def test_substring_mode_ignores_blanks(pages):
    assert rows(search.substring_and_match(pages, ["거울앞의"]).select("document_id", "page_no")) == [(1, 2)]


def test_proximity(spark):
    df = spark.createDataFrame([("abcxyz",), ("abc" + "-" * 200 + "xyz",), ("xyz only",), ("xyz" + "-" * 67 + "abc",)], "t string")
    got = [r[0] for r in df.select(search.proximity(F.col("t"), ["abc", "xyz"])).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0 and got[3] == pytest.approx(1 - 67 / 140)


def test_line_chunks_rejoin(spark):
    whole = "\n".join(f"line {i}" for i in range(200))
    d = spark.createDataFrame([(1, whole), (2, ""), (3, "\n \n")], "id long, text string")
    got = corpus.line_chunks(d, ["id"], "text", 100).orderBy("id", "page_no").collect()
    assert {r.id for r in got} == {1} and "\n".join(r.body for r in got) == whole
    assert max(len(r.body) for r in got) <= 100


def test_paragraph_pages_number_after_the_filter(spark):
    d = spark.createDataFrame([(1, "short\n\na long enough block\n\n   \n\nanother block of text")], "id long, text string")
    assert rows(corpus.paragraph_pages(d, ["id"], "text")) == [(1, 1, "a long enough block"), (1, 2, "another block of text")]


def test_reindex_replaces(spark):
    cur = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "id long, page_no int, body string")
    new = spark.createDataFrame([(1, "new"), (3, "")], "id long, text string")
    assert rows(corpus.reindex(cur, new, "id")) == [(1, 1, "new"), (2, 1, "kept")]


def test_snapshots_rotate(spark, tmp_path):
    root = str(tmp_path / "snap")
    for n in (1, 2, 3, 4):
        corpus.snapshot({"t": spark.range(n)}, root)
    assert rows(corpus.list_snapshots(spark, root, ["t"])) == [(1, "t", 4), (2, "t", 3), (3, "t", 2)]
    assert corpus.restore(spark, root, 2, "t").count() == 3
    oldest = corpus.restore(spark, root, 3, "t", {"t": spark.range(9)})
    assert oldest.count() == 2 and rows(corpus.list_snapshots(spark, root, ["t"])) == [(1, "t", 9), (2, "t", 4), (3, "t", 3)]


def test_ocr_words_and_inventory(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"page": 3, "words": [{"text": "가", "bbox": [1, 2, 3, 4], "confidence": 0.5}]}')
    got = corpus.read_ocr_words(spark, str(tmp_path)).first()
    assert (got.page_no, got.text, got.x1) == (3, "가", 3.0)
    assert corpus.corpus_inventory(spark, str(tmp_path)).first().format == "JSON"


def test_tsv_cells(spark):
    d = spark.createDataFrame([("a\tb", "c\nd", None)], "x string, y string, z string")
    assert bank.to_tsv(d).first().line == "a b\tc d\t"


CHOICES = "array<struct<ord:int,choice_id:long,text:string,is_answer:boolean,proposition_id:long>>"


def items(spark, answer="", points=None, default=3.0, ords=(3,)):
    choices = [(i, i, "t", i in ords, None) for i in range(1, 6)]
    return spark.createDataFrame([(1, 1, 1, 1, points, default, answer, "정답형", "중", choices)], f"set_id long, item_id long, ord long, question_id long, points double, default_points double, answer string, qtype string, difficulty string, choices {CHOICES}")


@pytest.mark.parametrize("kw,answer,points", [({}, "③", "3"), ({"points": 4.0}, "③", "4"), ({"answer": "②③"}, "②③", "3"), ({"points": 2.5, "ords": (2, 4)}, "② ④", "2.5"), ({"ords": ()}, "", "3")])
def test_answer_key(spark, kw, answer, points):
    r = bank.answer_key(items(spark, **kw)).first()
    assert (r.answer, r.points) == (answer, points)


def test_three_rules_of_points(spark):
    d = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (2.25, 5.0)], "p double, d double")
    got = [[r[0] for r in d.select(bank.effective_points(F.col("p"), F.col("d"), m)).collect()] for m in ("report", "dashboard", "check")]
    assert got == [[0.0, 5.0, 2.2], [0.0, 5.0, 2.25], [5.0, 5.0, 2.25]]


def question(spark, **kw):
    base = {"id": 1, "ask": "옳은 것은?", "qtype": "정답형", "answer": "", "origin": "직접", "difficulty": "중", "default_points": 2.0, "standard_code": "9과01-01", "is_negative": False, "texts": ["aa", "bb", "cc"], "right": [0]} | kw
    choices = [(t, i in base["right"], None) for i, t in enumerate(base["texts"])]
    schema = "id long, ask string, qtype string, answer string, origin string, difficulty string, default_points double, standard_code string, is_negative boolean, choices array<struct<text:string,is_answer:boolean,proposition_id:long>>"
    return spark.createDataFrame([(base["id"], base["ask"], base["qtype"], base["answer"], base["origin"], base["difficulty"], base["default_points"], base["standard_code"], base["is_negative"], choices)], schema)


@pytest.mark.parametrize("change,code", [
    ({"ask": " "}, "no_ask"), ({"qtype": "x"}, "bad_qtype"), ({"qtype": None}, "bad_qtype"), ({"qtype": "서술형"}, "no_model_answer"), ({"texts": ["a"]}, "too_few_choices"),
    ({"right": []}, "no_answer"), ({"right": [0, 1]}, "multi_answer"), ({"texts": ["a", "", "c"]}, "choice_no_evidence"), ({"origin": None}, "no_origin"), ({"origin": "?"}, "bad_origin"),
    ({"difficulty": ""}, "bad_difficulty"), ({"default_points": 0.0}, "bad_points"), ({"standard_code": ""}, "no_standard"), ({"ask": "옳지 않은 것은?"}, "negative_unmarked"),
    ({"is_negative": True}, "negative_mismatch"), ({"texts": ["aaaaaaaa", "bb", "cc"]}, "answer_longest"),
])
def test_question_rules(spark, change, code):
    got = {r.code for r in quality.check(question(spark, **change), ["id"], quality.question_rules()).collect()}
    assert code in got


def test_quiet_question(spark):
    assert quality.check(question(spark), ["id"], quality.question_rules()).count() == 0
    assert quality.check(question(spark, qtype="서술형", answer="a", texts=[], right=[]), ["id"], quality.question_rules()).count() == 0


def test_two_columns_of_items(spark):
    marks = [(1, 1, "1.", 88.0, 160.0), (1, 1, "2.", 88.0, 500.0), (1, 1, "3.", 437.0, 160.0), (1, 1, "4.", 437.0, 600.0), (1, 1, "word", 90.0, 170.0)]
    w = spark.createDataFrame(marks, "doc_id long, page_no int, text string, x0 double, y0 double")
    p = spark.createDataFrame([(1, 1, 842.0, 1191.0)], "doc_id long, page_no int, width double, height double")
    got = {r.number: r for r in layout.segment_items(w, p).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].x1 == got[2].x1 == got[3].x0 == 429.0 and got[1].y1 == got[2].y0 == 492.0 and got[4].y1 == 1161.0


def test_crop_audit(spark):
    i = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 200.0, 0.0, 0.0, 150.0, 100.0, "", False), (2, 0.0, 0.0, 200.0, 200.0, 10.0, 10.0, 250.0, 100.0, "other words here", False)],
                              "item_id long, i_x0 double, i_y0 double, i_x1 double, i_y1 double, c_x0 double, c_y0 double, c_x1 double, c_y1 double, editable_text string, semantic boolean")
    r = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 20.0, "x", 40, 9), (2, 10.0, 10.0, 100.0, 20.0, "none of that", 40, 9)], "item_id long, r_x0 double, r_y0 double, r_x1 double, r_y1 double, text string, characters int, words int")
    m = spark.createDataFrame([(1, 100.0, 50.0, 180.0, 90.0)], "item_id long, m_x0 double, m_y0 double, m_x1 double, m_y1 double")
    assert rows(layout.crop_audit(i, r, m)) == [(1, "clipping", 1), (1, "contamination", 1), (2, "spill", 1)]


def test_greedy_rows_keep_their_anchor(spark):
    w = spark.createDataFrame([(1, k, f"w{k}", float(10 - k), float(y)) for k, y in enumerate((0, 10, 20, 31))], "page long, word_id long, text string, x0 double, y0 double")
    assert [r.line for r in layout.text_rows(w, ["page"]).orderBy("row").collect()] == ["w1 w0", "w3 w2"]


def test_clusters_grow_as_they_merge(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 15.0, 0.0, 25.0, 40.0), (1, 0.0, 45.0, 5.0, 50.0), (1, 200.0, 200.0, 210.0, 210.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.box_clusters(b, "page")) == [(1, 0.0, 0.0, 25.0, 50.0, 3), (1, 200.0, 200.0, 210.0, 210.0, 1)]


def test_highlight_ignores_blanks(spark):
    c = spark.createDataFrame([(1, i, ch, i * 10.0, i * 10.0 + 9) for i, ch in enumerate("빛 이 빛이")], "line_id long, pos int, ch string, x0 double, x1 double")
    assert rows(layout.highlight_hits(c, ["빛이"])) == [(1, "빛이", 1, 0.0, 29.0), (1, "빛이", 3, 40.0, 59.0)]


def test_code_ranges(spark):
    d = spark.createDataFrame([(1, "[9과01-01∼03]"), (2, "[9과01-01]∼[9과01-02]"), (3, "[9과02-09] text"), (4, "none")], "id long, t string")
    assert rows(mining.expand_code_ranges(d, "t").select("id", "code")) == [(1, "9과01-01"), (1, "9과01-02"), (1, "9과01-03"), (2, "9과01-01"), (2, "9과01-02"), (3, "9과02-09")]


def test_frames(spark):
    d = spark.createDataFrame([("이에 대한 설명으로 옳은 것만을 <보기>에서 있는 대로 고른 것은? [3점]", "정답형"), ("파장은?", "합답형"), ("파장은?", "정답형")], "a string, q string")
    assert [r[0] for r in d.select(mining.ask_frame(F.col("a"), F.col("q"))).collect()] == ["ASK_BOGI_STANDARD", None, "ASK_VALUE"]


def test_valid_prefix_and_resume(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "stage string, rank int")
    st = spark.createDataFrame([("x", "a", 1, True), ("x", "b", 2, False), ("x", "c", 3, True), ("y", "a", 1, True)], "source string, stage string, rank int, valid boolean")
    assert rows(windows.valid_prefix(st, "source", "rank", "valid").select("source", "stage")) == [("x", "a"), ("y", "a")]
    assert rows(lineage.resume_plan(st, plan).select("source", "stage")) == [("x", "b"), ("x", "c"), ("y", "b"), ("y", "c")]
    assert rows(windows.next_pending_stage(st.where("valid"), plan, "source")) == [("x", "b"), ("y", "b")]


def test_region_of_lines(spark):
    lines = spark.createDataFrame([(1, 1), (1, 5), (1, 9)], "d long, line int")
    starts = spark.createDataFrame([(1, 3, "s1"), (1, 9, "s2")], "d long, start int, name string")
    assert rows(lineage.assign_region(lines, starts, ["d"], "line", "start", "name").select("line", "region")) == [(1, None), (5, "s1"), (9, "s2")]


def test_null_safe_reference_upsert(spark):
    cur = spark.createDataFrame([(1, None, "old"), (2, 5, "keep")], "page long, q long, note string")
    new = spark.createDataFrame([(1, None, "new"), (2, 5, " "), (3, None, "added")], "page long, q long, note string")
    assert rows(bank.exam_ref_upsert(cur, new, ["page", "q"])) == [(1, None, "new"), (2, 5, "keep"), (3, None, "added")]


def test_seed_merge_never_deletes(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    seed = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert rows(bank.seed_merge(cur, seed, ["k"], ["v"])) == [(1, "a"), (2, None), (3, "c")]


def test_incremental_index_replaces_versions(spark, tmp_path):
    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "document_id long, page_no int, body string"
    for rows_in in ([(1, 1, "old"), (2, 1, "kept")], [(1, 1, "new"), (1, 2, "more")]):
        spark.createDataFrame(rows_in, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.incremental_index(stream, index, str(tmp_path / "cp")).start().awaitTermination()
    assert rows(jobs.current_pages(spark, index).select("document_id", "page_no", "body")) == [(1, 1, "new"), (1, 2, "more"), (2, 1, "kept")]


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as kind union all select timestamp'2024-01-01 00:50:00', 'a'").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "e"))
    assert [r.n for r in jobs.written_to_end(jobs.windowed_counts(s, "ts", "kind"), "windowed").collect()] == [2]


def test_job_states(spark):
    d = spark.createDataFrame([(1, "ready"), (1, "failed"), (2, "failed"), (3, "ready"), (4, None)], "job_id long, status string")
    assert rows(lineage.job_status(d).select("job_id", "state")) == [(1, "partial_failure"), (2, "failed"), (3, "review"), (4, "review")]


def test_lint(spark):
    d = spark.createDataFrame([(" ",), ("a ` b",), (f"x{chr(0xE001)}",), ("fine",), (";3!;",)], "t string")
    assert [r[0] for r in d.select(quality.text_lint(F.col("t"))).collect()] == ["empty text", "backtick", "private or control character", None, "fraction code"]


def test_choice_texts_need_every_mark_once(spark):
    from lectern.operators import items as it

    marks = [(1, i, m, 10.0 + 100 * i, 5.0 + (i > 2) * 20) for i, m in enumerate("①②③④⑤")]
    words = [(1, 10 + i, f"w{i}", 20.0 + 100 * i, 6.0 + (i > 2) * 20) for i in range(5)]
    schema = "page long, word_id long, text string, x0 double, y0 double"
    d = spark.createDataFrame(marks + words + [(1, 20, "ㄱ", 25.0, 6.0), (1, 21, ",", 26.0, 6.0), (1, 22, "ㄴ", 27.0, 6.0)], schema)
    got = dict(it.choice_texts(d, ["page"]).select("no", "choice").collect())
    assert got == {1: "w0 ㄱ, ㄴ", 2: "w1", 3: "w2", 4: "w3", 5: "w4"}
    assert it.choice_texts(spark.createDataFrame(marks[:4] + words, schema), ["page"]).count() == 0


def test_captions_are_all_or_nothing(spark):
    from lectern.operators import items as it

    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 50.0), (1, 2, 100.0, 0.0, 150.0, 50.0), (2, 1, 0.0, 0.0, 50.0, 50.0), (2, 2, 100.0, 0.0, 150.0, 50.0)], "item_id long, panel_id long, x0 double, y0 double, x1 double, y1 double")
    lab = spark.createDataFrame([(1, 7, 25.0, 60.0), (1, 8, 125.0, -5.0), (2, 7, 25.0, 60.0)], "item_id long, label_id long, lx double, ly double")
    assert rows(it.caption_for_panel(p, lab)) == [(1, 1, 7), (1, 2, 8)]


def test_generated_marks_need_a_peer(spark):
    from lectern.operators import items as it

    d = spark.createDataFrame([(1, 1, 1, 0, "1.", 50.0, 100.0), (1, 2, 2, 0, "2", 55.0, 100.0), (1, 2, 2, 1, ".", 60.0, 100.0), (1, 1, 3, 0, "3.", 400.0, 100.0), (1, 1, 4, 0, "4.", 52.0, 5.0)], "doc_id long, page_no int, block int, word_no int, text string, x0 double, y0 double")
    assert rows(it.generated_marks(d).select("number")) == [(1,), (2,)]


def test_text_goes_on_over_pages(spark):
    from lectern.operators import items as it

    lines = spark.createDataFrame([(1, 1, 0, 1.0, "before"), (1, 1, 0, 20.0, "a"), (1, 2, 0, 5.0, "b"), (1, 2, 0, 50.0, "c")], "doc_id long, page_no int, col int, y double, text string")
    marks = spark.createDataFrame([(1, 1, 0, 10.0, 1), (1, 2, 0, 40.0, 2)], "doc_id long, page_no int, col int, y double, number int")
    assert rows(it.continuation_text(lines, marks)) == [(1, 1, "a\nb"), (1, 2, "c")]
