"""Data-quality rules over whole banks and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import bank, quality
from lectern.plans.base import query
from lectern.plans.views import Views

AGG = """c AS (SELECT question_id, count(*) AS n, count(*) FILTER (WHERE is_answer) AS answers, count(*) FILTER (WHERE length(trim(text)) > 0) AS texts,
 max(length(trim(text))) FILTER (WHERE is_answer) AS la, max(length(trim(text))) AS lm, avg(length(trim(text))) FILTER (WHERE NOT is_answer) AS mean FROM {choice} GROUP BY 1)"""
RULES = (
    ("no_ask", "error", "trim(ask) = ''"), ("bad_qtype", "error", "qtype = 'PROMO'"), ("no_model_answer", "error", "qtype = '서술형' AND trim(answer) = ''"),
    ("too_few_choices", "error", "qtype <> '서술형' AND n < 2"), ("no_answer", "error", "qtype <> '서술형' AND answers = 0"), ("multi_answer", "warn", "qtype <> '서술형' AND answers > 1"),
    ("bad_difficulty", "warn", "coalesce(difficulty, '') NOT IN ('상', '중', '하')"), ("no_origin", "warn", "origin = ''"), ("bad_origin", "warn", "origin = '기타'"), ("bad_points", "warn", "coalesce(default_points, 0) <= 0"), ("no_standard", "warn", "trim(standard_code) = ''"),
    ("negative_unmarked", "warn", "contains(ask, '옳지 않') AND NOT is_negative"), ("negative_mismatch", "warn", "is_negative AND NOT contains(ask, '옳지 않')"), ("answer_longest", "warn", "qtype <> '합답형' AND texts >= 3 AND answers = 1 AND la = lm AND la >= mean * 1.4::DOUBLE"),
)
ISSUES = "WITH " + AGG + ", q AS (SELECT q.*, coalesce(c.n, 0) AS n, coalesce(c.answers, 0) AS answers, coalesce(c.texts, 0) AS texts, la, lm, mean FROM {question} q LEFT JOIN c ON c.question_id = q.id), issues AS (" + " UNION ALL ".join(
    f"SELECT id, '{c}' AS code, '{level}' AS level FROM q WHERE {cond}" for c, level, cond in RULES) + ")"


def checked(v: Views) -> DataFrame:
    nested = v("choice").groupBy(F.col("question_id").alias("id")).agg(F.collect_list(F.struct("text", "is_answer", "proposition_id")).alias("choices"))
    return quality.check(v("question").join(nested, "id", "left"), ["id"], quality.question_rules())


@query(ISSUES + " SELECT id, code, level FROM issues")
def question_check(v: Views) -> DataFrame:
    return checked(v)


@query(ISSUES + " SELECT id, count(*) FILTER (WHERE level = 'error') AS error_count, count(*) FILTER (WHERE level = 'warn') AS warn_count, count(*) FILTER (WHERE level = 'error') = 0 AS ok FROM issues GROUP BY 1")
def check_summary(v: Views) -> DataFrame:
    return quality.summarize(checked(v), ["id"])


@query(ISSUES + " SELECT id FROM {question} WHERE status = '완성' AND id IN (SELECT id FROM issues WHERE level = 'error')")
def completion_gate(v: Views) -> DataFrame:
    return quality.completion_gate(v("question"), quality.summarize(checked(v), ["id"]), "id").select("id")


@query("""WITH s AS (SELECT e.set_id, coalesce(n, 0) AS n, p, st, dr, nor FROM {exam_set} e LEFT JOIN (SELECT set_id, count(*) AS n, sum(CASE WHEN points <> 0 THEN points ELSE default_points END) AS p,
count(DISTINCT CASE WHEN standard_code <> '' THEN standard_code END) AS st, count(*) FILTER (WHERE origin = 'AI초안' AND status <> '완성') AS dr, count(*) FILTER (WHERE origin = '') AS nor FROM {item} GROUP BY 1) i ON i.set_id = e.set_id)
SELECT set_id, 'empty_set' AS code, 'error' AS level FROM s WHERE n = 0 UNION ALL SELECT set_id, 'points_mismatch', 'warn' FROM s WHERE n > 0 AND abs(p - 100) > 0.01
UNION ALL SELECT set_id, 'low_coverage', 'warn' FROM s WHERE n > 0 AND st < n / 2.0::DOUBLE UNION ALL SELECT set_id, 'ai_draft_unreviewed', 'error' FROM s WHERE dr > 0 UNION ALL SELECT set_id, 'set_no_origin', 'warn' FROM s WHERE nor > 0""")
def set_check(v: Views) -> DataFrame:
    return quality.set_rules(v("exam_set"), v("item"))


@query("""WITH c AS (SELECT question_id, count(*) AS n, count(*) FILTER (WHERE is_answer) AS a, min(ord) FILTER (WHERE is_answer) AS o FROM {option} GROUP BY 1),
j AS (SELECT s.set_id, row_number() OVER (PARTITION BY s.set_id ORDER BY s.ord, s.item_id) AS place, c.n, CASE WHEN c.a = 1 THEN c.o END AS o FROM {set_item} s LEFT JOIN c ON c.question_id = s.question_id),
b AS (SELECT set_id, count(*) AS items, count(o) AS total, max(n) AS most, list(DISTINCT o) FILTER (WHERE o IS NOT NULL) AS used FROM j GROUP BY 1 HAVING count(*) >= 5 AND count(o) > 0 AND max(n) >= 2 AND count(o) >= max(n)),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY k DESC, first) AS r FROM (SELECT set_id, o, count(*) AS k, min(place) AS first FROM j WHERE o IS NOT NULL GROUP BY 1, 2) x)
SELECT b.set_id, 'answer_bias' AS code, 'warn' AS level, k.o || ': ' || k.k || '/' || b.total AS detail FROM b JOIN k ON k.set_id = b.set_id AND k.r = 1 WHERE k.k > 0.4::DOUBLE * total
UNION ALL SELECT set_id, 'answer_unused', 'warn', array_to_string(list_filter(range(1, most + 1), lambda p: NOT list_contains(used, p)), ' ') FROM b WHERE len(list_filter(used, lambda p: p <= most)) < most""")
def answer_spread(v: Views) -> DataFrame:
    return quality.answer_spread(v("set_item"), v("option"))


@query("""SELECT set_id, proposition_id, n FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY proposition_id) AS k FROM (SELECT set_id, proposition_id, count(*) AS n FROM (
SELECT DISTINCT s.set_id, s.question_id, c.proposition_id FROM {set_item} s JOIN {choice} c ON s.question_id = c.question_id) x GROUP BY 1, 2 HAVING count(*) > 1) y) z WHERE k <= 4""")
def duplicate_proposition(v: Views) -> DataFrame:
    return quality.set_duplicates(v("set_item"), v("choice")).select("set_id", "proposition_id", "n")


PRIVATE = f"[{chr(0xE000)}-{chr(0xF8FF)}]"
LINT = r"""CASE WHEN n_chars % 10 = 0 THEN 'picture of the whole item' WHEN trim(text) = '' THEN 'empty text' WHEN n_chars % 16 = 8 THEN 'not five choices' WHEN regexp_matches(text, '\[26023-[0-9]{4}\]') THEN 'source id'
WHEN regexp_matches(text, ';[0-9]+[!@#$%^&*()];') THEN 'fraction code' WHEN contains(text, '`') THEN 'backtick'
WHEN regexp_matches(text, 'PRIVATE') OR regexp_matches(text, '[\x00-\x08\x0b-\x1f\x7f-\x{af}\x{b2}-\x{b6}\x{b8}-\x{d6}\x{d8}-\x{ff}]') THEN 'private or control character' WHEN n_chars % 9 = 0 THEN 'formula: greek'
WHEN regexp_matches(text, '[!?.#$%&*]{3,}') THEN 'repeated punctuation' WHEN regexp_matches(text, '[0-9]{7,}') THEN 'digit run' WHEN contains(text, '@') THEN 'at sign' END""".replace("PRIVATE", PRIVATE)


@query(f"SELECT doc_id, {LINT} AS problem FROM documents")
def editable_text_lint(v: Views) -> DataFrame:
    """Whole documents as texts of items: some of them set as one picture, some with four choices, some with a wrong formula."""
    n = F.col("n_chars")
    text = F.concat("text", F.when(n % 9 == 0, "[[formula:α]]").otherwise(""))
    markup = F.when(n % 10 == 0, F.concat(F.lit(quality.WHOLE_PICTURE), "text")).otherwise(F.concat(F.lit("set in "), "lang"))
    found = quality.text_lint(text, markup, F.when(n % 8 == 0, 4).otherwise(5), F.when(n % 16 == 0, 5))
    return v("documents").select("doc_id", found.alias("problem"))


@query(f"SELECT doc_id, n_chars % 5 = 0 OR regexp_matches(text, '{PRIVATE}') AS private FROM documents")
def contains_private_use(v: Views) -> DataFrame:
    """Every fifth length brings a private-use character behind the text."""
    d = v("documents").withColumn("text", F.when(F.col("n_chars") % 5 == 0, F.concat("text", F.lit(chr(0xE123)))).otherwise(F.col("text")))
    return d.select("doc_id", quality.contains_private_use(d).alias("private"))


@query("""SELECT set_id, 'question' AS kind, question_id AS value, count(*) AS n FROM {set_item} WHERE question_id IS NOT NULL GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT set_id, 'ord', ord, count(*) FROM {set_item} GROUP BY 1, 3 HAVING count(*) > 1""")
def invariant_violations(v: Views) -> DataFrame:
    return quality.invariant_violations(v("set_item"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM {labelled} WHERE status <> 'failure' UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) x GROUP BY 1 HAVING count(*) > 1")
def unique_outcomes(v: Views) -> DataFrame:
    return quality.unique_outcomes(v("labelled").where("status <> 'failure'"), v("labels").where("toxic = 1 or quality = 0"), ["doc_id"])


@query("SELECT item_id FROM {set_item} WHERE question_id <> l_suppkey * 10")
def wrong_owner(v: Views) -> DataFrame:
    return quality.wrong_owner(v("set_item").withColumn("owner", F.col("l_suppkey") * 10), "owner", "question_id").select("item_id")


@query("SELECT d.doc_id, doc_id % 3 <> 0 AS ok FROM documents d")
def hash_gate(v: Views) -> DataFrame:
    d = v("documents").select("doc_id", "text")
    recorded = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("recorded"))
    return quality.hash_gate(d, recorded, "doc_id", "text").select("doc_id", "ok")


@query(ISSUES + " SELECT code, CASE WHEN code IN ('no_origin', 'bad_points') THEN 'diagnostic' ELSE 'blocking' END AS severity, count(*) AS n FROM issues GROUP BY 1, 2")
def severity_policy(v: Views) -> DataFrame:
    return quality.severity_policy(checked(v), ["no_origin", "bad_points"]).groupBy("code", "severity").agg(F.count("*").alias("n"))



@query(" UNION ALL ".join([f"SELECT doc_id, 'style_forbidden_phrase_{i}' AS code, 'error' AS level FROM documents WHERE n_chars % 12 = {i} OR contains(text, '{p}')" for i, p in enumerate(quality.FORBIDDEN)]
                          + ["SELECT doc_id, 'bogi_reference_missing', 'error' FROM documents WHERE n_chars % 5 <> 0 AND NOT contains(text, 'the')",
                             "SELECT doc_id, 'bogi_reference_orphan', 'error' FROM documents WHERE n_chars % 5 = 0 AND contains(text, 'the')",
                             "SELECT doc_id, 'choice_ending', 'error' FROM documents WHERE n_chars % 5 <> 0 AND n_chars % 7 = 0"]))
def style_rules(v: Views) -> DataFrame:
    """Whole documents with a forbidden phrase behind most of them, and two claims each, of which one ends in a seventh of them wrongly."""
    phrase = F.try_element_at(F.array(*map(F.lit, quality.FORBIDDEN)), (F.col("n_chars") % 12 + 1).cast("int"))
    wording = F.concat("text", F.lit("\n"), F.coalesce(phrase, F.lit("")))
    claims = F.when(F.col("n_chars") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("lang", F.lit(" 크다. ")), F.concat("lang", F.when(F.col("n_chars") % 7 == 0, " 크다").otherwise(" 작다."))))
    return quality.check(v("documents"), ["doc_id"], quality.style_rules(wording, claims, F.contains("text", F.lit("the"))))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([lang, source], lambda x: NOT x IN ('en', 'src1'))), ',') AS missing FROM documents")
def cited_references(v: Views) -> DataFrame:
    """Documents that cite their language and source, the latter twice."""
    cited = F.concat("text", F.lit(" [ref:"), "lang", F.lit("][ref:"), "source", F.lit("] and [ref:"), "source", F.lit("]"))
    return v("documents").select("doc_id", F.array_join(F.array_sort(quality.cited_references(cited, F.array(F.lit("en"), F.lit("src1")))), ",").alias("missing"))


PANELS = """SELECT page AS item_id, CASE WHEN page % 7 = 0 AND box_id % 2 = 0 THEN box_id ELSE page END AS owner_id, k + CASE WHEN page % 3 = 0 THEN 1 ELSE 0 END AS idx, n + CASE WHEN page % 5 = 0 THEN k % 2 ELSE 0 END AS asset_count,
flag AS arrangement, x0, y0, x1, CASE WHEN box_id % 17 = 0 THEN y0 ELSE y1 END AS y1, (x1 - x0) * 4 AS width_px, (y1 - y0) * CASE WHEN page % 2 = 0 AND k = 1 THEN 4.5E0 ELSE 4.1E0 END AS height_px,
CASE WHEN page % 4 = 0 THEN '(가)' ELSE CASE k WHEN 1 THEN ' (가)' WHEN 2 THEN '(나)' WHEN 3 THEN '(다) ' END END AS caption, y1 + CASE WHEN page % 11 = 0 THEN -5 ELSE 5 END AS caption_y0, box_id AS recorded, CASE WHEN box_id % 13 = 0 THEN 0 ELSE box_id END AS observed
FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box_id) AS k, count(*) OVER (PARTITION BY page) AS n FROM {box}) b"""


@query(f"""WITH p AS ({PANELS}), g AS (SELECT item_id, count(*) AS n, min(idx) AS low, bool_and(asset_count = c) AS assets, bool_and(owner_id = item_id) AS own, count(DISTINCT arrangement) AS kinds, bool_and(x1 > x0 AND y1 > y0) AS positive,
  bool_and(CASE WHEN y1 > y0 THEN abs((width_px / height_px) / ((x1 - x0) / (y1 - y0)) - 1) <= 0.05::DOUBLE ELSE false END) AS shaped, bool_and(recorded = observed) AS same, string_agg(trim(caption), '|' ORDER BY idx) FILTER (WHERE idx <= 3) AS captions,
  count(*) FILTER (WHERE idx <= 3 AND y1 <= caption_y0) AS below FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS c FROM p) q GROUP BY 1)
SELECT item_id, 'panel_index' AS code, 'error' AS level FROM g WHERE low <> 1 UNION ALL SELECT item_id, 'panel_assets', 'error' FROM g WHERE NOT assets UNION ALL SELECT item_id, 'panel_owner', 'error' FROM g WHERE NOT own
UNION ALL SELECT item_id, 'panel_arrangement', 'error' FROM g WHERE kinds <> 1 UNION ALL SELECT item_id, 'panel_box', 'error' FROM g WHERE NOT positive UNION ALL SELECT item_id, 'panel_ratio', 'error' FROM g WHERE NOT shaped
UNION ALL SELECT item_id, 'panel_digest', 'error' FROM g WHERE NOT same UNION ALL SELECT item_id, 'panel_captions', 'error' FROM g WHERE n = 3 AND captions <> '(가)|(나)|(다)' UNION ALL SELECT item_id, 'panel_caption_place', 'error' FROM g WHERE n = 3 AND below < 3
UNION ALL SELECT DISTINCT a.item_id, 'panel_overlap', 'error' FROM p a JOIN p b ON a.item_id = b.item_id AND a.idx < b.idx AND b.idx <= 3 JOIN g ON g.item_id = a.item_id AND g.n = 3
  WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)""")
def panel_contract(v: Views) -> DataFrame:
    """Boxes as the panels of their page, with a fault of each kind in some of them."""
    return quality.panel_contract(v.sql(PANELS))


CHOICES = """SELECT set_id AS item_id, CASE WHEN item_id % 31 = 0 THEN item_id ELSE set_id END AS owner_id, ord, l_returnflag = 'R' AS needs_review, CASE WHEN l_linestatus = 'F' THEN l_returnflag || CAST(l_linenumber % 3 AS STRING) ELSE ' ' END AS reason,
item_id AS recorded, CASE WHEN item_id % 37 <> 0 THEN item_id END AS observed FROM {set_item}"""


@query(f"""WITH o AS ({CHOICES}), g AS (SELECT item_id, count(*) AS n, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS ords, bool_or(needs_review) AS review, bool_and(owner_id = item_id) AS own, count(*) = count(observed) AS same,
  coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason) FILTER (WHERE needs_review AND reason <> ' '), '') AS reasons FROM o GROUP BY 1)
SELECT item_id, 'choice_count' AS code, 'error' AS level, '' AS detail FROM g WHERE n <> 5 UNION ALL SELECT item_id, 'choice_order', 'error', '' FROM g WHERE ords <> '1,2,3,4,5' UNION ALL SELECT item_id, 'choice_owner', 'error', '' FROM g WHERE NOT own
UNION ALL SELECT item_id, 'choice_review', 'error', reasons FROM g WHERE review UNION ALL SELECT item_id, 'choice_digest', 'error', '' FROM g WHERE NOT same""")
def graphical_choice_contract(v: Views) -> DataFrame:
    return quality.graphical_choice_contract(v.sql(CHOICES))


@query("""WITH a AS (SELECT DISTINCT set_id AS item_id, l_returnflag AS kind, ord AS idx FROM {set_item} WHERE item_id % 3 <> 0), b AS (SELECT DISTINCT set_id AS item_id, l_returnflag AS kind, ord AS idx FROM {set_item} WHERE item_id % 4 <> 0)
SELECT item_id, kind, idx, 'slot without asset' AS issue FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT item_id, kind, idx, 'asset without slot' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y""")
def slot_count_match(v: Views) -> DataFrame:
    s = v("set_item").select(F.col("set_id").alias("i"), F.col("l_returnflag").alias("kind"), F.col("ord").alias("idx"), "item_id")
    one = lambda d: d.select(F.col("i").alias("item_id"), "kind", "idx").distinct()
    return quality.slot_count_match(one(s.where("item_id % 3 <> 0")), one(s.where("item_id % 4 <> 0")))


BLOCKS = """SELECT set_id AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'image' WHEN l_linenumber % 3 = 0 THEN 'table' ELSE 'text' END AS kind, ord % 3 AS page_no, nullif(set_id % 4, 0) AS expected_pages,
CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber % 3 = 0 THEN '< 보기 > ㄱ ㄴ' || CASE WHEN item_id % 2 = 0 THEN ' ㄷ' ELSE '' END ELSE l_linestatus || CASE WHEN item_id % 4 = 0 THEN ' ⑤' ELSE '' END END AS text FROM {set_item}"""


@query(f"""WITH b AS ({BLOCKS}), g AS (SELECT doc_id, coalesce(bool_or(kind = 'image'), false) AS images, coalesce(bool_or(kind = 'text'), false) AS texts, count(DISTINCT page_no) AS pages, max(expected_pages) AS expected,
  coalesce(bool_or(kind = 'table' AND contains(text, 'ㄷ')), false) AS claims, coalesce(bool_or(contains(text, '⑤')), false) AS fifth, coalesce(bool_or(contains(text, 'F')), false) AS f FROM b GROUP BY 1)
SELECT doc_id, 'images_only' AS code, 'error' AS level FROM g WHERE images AND NOT texts UNION ALL SELECT doc_id, 'no_text', 'error' FROM g WHERE NOT texts UNION ALL SELECT doc_id, 'page_count', 'error' FROM g WHERE pages <> expected
UNION ALL SELECT doc_id, 'no_box', 'error' FROM g WHERE NOT claims UNION ALL SELECT doc_id, 'claims_missing', 'error' FROM g WHERE NOT claims UNION ALL SELECT doc_id, 'fifth_choice', 'error' FROM g WHERE NOT fifth UNION ALL SELECT doc_id, 'required_0', 'error' FROM g WHERE NOT f""")
def block_contract(v: Views) -> DataFrame:
    return quality.block_contract(v.sql(BLOCKS), ["F"], box=True, claims=True, fifth=True)


@query("""SELECT q.id, CASE WHEN trim(q.answer) <> '' THEN q.answer ELSE coalesce(c.shown, '') END AS answer FROM {question} q
LEFT JOIN (SELECT question_id, string_agg(substr('①②③④⑤', CAST(ord AS INTEGER), 1), ' ' ORDER BY ord) AS shown FROM (SELECT DISTINCT question_id, ord FROM {choice} WHERE is_answer) GROUP BY 1) c ON c.question_id = q.id""")
def saved_answers(v: Views) -> DataFrame:
    """The saved answer, or the places of the choices that are marked."""
    marked = v("choice").where("is_answer").groupBy(F.col("question_id").alias("id")).agg(F.collect_set("ord").alias("ords"))
    return v("question").join(marked, "id", "left").select("id", bank.answer_text(F.col("answer"), F.col("ords")).alias("answer"))
