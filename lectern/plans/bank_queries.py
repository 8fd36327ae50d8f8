"""Item-bank queries: filters, joins, counts, reports and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import windows
from lectern.operators import bank
from lectern.plans.base import query
from lectern.plans.views import Views


@query("SELECT id, text, unit_no FROM {proposition} WHERE unit_no = 3 AND standard_code = 'Brand#5' AND text ILIKE '%00%' ORDER BY id DESC")
def filter_propositions(v: Views) -> DataFrame:
    return bank.filter_propositions(v("proposition"), "Brand#5", 3, "00").select("id", "text", "unit_no")


@query("SELECT id, title FROM {question} WHERE title ILIKE '%ring%' OR standard_code ILIKE '%ring%' OR CAST(id AS VARCHAR) ILIKE '%ring%'")
def search_any(v: Views) -> DataFrame:
    return bank.search_any(v("question"), "RING", ["title", "standard_code", "id"]).select("id", "title")


@query("SELECT s.code, s.text, s.unit_no, u.name AS unit_name FROM {standard} s LEFT JOIN {unit} u ON s.unit_no = u.unit_no WHERE s.unit_no = 2 ORDER BY s.unit_no, seq")
def list_standards(v: Views) -> DataFrame:
    return bank.list_standards(v("standard"), v("unit"), 2).select("code", "text", "unit_no", "unit_name")


@query("""SELECT u.unit_no, u.name, string_agg(s.code, ',' ORDER BY s.seq, s.code) AS codes FROM {unit} u JOIN {standard} s ON u.unit_no = s.unit_no
WHERE contains(lower(u.name), 'asia') OR contains(lower(s.code), 'asia') OR contains(lower(s.text), 'ring') GROUP BY 1, 2 HAVING true""".replace("lower(s.text), 'ring'", "lower(s.text), 'asia'"))
def tree_filter(v: Views) -> DataFrame:
    t = bank.tree_filter(v("unit"), v("standard"), "ASIA")
    return t.select("unit_no", "name", F.array_join(F.transform("standards", lambda s: s.code), ",").alias("codes"))


SCOPE = "SELECT code FROM {standard} WHERE unit_no IN (1, 2)"


@query("SELECT id FROM {question} WHERE standard_code IN (" + SCOPE + ") OR standard_code = ''")
def scope_filter(v: Views) -> DataFrame:
    return bank.scope_filter(v("question"), v("standard").where("unit_no in (1, 2)")).select("id")


@query("SELECT count(*) AS hidden FROM {question} WHERE standard_code <> '' AND NOT standard_code IN (" + SCOPE + ")")
def hidden_by_scope(v: Views) -> DataFrame:
    return bank.hidden_by_scope(v("question"), v("standard").where("unit_no in (1, 2)"))


@query("SELECT item_id, round_even(coalesce(points, default_points), 1) AS report, coalesce(points, default_points) AS dashboard, CASE WHEN points <> 0 THEN points ELSE default_points END AS checked FROM {item}")
def effective_points(v: Views) -> DataFrame:
    p, d = F.col("points"), F.col("default_points")
    return v("item").select("item_id", *(bank.effective_points(p, d, m).alias(n) for m, n in (("report", "report"), ("dashboard", "dashboard"), ("check", "checked"))))


@query("SELECT id, CASE WHEN trim(regexp_replace(title, '^(small|large) ', '')) <> '' THEN substr(trim(regexp_replace(title, '^(small|large) ', '')), 1, 28) ELSE CAST(id AS VARCHAR) END AS auto_title FROM {question}")
def auto_title(v: Views) -> DataFrame:
    return v("question").select("id", bank.auto_title([F.col("title"), F.col("ask")], F.col("id").cast("string"), ["^(small|large) "]).alias("auto_title"))


@query("SELECT item_id, CASE WHEN l_returnflag = 'R' AND l_linestatus <> '' THEN l_linestatus || '_' || lpad(CAST(ord AS VARCHAR), 2, '0') END AS figure FROM {set_item}")
def figure_name(v: Views) -> DataFrame:
    return v("set_item").select("item_id", bank.figure_name(F.col("l_linestatus"), F.col("ord"), F.col("l_returnflag") == "R").alias("figure"))


@query("SELECT id, 'title' AS field FROM {question} WHERE id % 50 = 0")
def reject_object_literal(v: Views) -> DataFrame:
    q = v("question").withColumn("title", F.when(F.col("id") % 50 == 0, " [Object object] ").otherwise(F.col("title")))
    return bank.reject_object_literal(q, "id", ["title", "ask"])


@query("""SELECT id, id % 4 = 0 OR id % 50 = 1 AS changed,
CASE WHEN id % 50 = 1 OR id % 12 = 8 THEN '' WHEN id % 4 = 0 THEN 'text ' || id ELSE title END AS title,
CASE WHEN id % 8 = 0 THEN translate('<' || CASE WHEN id % 3 = 0 THEN '"ask":<"frame_id":"A">,' ELSE '' END || '"title":<"frame_id":"F' || id % 5 || '","sources":[' || CASE WHEN id % 12 <> 4 THEN CAST(id % 7 AS VARCHAR) ELSE '' END || ']>>', '<>', chr(123) || chr(125))
WHEN id % 3 = 0 THEN translate('<"ask":<"frame_id":"A">>', '<>', chr(123) || chr(125)) END AS meta FROM {question}""")
def unwrap_text_envelope(v: Views) -> DataFrame:
    """Titles, a fourth of them in envelopes with and without a text, a frame and sources; meta of another field is there already in a third."""
    i = F.col("id")
    text = F.when(i % 12 != 8, F.concat(F.lit("text "), i.cast("string")))
    frame = F.when(i % 8 == 0, F.concat(F.lit("F"), (i % 5).cast("string"))).otherwise("")
    wrapped = F.to_json(F.struct(text.alias("text"), frame.alias("frame_id"), F.when(i % 12 == 0, F.array(i % 7)).alias("style_sources"), F.when(i % 12 == 8, F.array(i % 7)).alias("sources")))
    title = F.when(i % 50 == 1, " [Object object]").when(i % 4 == 0, wrapped).otherwise(F.col("title"))
    q = v("question").select("id", title.alias("title"), F.when(i % 3 == 0, '{"ask":{"frame_id":"A"}}').alias("meta"))
    return bank.unwrap_text_envelope(q, "title", "meta").select("id", "changed", "title", "meta")


NESTED = "n AS (SELECT question_id, string_agg(text, '|' ORDER BY ord, choice_id) AS texts, count(*) AS n FROM {choice} GROUP BY 1)"


@query("WITH " + NESTED + " SELECT i.item_id, i.title, n.texts FROM {item} i LEFT JOIN n ON n.question_id = i.question_id")
def set_items(v: Views) -> DataFrame:
    s = bank.set_items(v("set_item"), v("question"), v("choice"))
    return s.select("item_id", "title", F.array_join(F.transform("choices", lambda c: c.text), "|").alias("texts"))


@query("SELECT s.item_id, q.title, q.qtype FROM (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE question_id END AS question_id FROM {set_item}) s LEFT JOIN {question} q ON s.question_id = q.id")
def blueprint_slots(v: Views) -> DataFrame:
    return bank.blueprint_slots(slots(v), v("question")).select("item_id", "title", "qtype")


def slots(v: Views) -> DataFrame:
    return v("set_item").withColumn("question_id", F.when(F.col("item_id") % 5 != 0, F.col("question_id")))


@query("SELECT id FROM {question} WHERE NOT id IN (SELECT question_id FROM {set_item} WHERE set_id = 7)")
def pickable_questions(v: Views) -> DataFrame:
    return bank.pickable_questions(v("question"), v("set_item"), 7).select("id")


@query("WITH " + NESTED + " SELECT q.id, coalesce(n.n, 0) AS n_choices, n.texts AS choice_texts FROM {question} q LEFT JOIN n ON n.question_id = q.id")
def questions_with_choices(v: Views) -> DataFrame:
    return bank.questions_with_choices(v("question"), v("choice")).select("id", "n_choices", "choice_texts")


@query("""SELECT p.id AS proposition_id, u.name AS unit_name, s.text AS standard_text, coalesce(a.n, 0) AS variants, coalesce(b.n, 0) AS evidence FROM {proposition} p LEFT JOIN {unit} u ON p.unit_no = u.unit_no LEFT JOIN {standard} s ON p.standard_code = s.code
LEFT JOIN (SELECT proposition_id, count(*) AS n FROM {variant} GROUP BY 1) a ON a.proposition_id = p.id LEFT JOIN (SELECT proposition_id, count(*) AS n FROM {evidence} GROUP BY 1) b ON b.proposition_id = p.id""")
def proposition_detail(v: Views) -> DataFrame:
    d = bank.proposition_detail(v("proposition"), v("unit"), v("standard"), v("variant"), v("evidence"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("proposition_id", "unit_name", "standard_text", F.greatest(n("variants"), F.lit(0)).alias("variants"), F.greatest(n("evidence"), F.lit(0)).alias("evidence"))


@query("""SELECT p.id AS proposition_id, coalesce(b.n, 0) AS n_evidence, coalesce(a.n, 0) AS n_variants FROM {proposition} p
LEFT JOIN (SELECT proposition_id, count(*) AS n FROM {variant} GROUP BY 1) a ON a.proposition_id = p.id LEFT JOIN (SELECT proposition_id, count(*) AS n FROM {evidence} GROUP BY 1) b ON b.proposition_id = p.id""")
def child_counts(v: Views) -> DataFrame:
    p = v("proposition").select(F.col("id").alias("proposition_id"))
    return bank.child_counts(p, "proposition_id", {"n_evidence": v("evidence"), "n_variants": v("variant")})


@query("SELECT (SELECT count(*) FROM {evidence}) AS n_evidence, (SELECT count(*) FROM {variant}) AS n_variants")
def proposition_footer(v: Views) -> DataFrame:
    return child_counts(v).agg(F.sum("n_evidence").alias("n_evidence"), F.sum("n_variants").alias("n_variants"))


@query("""SELECT set_id, round(total_points, 1) AS total_points, n_high, n_middle, n_low, n_other, standards, n_items, 100.0::DOUBLE AS target, round(100.0::DOUBLE - total_points, 1) AS gap FROM (
SELECT set_id, sum(coalesce(points, default_points)) AS total_points, count(*) FILTER (WHERE difficulty = '상') AS n_high, count(*) FILTER (WHERE difficulty = '중') AS n_middle,
count(*) FILTER (WHERE difficulty = '하') AS n_low, count(*) FILTER (WHERE difficulty NOT IN ('상', '중', '하')) AS n_other, coalesce(string_agg(DISTINCT CASE WHEN standard_code <> '' THEN standard_code END, ',' ORDER BY CASE WHEN standard_code <> '' THEN standard_code END), '') AS standards, count(*) AS n_items FROM {item} GROUP BY 1) x""")
def set_dashboard(v: Views) -> DataFrame:
    return bank.set_dashboard(v("item"))


@query("SELECT status, count(*) AS n FROM {question} GROUP BY 1")
def status_cards(v: Views) -> DataFrame:
    return bank.status_cards(v("question"))


def _counts(col: str, values: tuple[str, ...], prefix: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {col} = '{x}') AS {prefix}_{i}" for i, x in enumerate(values))


@query("SELECT set_id, count(*) AS n_items, " + _counts("difficulty", ("상", "중", "하"), "difficulty") + ", " + _counts("behavior", bank.BEHAVIORS, "behavior") + ", count(*) FILTER (WHERE behavior = '') AS behavior_none, "
       + _counts("origin", bank.ORIGINS, "origin") + ", count(*) FILTER (WHERE NOT origin IN ('직접', 'AI초안', '기출변형', '기출복원')) AS origin_none, sum(coalesce(points, default_points)) AS total_points FROM {item} GROUP BY 1")
def spec_summary(v: Views) -> DataFrame:
    return bank.spec_summary(v("item"))


@query("SELECT set_id, count(*) AS slots, count(*) FILTER (WHERE item_id % 5 = 0) AS empty_slots, count(*) FILTER (WHERE l_returnflag = 'R') AS pending_figures, sum(coalesce(points, 0)) AS planned_points FROM {set_item} GROUP BY 1")
def planned_totals(v: Views) -> DataFrame:
    return bank.planned_totals(slots(v).withColumn("needs_figure", F.col("l_returnflag") == "R"))


@query("""WITH one AS (SELECT question_id, min(ord) AS ord FROM {choice} WHERE is_answer GROUP BY 1 HAVING count(*) = 1)
SELECT s.set_id, one.ord, count(*) AS n FROM {set_item} s JOIN one ON one.question_id = s.question_id GROUP BY 1, 2""")
def answer_position_counts(v: Views) -> DataFrame:
    return bank.answer_position_counts(v("choice"), v("set_item"))


@query("""SELECT set_id, proposition_id, count(*) AS n, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) AS questions FROM (
SELECT DISTINCT s.set_id, s.question_id, c.proposition_id FROM {set_item} s JOIN {choice} c ON s.question_id = c.question_id) x GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_usage(v: Views) -> DataFrame:
    return bank.duplicate_usage(v("set_item"), v("choice"))


@query("SELECT u.unit_no, u.name, coalesce(string_agg(s.code, ',' ORDER BY s.seq, s.code), '') AS codes FROM {unit} u LEFT JOIN {standard} s ON s.unit_no = u.unit_no GROUP BY 1, 2")
def standards_tree(v: Views) -> DataFrame:
    return bank.standards_tree(v("unit"), v("standard")).select("unit_no", "name", F.coalesce(F.array_join(F.transform("standards", lambda s: s.code), ","), F.lit("")).alias("codes"))


@query("""SELECT s.subject_id, coalesce(a.n, 0) AS n_units, coalesce(b.n, 0) AS n_standards FROM {subject} s LEFT JOIN (SELECT subject_id, count(*) AS n FROM {unit} GROUP BY 1) a ON a.subject_id = s.subject_id
LEFT JOIN (SELECT unit_no % 2 AS subject_id, count(*) AS n FROM {standard} GROUP BY 1) b ON b.subject_id = s.subject_id""")
def subject_counts(v: Views) -> DataFrame:
    return bank.subject_counts(v("subject"), v("unit"), v("standard").withColumn("subject_id", F.col("unit_no") % 2))


def _sorted(name: str, key: str, direction: str, order: str) -> None:
    sql = f"SELECT id, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place FROM {{question}} ORDER BY place LIMIT 50"

    def run(v: Views) -> DataFrame:
        top = bank.sort_questions(v("question").withColumns({c: F.lit(0) for c in ("error_count", "warn_count", "usage_count")}), key, direction).limit(50)
        ids = top.agg(F.collect_list("id").alias("ids"))  # fifty rows, a top-k report
        return ids.select(F.posexplode("ids").alias("at", "id")).select("id", (F.col("at") + 1).alias("place"))

    run.__name__ = name
    query(sql)(run)


_sorted("sort_questions_status", "status", "asc", "CASE status WHEN '초안' THEN 0 WHEN '검토중' THEN 1 WHEN '완성' THEN 2 ELSE -1 END, id")
_sorted("sort_questions_difficulty", "difficulty", "desc", "CASE difficulty WHEN '하' THEN 0 WHEN '중' THEN 1 WHEN '상' THEN 2 ELSE -1 END DESC, id DESC")
_sorted("sort_questions_created", "unknown", "desc", "created_at DESC, id DESC")
_sorted("sort_questions_points", "points", "asc", "default_points, id")

NUM = "CASE WHEN pts = floor(pts) THEN CAST(CAST(pts AS BIGINT) AS VARCHAR) ELSE CAST(pts AS VARCHAR) END"


@query("""WITH a AS (SELECT question_id, string_agg(substr('①②③④⑤', ord, 1), ' ' ORDER BY ord) AS marks FROM {choice} WHERE is_answer GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ord, item_id) AS no, round_even(coalesce(points, default_points), 1) AS pts FROM {item})
SELECT set_id, CAST(no AS INTEGER) AS no, i.question_id, CASE WHEN trim(answer) <> '' THEN trim(answer) ELSE coalesce(marks, '') END AS answer, """ + NUM + " AS points, qtype, difficulty FROM i LEFT JOIN a ON a.question_id = i.question_id")
def answer_key(v: Views) -> DataFrame:
    return bank.answer_key(bank.set_items(v("set_item"), v("question"), v("choice")))


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ord, item_id) AS no, round_even(coalesce(points, default_points), 1) AS pts FROM {item}),
u AS (SELECT s.code, n.name FROM {standard} s JOIN {unit} n ON s.unit_no = n.unit_no)
SELECT set_id, CAST(no AS INTEGER) AS no, coalesce(u.name, '') AS unit_name, standard_code, behavior, difficulty, """ + NUM + " AS points, qtype, origin FROM i LEFT JOIN u ON u.code = i.standard_code")
def spec_table(v: Views) -> DataFrame:
    units = v("standard").join(v("unit").select("unit_no", F.col("name").alias("unit_name")), "unit_no")
    return bank.spec_table(v("item"), units)


@query("""WITH a AS (SELECT set_id, question_id AS id, count(*) AS have FROM {set_item} GROUP BY 1, 2), b AS (SELECT set_id, question_id AS id, count(*) AS asked FROM {set_item} WHERE item_id % 7 <> 0 GROUP BY 1, 2)
SELECT a.set_id, a.id, have, coalesce(asked, 0) AS asked FROM a LEFT JOIN b ON a.set_id = b.set_id AND a.id = b.id WHERE have <> coalesce(asked, 0) OR coalesce(asked, 0) > 1""")
def permutation_check(v: Views) -> DataFrame:
    s = v("set_item").select("set_id", F.col("question_id").alias("id"), "item_id")
    return bank.permutation_check(s, s.where("item_id % 7 <> 0"))


@query("SELECT set_id, item_id AS id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY item_id DESC) AS INTEGER) AS ord FROM {set_item}")
def reorder(v: Views) -> DataFrame:
    s = v("set_item").select("set_id", F.col("item_id").alias("id"), "ord")
    lists = s.groupBy("set_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))
    return bank.reorder(s, lists).select("set_id", "id", "ord")


@query("""WITH d AS (SELECT l_partkey AS number, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT p_partkey AS number FROM part WHERE p_partkey % 7 = 0)
SELECT e.number, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' ELSE 'duplicate' END AS kind, coalesce(n, 0) AS n FROM e LEFT JOIN d ON d.number = e.number WHERE coalesce(n, 0) <> 1""")
def duplicate_missing(v: Views) -> DataFrame:
    return bank.duplicate_missing(v("part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("number")), v("lineitem").select(F.col("l_partkey").alias("number")))


@query("SELECT p_name AS name, 'missing' AS issue FROM (SELECT p_name FROM part WHERE p_partkey % 3 = 0 EXCEPT ALL SELECT p_name FROM part WHERE p_partkey % 2 = 0) a UNION ALL SELECT p_name, 'unexpected' FROM (SELECT p_name FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_name FROM part WHERE p_partkey % 3 = 0) b")
def expected_exact_set(v: Views) -> DataFrame:
    p = v("part").select(F.col("p_name").alias("name"), "p_partkey")
    return bank.expected_exact_set(p.where("p_partkey % 3 = 0").select("name"), p.where("p_partkey % 2 = 0").select("name"))


@query("SELECT set_id, question_id, min(item_id) AS first_at FROM {set_item} GROUP BY 1, 2")
def ordered_distinct(v: Views) -> DataFrame:
    return bank.ordered_distinct(v("set_item"), ["set_id"], "question_id", "item_id")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) a
FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.quality <> b.quality OR a.toxic <> b.toxic""")
def row_diff(v: Views) -> DataFrame:
    lab = v("labels")
    after = lab.where("doc_id % 4 <> 0").withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("quality")))
    return bank.row_diff(lab.where("doc_id % 5 <> 0"), after, ["doc_id"], ["quality", "toxic"])


@query("SELECT DISTINCT source, status FROM {labelled} WHERE status <> 'ready'")
def merge_failures(v: Views) -> DataFrame:
    lab = v("labelled").select("source", "status")
    return bank.merge_failures(lab.where("status = 'failure'"), lab.where("status in ('manual', 'queued')"), ["source", "status"])


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(trim(b.note), ''), a.note, '') AS note FROM (SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey END AS k, min(s_name) AS note FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) a
FULL OUTER JOIN (SELECT CASE WHEN s_suppkey % 15 = 0 THEN NULL ELSE s_suppkey END AS k, max(CASE WHEN s_suppkey % 6 = 0 THEN ' ' ELSE 'note' END) AS note FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) b ON coalesce(a.k, -1) = coalesce(b.k, -1)""")
def exam_ref_upsert(v: Views) -> DataFrame:
    s = v("supplier")
    a = s.where("s_suppkey % 2 = 0").groupBy(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey")).alias("k")).agg(F.min("s_name").alias("note"))
    b = s.where("s_suppkey % 3 = 0").groupBy(F.when(F.col("s_suppkey") % 15 != 0, F.col("s_suppkey")).alias("k")).agg(F.max(F.when(F.col("s_suppkey") % 6 == 0, " ").otherwise("note")).alias("note"))
    return bank.exam_ref_upsert(a, b, ["k"])


@query("SELECT 'orders' AS part, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'parent', c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def cascade_delete(v: Views) -> DataFrame:
    """The rows that stay when the customers of a segment go with their orders."""
    c = v("customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"), "c_mktsegment")
    o = v("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    left = bank.cascade_delete(c, c.where("c_mktsegment = 'BUILDING'"), "k", {"orders": o})
    return reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("part"), "id") for n, d in left.items()))


@query("SELECT id, CASE WHEN id % 3 = 2 AND id % 5 = 0 THEN '초안' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'title' ELSE '' END AS flags FROM {question}")
def change_status(v: Views) -> DataFrame:
    q = v("question")
    return bank.change_status(q, q.withColumn("title", F.when(F.col("id") % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))), "id", ["title", "ask"])


@query("""WITH p AS (SELECT l_partkey AS draft_id, item_id AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'status' ELSE 'difficulty' END AS field, CASE l_returnflag WHEN 'R' THEN '완성' WHEN 'A' THEN '상' ELSE 'bad' END AS value FROM (SELECT question_id AS l_partkey, item_id, l_linenumber, l_returnflag FROM {set_item}) s),
a AS (SELECT draft_id, arg_max(value, seq) FILTER (WHERE field = 'status' AND value = '완성') AS status, arg_max(value, seq) FILTER (WHERE field = 'difficulty' AND value = '상') AS difficulty FROM p GROUP BY 1)
SELECT q.id AS draft_id, coalesce(a.status, q.status) AS status, coalesce(a.difficulty, q.difficulty) AS difficulty FROM {question} q LEFT JOIN a ON a.draft_id = q.id""")
def apply_proposals(v: Views) -> DataFrame:
    drafts = v("question").select(F.col("id").alias("draft_id"), "status", "difficulty")
    value = F.when(F.col("l_returnflag") == "R", "완성").when(F.col("l_returnflag") == "A", "상").otherwise("bad")
    props = v("set_item").select(F.col("question_id").alias("draft_id"), F.col("item_id").alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, "status").otherwise("difficulty").alias("field"), value.alias("value"))
    return bank.apply_proposals(drafts, props, {"status": F.col("value").isin(*bank.STATUS_RANK), "difficulty": F.col("value").isin(*bank.DIFFICULTY_RANK)})


@query("""SELECT s.set_id, s.ord, s.item_id % 3000 AS question_id, CASE WHEN s.ord > 5 THEN 'no_slot' WHEN s.item_id % 5 <> 0 THEN 'slot_taken' WHEN q.id IS NULL THEN 'no_question' ELSE 'accepted' END AS outcome
FROM (SELECT set_id, ord, min(item_id) AS item_id FROM {set_item} GROUP BY 1, 2) s LEFT JOIN {question} q ON q.id = s.item_id % 3000""")
def attach_to_slot(v: Views) -> DataFrame:
    one = v("set_item").groupBy("set_id", "ord").agg(F.min("item_id").alias("item_id"))
    held = one.where("ord <= 5").select("set_id", "ord", F.when(F.col("item_id") % 5 != 0, F.col("item_id")).alias("question_id"))
    return bank.attach_to_slot(held, one.select("set_id", "ord", (F.col("item_id") % 3000).alias("question_id")), v("question"))


@query("SELECT l_orderkey AS k, string_agg(l_linestatus || l_returnflag, ' ' ORDER BY item_id) AS texts FROM (SELECT set_id AS l_orderkey, item_id, l_linestatus, l_returnflag FROM {set_item}) s GROUP BY 1")
def group_concat_text(v: Views) -> DataFrame:
    return bank.group_concat_text(v("set_item").select(F.col("set_id").alias("k"), "item_id", F.concat("l_linestatus", "l_returnflag").alias("t")), "k", "item_id", "t")


@query("SELECT set_id, item_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY ord, item_id) AS INTEGER) AS ord FROM {set_item}")
def renumber(v: Views) -> DataFrame:
    return windows.renumber(v("set_item").select("set_id", "item_id", "ord"), ["set_id"], [F.col("ord"), F.col("item_id")])


@query("SELECT set_id, max(ord) + 1 AS next_ord FROM {set_item} GROUP BY 1")
def next_ord(v: Views) -> DataFrame:
    return windows.next_ord(v("set_item"), ["set_id"])


@query("SELECT item_id FROM (SELECT item_id, q, row_number() OVER (PARTITION BY set_id, q ORDER BY item_id) AS k FROM (SELECT item_id, set_id, CASE WHEN item_id % 5 <> 0 THEN question_id END AS q FROM {set_item}) s) x WHERE k = 1 OR q IS NULL")
def keep_first(v: Views) -> DataFrame:
    return windows.keep_first(slots(v), ["set_id", "question_id"], ["item_id"]).select("item_id")
