"""Items, choices, references and contracts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import items, layout
from lectern.plans.base import query
from lectern.plans.views import Views


@query("""WITH h AS (SELECT user_id AS context_id, event_id % 12 AS term_idx, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS tr, event_id % 7 AS hit_rank, event_id % 97 - 3 AS document_id, CAST(event_id % 5 AS INTEGER) AS page_no FROM events),
f AS (SELECT context_id, document_id, page_no, min((term_idx * 10 + tr) * 10 + hit_rank) AS pos FROM h WHERE term_idx < 10 AND hit_rank <= 5 AND document_id > 0 AND tr IS NOT NULL GROUP BY 1, 2, 3)
SELECT context_id, CAST(k AS INTEGER) AS place, document_id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY pos, document_id, page_no) AS k FROM f) x WHERE k <= 3""")
def auto_references(v: Views) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", items.TYPE_RANK[0]).when(F.col("event_type") == "click", items.TYPE_RANK[1]).when(F.col("event_type") == "purchase", items.TYPE_RANK[2]).otherwise("other")
    h = v("events").select(F.col("user_id").alias("context_id"), (F.col("event_id") % 12).alias("term_idx"), kind.alias("doc_type"), (F.col("event_id") % 7).alias("hit_rank"), (F.col("event_id") % 97 - 3).alias("document_id"), (F.col("event_id") % 5).cast("int").alias("page_no"))
    return items.auto_references(h)


@query("SELECT q.id AS ref_id, substr(d.text, 1, 6000) AS page_text, s.text AS standard_text, coalesce(n.n, 0) AS examples FROM {question} q LEFT JOIN documents d ON d.doc_id = q.id LEFT JOIN {standard} s ON s.code = q.standard_code LEFT JOIN (SELECT qtype, least(count(*), 3) AS n FROM {question} GROUP BY 1) n ON n.qtype = q.qtype")
def reference_bundle(v: Views) -> DataFrame:
    refs = v("question").select(F.col("id").alias("ref_id"), F.col("id").alias("document_id"), F.lit(1).alias("page_no"), F.col("standard_code").alias("code"), F.col("qtype").alias("frame_id"))
    pages = v("documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), F.col("text").alias("body"))
    examples = v("question").select(F.col("qtype").alias("frame_id"), F.col("id").alias("example_id"), F.col("title").alias("text"))
    got = items.reference_bundle(refs, pages, v("standard").select("code", "text", F.lit("").alias("unit_name")), examples)
    return got.select("ref_id", "page_text", "standard_text", F.greatest(F.coalesce(F.size("examples"), F.lit(0)), F.lit(0)).cast("long").alias("examples"))


@query("SELECT DISTINCT p_partkey * 3 AS item_id FROM part WHERE NOT p_partkey * 3 IN (SELECT p_partkey FROM part)")
def unknown_candidates(v: Views) -> DataFrame:
    g = v("part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("item_id"))
    return items.select_candidates(g, v("part").select((F.col("p_partkey") * 3).alias("item_id")))[1]


@query("""WITH q AS (SELECT d.id, d.ask, d.passage, (SELECT count(*) FROM {claim} c WHERE c.id = d.id) AS claims, (SELECT count(*) FROM {talk_line} t WHERE t.id = d.id) AS turns, (SELECT min(size) FROM {talk_line} t WHERE t.id = d.id) AS least FROM {draft} d)
SELECT id AS item_id, code, 'error' AS level FROM (SELECT id, unnest([CASE WHEN least % 10 <> turns THEN 'number_mismatch' END, CASE WHEN passage IS NULL OR trim(passage) = '' THEN 'stem_missing' END, CASE WHEN turns <> 5 THEN 'choices' END,
CASE WHEN claims NOT IN (0, 3) THEN 'claims' END, CASE WHEN ask IS NULL OR NOT contains(ask, '?') THEN 'asks' END]) AS code FROM q) x WHERE code IS NOT NULL""")
def structure_contract(v: Views) -> DataFrame:
    """Drafts read as items: the choices are their turns, the number what the shortest turn's length ends with."""
    turns = v("talk_line").groupBy("id").agg(F.array_sort(F.collect_list(F.col("turn") + 1)).alias("choice_ords"), F.count("*").alias("number"), (F.min("size") % 10).alias("parsed_number"))
    claims = v("claim").groupBy("id").agg(F.collect_list("text").alias("claims"))
    d = v("draft").select("id", F.col("passage").alias("stem"), (F.length("ask") - F.length(F.replace("ask", F.lit("?"), F.lit("")))).alias("asks"))
    return items.structure_contract(d.join(turns, "id").join(claims, "id", "left").withColumnRenamed("id", "item_id"))


@query("""WITH q AS (SELECT id, string_agg(substr('①②③④⑤', turn + 1, 1) || ' ' || word, ' ' ORDER BY turn) FILTER (WHERE turn < 5) AS body, count(*) AS n, max(CASE WHEN turn = 0 THEN size % 3 END) AS kind, max(CASE WHEN turn = 4 THEN word END) AS fifth, max(CASE WHEN turn = 0 THEN size % 20 END) AS shown FROM {talk_line} GROUP BY 1)
SELECT id AS item_id, code, 'error' AS level FROM (SELECT id, unnest([CASE WHEN n < 5 THEN 'choice_marks' END, CASE WHEN kind = 0 THEN 'claim_box' END, CASE WHEN kind < 2 THEN 'claims' END, CASE WHEN shown <> n THEN 'other_leader' END]) AS code FROM q) x WHERE code IS NOT NULL""")
def generated_contract(v: Views) -> DataFrame:
    """Items made of a conversation's first words: some need claims and have a box without them, some have neither."""
    t = v("talk_line")
    mark = F.substring(F.lit("①②③④⑤"), F.col("turn") + 1, F.lit(1))
    first = lambda c: F.max(F.when(F.col("turn") == 0, c))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") < 5, F.struct("turn", F.concat(mark, F.lit(" "), "word").alias("w"))))), lambda x: x.w), " ")
    q = t.groupBy("id").agg(body.alias("body"), F.count("*").alias("number"), first(F.col("size") % 3).alias("kind"), F.max(F.when(F.col("turn") == 4, F.col("word"))).alias("fifth_choice"), first(F.col("size") % 20).alias("shown"))
    text = F.concat(F.col("shown").cast("string"), F.lit(". 발문 "), F.when(F.col("kind") > 0, "<보기> ").otherwise(""), "body")
    return items.generated_contract(q.select(F.col("id").alias("item_id"), "number", text.alias("text"), (F.col("kind") < 2).alias("needs_claims"), "fifth_choice"))


@query("""SELECT page AS item_id, CASE WHEN (x0 >= 300 OR x1 <= 0) AND least(y1, 100) > greatest(y0, 0) THEN 'side_by_side' WHEN y0 >= 700 THEN 'after_ask' WHEN y0 >= 100 AND y1 <= 650 THEN 'between' ELSE 'before' END AS placement
FROM (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {box} GROUP BY 1) b""")
def figure_placement(v: Views) -> DataFrame:
    fixed = {"s_x0": 0.0, "s_y0": 0.0, "s_x1": 300.0, "s_y1": 100.0, "a_y0": 650.0, "a_y1": 700.0}
    return items.figure_placement(v("box").withColumnRenamed("page", "item_id").withColumns({c: F.lit(x) for c, x in fixed.items()}))


@query("""SELECT page AS item_id, count(*) AS n, CASE WHEN count(*) = 1 THEN CASE WHEN max(x1 - x0) <= 168 THEN 'one_small' ELSE 'one_large' END WHEN count(*) = 2 THEN CASE WHEN min(flag) = 'A' AND sum(x1 - x0) <= 92.53::DOUBLE THEN 'two_small' ELSE 'two_large' END
WHEN count(*) = 3 THEN 'three' ELSE 'many' END AS layout FROM {box} GROUP BY 1""")
def layout_class(v: Views) -> DataFrame:
    kind = F.when(F.col("flag") == "A", "horizontal").otherwise("vertical")
    return items.layout_class(v("box").select(F.col("page").alias("item_id"), (F.col("x1") - F.col("x0")).alias("width"), kind.alias("arrangement"), F.lit(0.8).alias("scale")))


@query("""WITH p AS (SELECT page, box_id AS panel_id, x0, y0, x1, y1 FROM {box} WHERE flag <> 'R'), l AS (SELECT page, box_id AS label_id, (x0 + x1) / 2 AS lx, (y0 + y1) / 2 AS ly FROM {box} WHERE flag = 'R'),
n AS (SELECT p.page, panel_id, label_id, abs(lx - (x0 + x1) / 2) AS d, CASE WHEN lx BETWEEN x0 AND x1 AND ly BETWEEN y1 - 2 AND y1 + 28 THEN 0 WHEN (lx BETWEEN x0 AND x1 AND ly BETWEEN y0 - 28 AND y0 + 2) OR (ly BETWEEN y0 AND y1 AND lx BETWEEN x0 - 28 AND x0 + 2) THEN 1 END AS band FROM p JOIN l ON l.page = p.page),
b AS (SELECT *, row_number() OVER (PARTITION BY page, panel_id ORDER BY band, d, label_id) AS k FROM n WHERE band IS NOT NULL), o AS (SELECT *, count(*) OVER (PARTITION BY page, label_id) AS users FROM b WHERE k = 1),
w AS (SELECT o.page FROM o JOIN (SELECT page, count(*) AS need FROM p GROUP BY 1) q ON q.page = o.page WHERE users = 1 GROUP BY o.page, need HAVING count(*) = need)
SELECT o.page AS item_id, panel_id, label_id FROM o JOIN w ON w.page = o.page""")
def caption_for_panel(v: Views) -> DataFrame:
    b = v("box")
    panels = b.where("flag <> 'R'").select(F.col("page").alias("item_id"), F.col("box_id").alias("panel_id"), *layout.SIDES)
    labels = b.where("flag = 'R'").select(F.col("page").alias("item_id"), F.col("box_id").alias("label_id"), ((F.col("x0") + F.col("x1")) / 2).alias("lx"), ((F.col("y0") + F.col("y1")) / 2).alias("ly"))
    return items.caption_for_panel(panels, labels)


@query("""WITH w AS (SELECT page, box_id, flag, x0, y0, CAST(row_number() OVER (PARTITION BY page ORDER BY box_id) AS INTEGER) AS place FROM {box}),
m AS (SELECT w.*, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, place) > 12 THEN 1 ELSE 0 END AS fresh FROM w WHERE place <= 5 AND page IN (SELECT page FROM w WHERE place = 5)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y0, place ROWS UNBOUNDED PRECEDING) AS island FROM m), r AS (SELECT page, place, x0 AS mx, avg(y0) OVER (PARTITION BY page, island) AS row_y FROM i),
n AS (SELECT w.*, r.place AS no, row_number() OVER (PARTITION BY w.page, w.box_id ORDER BY abs(w.y0 - row_y), mx DESC, r.place) AS k FROM w JOIN r ON r.page = w.page AND mx <= w.x0 WHERE w.place > 5)
SELECT page, no, string_agg(flag, ' ' ORDER BY y0, x0, box_id) AS choice FROM n WHERE k = 1 GROUP BY 1, 2""")
def choice_texts(v: Views) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("page").orderBy("box_id"))
    marks = F.array(*map(F.lit, items.CHOICE_MARKS))
    w = v("box").withColumn("at", at)
    word = F.when(F.col("at") <= 5, F.try_element_at(marks, F.col("at"))).otherwise(F.col("flag"))
    return items.choice_texts(w.select("page", F.col("box_id").alias("word_id"), word.alias("text"), "x0", "y0"), ["page"])


@query("""WITH m AS (SELECT DISTINCT page AS doc_id, 1 AS page_no, CAST(box_id % 40 AS INTEGER) AS number, x0, y0 FROM {box} WHERE y0 BETWEEN 40 AND 1150)
SELECT * FROM m WHERE EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND abs(o.x0 - m.x0) <= 40 AND NOT (o.x0 = m.x0 AND o.y0 = m.y0))""")
def generated_marks(v: Views) -> DataFrame:
    b = v("box").select(F.col("page").alias("doc_id"), F.lit(1).alias("page_no"), F.col("box_id").alias("block"), F.lit(0).alias("word_no"), F.concat((F.col("box_id") % 40).cast("string"), F.lit(".")).alias("text"), "x0", "y0")
    return items.generated_marks(b)


@query("""WITH l AS (SELECT conv_id AS doc_id, turn, text, max(CASE WHEN turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM conversations)
SELECT doc_id, CAST(item AS INTEGER) AS item, string_agg(text, chr(10) ORDER BY turn) AS text FROM l WHERE item IS NOT NULL GROUP BY 1, 2""")
def continuation_text(v: Views) -> DataFrame:
    c = v("conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("page_no"), F.floor(F.col("turn") % 4 / 2).alias("col"), F.col("turn").cast("double").alias("y"), "text", "turn")
    return items.continuation_text(c, c.where("turn % 3 = 0").withColumn("number", F.col("turn")))


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY page) AS on_page FROM {box} WHERE y1 - y0 >= 15 AND x1 - x0 >= 10),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY x0, y0 ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, y0) > 30 THEN 1 ELSE 0 END AS fresh FROM n WHERE on_page >= 2)),
l AS (SELECT *, min(x0) OVER (PARTITION BY page, col) AS edge FROM g)
SELECT page AS doc_id, 1 AS page_no, CAST(col AS BIGINT) AS col, CAST(box_id % 50 AS INTEGER) AS number, x0, y0 FROM l WHERE x0 - edge <= 15""")
def segment_textbook_items(v: Views) -> DataFrame:
    b = v("box").select(F.col("page").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("box_id") % 50).cast("string").alias("text"), *layout.SIDES, F.lit(False).alias("is_answer_head"))
    return items.segment_textbook_items(b)
