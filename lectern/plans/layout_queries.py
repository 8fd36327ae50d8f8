"""Geometry, lineage, job state and streams over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import windows
from lectern.operators import layout, lineage
from lectern.plans.base import query
from lectern.plans.views import Views
from lectern.scratch import written
from lectern.streaming import jobs


def words(v: Views) -> DataFrame:
    return v("box").select("page", "box_id", F.col("box_id").alias("word_id"), "flag", F.col("flag").alias("text"), *layout.SIDES)


INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query("SELECT a.box_id AS item, b.flag FROM {box} a JOIN {region_box} b ON a.page = b.page WHERE (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1")
def words_in_region(v: Views) -> DataFrame:
    found = layout.words_in_region(v("box").select("page", "box_id", *layout.SIDES), v("region_box"), ["page"])
    return found.select(F.col("w_box_id").alias("item"), F.col("i_flag").alias("flag"))


@query("SELECT a.page, a.box_id, count(*) AS owners, min(b.flag) AS owner FROM {box} a JOIN {region_box} b ON a.page = b.page WHERE " + INTER + " / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.5::DOUBLE GROUP BY 1, 2")
def owner_of_box(v: Views) -> DataFrame:
    return layout.owner_of_box(v("box").select("page", "box_id", *layout.SIDES), v("region_box"), ["page"], "box_id", "flag")


@query("SELECT a.box_id, round(" + INTER + ", 6) AS shared, b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1 AS inside FROM {region_box} b JOIN {box} a ON a.page = b.page AND a.flag = b.flag")
def box_ops(v: Views) -> DataFrame:
    b = layout.renamed(v("region_box"), "b_", ["page", "flag"])
    both = layout.renamed(v("box"), "a_", ["page", "flag", "box_id"]).join(b, ["page", "flag"])
    a, r = layout.named("a_"), layout.named("b_")
    return both.select("box_id", F.round(layout.intersection(a, r), 6).alias("shared"), layout.contains(a, r).alias("inside"))


@query("""WITH c AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) - 40 AS x1, max(y1) - 40 AS y1, min(x0) AS i0, max(x1) AS i1, string_agg(DISTINCT lower(flag), ' ') AS known, bool_or(flag = 'R') AS semantic FROM {box} GROUP BY 1)
SELECT a.page AS item_id, 'clipping' AS issue, count(*) AS n FROM c b JOIN {box} a ON a.page = b.page WHERE NOT b.semantic AND """ + INTER + """ / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.2::DOUBLE
AND NOT (a.x0 >= b.x0 - 0.5::DOUBLE AND a.y0 >= b.y0 - 0.5::DOUBLE AND a.x1 <= b.x1 + 0.5::DOUBLE AND a.y1 <= b.y1 + 0.5::DOUBLE) GROUP BY 1
UNION ALL SELECT a.page, 'contamination', count(*) FROM c b JOIN {region_box} a ON a.page = b.page WHERE (a.x1 - a.x0) >= (b.i1 - b.i0) * 0.35::DOUBLE AND """ + INTER + """ / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.6::DOUBLE GROUP BY 1""")
def crop_audit(v: Views) -> DataFrame:
    """Items are pages; their regions hold their flag's prose ten times, which the editable text has; pages with an R are cut by meaning."""
    box = v("box")
    per = box.groupBy(F.col("page").alias("item_id")).agg(*(F.min(c).alias(f"i_{c}") for c in ("x0", "y0")), *(F.max(c).alias(f"i_{c}") for c in ("x1", "y1")), F.bool_or(F.col("flag") == "R").alias("semantic"), F.concat_ws(" ", F.transform(F.collect_set("flag"), lambda x: F.repeat(x, F.lit(2)))).alias("editable_text"))
    items = per.select("item_id", *(F.col(f"i_{c}") for c in layout.SIDES), F.col("i_x0").alias("c_x0"), F.col("i_y0").alias("c_y0"), (F.col("i_x1") - 40).alias("c_x1"), (F.col("i_y1") - 40).alias("c_y1"), "editable_text", "semantic")
    prose = F.repeat(F.concat(F.repeat("flag", F.lit(2)), F.lit(" ")), F.lit(10))
    regions = v("region_box").select(F.col("page").alias("item_id"), *(F.col(c).alias(f"r_{c}") for c in layout.SIDES), prose.alias("text"), F.length(prose).alias("characters"), F.lit(10).alias("words"))
    images = box.select(F.col("page").alias("item_id"), *(F.col(c).alias(f"m_{c}") for c in layout.SIDES))
    return layout.crop_audit(items, regions, images)


@query("""WITH a AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id % 5 = 0), b AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id % 5 <> 0),
s AS (SELECT a.vec_id AS asset_id, b.vec_id AS observed_id, round_even(1 - list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i]::DOUBLE - b.e[i]::DOUBLE))) / len(a.e), 6) AS score FROM a JOIN b ON a.label = b.label)
SELECT asset_id, observed_id, score, score >= 0.9::DOUBLE AS matched FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, observed_id) AS k FROM s) x WHERE k = 1""")
def signature_match(v: Views) -> DataFrame:
    e = v("embeddings").select("vec_id", "label", F.col("embedding").alias("sig"))
    return layout.signature_match(e.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "asset_id"), e.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "observed_id"), ["label"])


@query("""SELECT a.vec_id, round_even(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / len(a.embedding), 6) AS mae,
round_even(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / len(a.embedding), 6) <= 0.02::DOUBLE AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_mae(v: Views) -> DataFrame:
    a = v("embeddings").select("vec_id", F.col("embedding").alias("e1"))
    b = v("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return layout.vector_mae(a.join(b, "vec_id"), "e1", "e2").select("vec_id", "mae", "same")


@query("SELECT page, box_id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page % 2 = 0 THEN x0 ELSE y0 END, CASE WHEN page % 2 = 0 THEN y0 ELSE x0 END, box_id) AS INTEGER) AS place FROM {box}")
def reading_order(v: Views) -> DataFrame:
    return layout.reading_order(v("box"), ["page"], F.col("page") % 2 == 0).select("page", "box_id", "place")


THREE = """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box_id) AS k, count(*) OVER (PARTITION BY page) AS n FROM {box}) x WHERE n = 3),
pair AS (SELECT a.page, a.k AS ka, b.k AS kb, 6 - a.k - b.k AS other, least(a.x1, b.x1) > greatest(a.x0, b.x0) AS x, least(a.y1, b.y1) > greatest(a.y0, b.y0) AS y FROM t a JOIN t b ON a.page = b.page AND a.k < b.k),
axis AS (SELECT page, CASE WHEN count(*) FILTER (WHERE x) = 1 THEN max(other) FILTER (WHERE x) END AS lx, CASE WHEN count(*) FILTER (WHERE y) = 1 THEN max(other) FILTER (WHERE y) END AS ly FROM pair GROUP BY 1),
grid AS (SELECT t.*, lx, ly, lx IS NOT NULL AND ly IS NULL AS stands, ly IS NOT NULL AND lx IS NULL AS lies, avg((x0 + x1) / 2) FILTER (WHERE k <> lx) OVER (PARTITION BY t.page) AS px, avg((y0 + y1) / 2) FILTER (WHERE k <> ly) OVER (PARTITION BY t.page) AS py FROM t JOIN axis ON axis.page = t.page)"""


@query(f"""WITH {THREE} SELECT page, box_id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN stands AND k = lx THEN CASE WHEN (x0 + x1) / 2 < px THEN -1 ELSE 1 END WHEN lies AND k = ly THEN CASE WHEN (y0 + y1) / 2 < py THEN -1 ELSE 1 END ELSE 0 END,
CASE WHEN lies THEN x0 ELSE y0 END, CASE WHEN NOT stands AND NOT lies THEN x0 END, box_id) AS INTEGER) AS place FROM grid""")
def reading_order_grid(v: Views) -> DataFrame:
    """The order of the boxes of pages that have three."""
    threes = v("box").groupBy("page").agg(F.count("*").alias("n")).where("n = 3").select("page")
    return layout.reading_order(v("box").join(threes, "page", "left_semi"), ["page"], F.lit(False), F.lit(True)).select("page", "box_id", "place")


@query("SELECT page, CASE WHEN max((x0 + x1) / 2) - min((x0 + x1) / 2) >= max((y0 + y1) / 2) - min((y0 + y1) / 2) THEN 'horizontal' ELSE 'vertical' END AS axis FROM {box} GROUP BY 1")
def layout_axis(v: Views) -> DataFrame:
    return layout.layout_axis(v("box"), ["page"])


@query("""WITH m AS (SELECT page, coalesce(x0 >= max(x1) OVER (PARTITION BY page ORDER BY x0, x1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ax, coalesce(y0 >= max(y1) OVER (PARTITION BY page ORDER BY y0, y1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ay FROM {box})
SELECT page, count(*) AS n, CASE WHEN count(*) = 1 THEN 'composite' WHEN bool_and(ax) THEN 'horizontal' WHEN bool_and(ay) THEN 'vertical' ELSE 'grid' END AS arrangement FROM m GROUP BY 1""")
def arrangement(v: Views) -> DataFrame:
    return layout.arrangement(v("box"), ["page"])


@query("""SELECT page, word_id, marker_id FROM (SELECT a.page, a.box_id AS word_id, b.box_id AS marker_id, row_number() OVER (PARTITION BY a.page, a.box_id ORDER BY abs(b.y0 - a.y0), b.x0 DESC, b.box_id) AS k
FROM {box} a JOIN {box} b ON a.page = b.page AND b.flag = 'R' AND b.x0 <= a.x0) x WHERE k = 1""")
def nearest_marker(v: Views) -> DataFrame:
    w = v("box").select("page", F.col("box_id").alias("word_id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    m = v("box").where("flag = 'R'").select("page", F.col("box_id").alias("marker_id"), F.col("x0").alias("mx"), F.col("y0").alias("my"))
    return layout.nearest_marker(w, m, ["page"])


@query("SELECT a.box_id FROM {box} a WHERE NOT EXISTS (SELECT 1 FROM {region_box} b WHERE a.page = b.page AND b.flag = 'R' AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)")
def exclude_words_in_boxes(v: Views) -> DataFrame:
    return layout.exclude_words_in_boxes(words(v), v("region_box").where("flag = 'R'"), ["page"]).select("box_id")


def rows_sql(y: str, tol: float) -> str:
    """Words of pages folded into rows one after the other."""
    return f"""WITH RECURSIVE w AS (SELECT page, box_id, flag, x0, {y} AS y, row_number() OVER (PARTITION BY page ORDER BY {y}, x0, box_id) AS k FROM {{box}}),
f AS (SELECT page, k, y AS anchor, 1 AS row FROM w WHERE k = 1
  UNION ALL SELECT w.page, w.k, CASE WHEN w.y - f.anchor > {tol}::DOUBLE THEN w.y ELSE f.anchor END, CASE WHEN w.y - f.anchor > {tol}::DOUBLE THEN f.row + 1 ELSE f.row END FROM f JOIN w ON w.page = f.page AND w.k = f.k + 1)
SELECT f.page, CAST(f.row AS INTEGER) AS row, string_agg(w.flag, ' ' ORDER BY w.x0, w.box_id) AS line FROM f JOIN w ON w.page = f.page AND w.k = f.k GROUP BY 1, 2"""


@query(rows_sql("y0", 15.5))
def text_rows(v: Views) -> DataFrame:
    return layout.text_rows(words(v), ["page"])


@query(rows_sql("y1", 2.5))
def baselines(v: Views) -> DataFrame:
    return layout.baselines(words(v), ["page"])


@query()
def box_clusters(v: Views) -> DataFrame:
    return layout.box_clusters(v("box"), "page")


def marks(v: Views) -> DataFrame:
    return v("set_item").select(F.col("set_id").alias("doc_id"), F.lit(1).alias("page_no"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".")).alias("text"), (F.floor(F.col("l_quantity") / 10) * 150).cast("double").alias("x0"), (F.col("l_extendedprice") / 100).alias("y0"))


@query("""WITH m AS (SELECT set_id AS doc_id, CAST(l_linenumber AS INTEGER) AS number, floor(l_quantity / 10) * 150 AS x, l_extendedprice / 100 AS y FROM {set_item}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY x, y, number ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, y, number) > 30 THEN 1 ELSE 0 END AS fresh FROM m)),
k AS (SELECT * FROM (SELECT *, min(x) OVER (PARTITION BY doc_id, col) AS edge FROM g) WHERE abs(x - edge) <= 15),
c AS (SELECT doc_id, col, lead(edge) OVER (PARTITION BY doc_id ORDER BY col) AS next_edge FROM (SELECT DISTINCT doc_id, col, edge FROM k)),
o AS (SELECT k.doc_id, 1 AS page_no, number, CAST(k.col AS BIGINT) AS col, greatest(edge - 8, 0) AS x0, greatest(y - 8, 0) AS y0, coalesce(next_edge - 8, 842) AS x1, coalesce(lead(y) OVER (PARTITION BY k.doc_id, k.col ORDER BY y, number) - 8, 1161) AS y1
  FROM k JOIN c ON c.doc_id = k.doc_id AND c.col = k.col)
SELECT * FROM o WHERE y1 - y0 >= 60""")
def segment_items(v: Views) -> DataFrame:
    pages = v("set_item").select(F.col("set_id").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("page_no"), F.lit(842.0).alias("width"), F.lit(1191.0).alias("height"))
    return layout.segment_items(marks(v), pages)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
s AS (SELECT doc_id, line, list_filter(range(0, length(body)), lambda i: substr(body, i + 1, 1) <> ' ') AS p, lower(replace(body, ' ', '')) AS t FROM l),
h AS (SELECT doc_id, line, p, term, unnest(list_filter(range(1, length(t) - length(term) + 2), lambda i: substr(t, i, length(term)) = term)) AS spot FROM s, (VALUES ('the'), ('ation')) v(term) WHERE contains(t, term))
SELECT doc_id, CAST(line AS INTEGER) AS line, term, CAST(spot AS INTEGER) AS "at", p[spot] * 6.0::DOUBLE AS x0, p[spot + length(term) - 1] * 6.0::DOUBLE + 6 AS x1 FROM h""")
def highlight_boxes(v: Views) -> DataFrame:
    """Characters of documents are six units wide."""
    lines = v("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return layout.highlight_texts(lines, ["doc_id", "line"], ["the", "ation"], 6.0)


@query("""SELECT e.k, o.k IS NOT NULL AS "exists", e.h = o.h AS hash_ok, e.n = o.n AS items_ok, coalesce(o.k IS NOT NULL AND e.h = o.h AND coalesce(e.n = o.n, true), false) AS ok FROM (SELECT p_partkey AS k, sha256(p_name) AS h, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 END AS n FROM part WHERE p_partkey % 7 = 0) e
LEFT JOIN (SELECT l_partkey AS k, sha256(CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE p_name END) AS h, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) o ON o.k = e.k""")
def manifest_join(v: Views) -> DataFrame:
    p = v("part")
    e = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("k"), F.sha2("p_name", 256).alias("sha256"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 40).alias("items"))
    n = v("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("items"))
    o = n.join(p.select(F.col("p_partkey").alias("k"), "p_name"), "k").select("k", F.sha2(F.when(F.col("k") % 3 == 0, "x").otherwise(F.col("p_name")), 256).alias("sha256"), "items")
    return lineage.manifest_join(e, o, "k")


@query("""WITH a AS (SELECT p_partkey AS number, 1 AS n FROM part WHERE p_partkey % 7 = 0), b AS (SELECT l_partkey AS number, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1)
SELECT number, n_source, n_generated, CASE WHEN n_source = 1 AND n_generated = 1 THEN 'pair' WHEN n_source = 0 THEN 'missing_source' WHEN n_generated = 0 THEN 'missing_generated' WHEN n_source > 1 THEN 'duplicate_source' ELSE 'duplicate_generated' END AS state
FROM (SELECT coalesce(a.number, b.number) AS number, CAST(coalesce(a.n, 0) AS BIGINT) AS n_source, coalesce(b.n, 0) AS n_generated FROM a FULL OUTER JOIN b ON a.number = b.number) x""")
def aligned_pairs(v: Views) -> DataFrame:
    return lineage.aligned_pairs(v("part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("number")), v("lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("number")), "number")


@query("SELECT coalesce(a.conv_id, b.conv_id) AS doc_id, coalesce(a.turn, b.turn) AS page_no, a.turn IS NOT NULL AS in_source, b.turn IS NOT NULL AS in_generated FROM (SELECT * FROM conversations WHERE turn % 3 <> 0) a FULL OUTER JOIN (SELECT * FROM conversations WHERE turn % 2 = 0) b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def align_pages(v: Views) -> DataFrame:
    c = v("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"))
    return lineage.align_pages(c.where("page_no % 3 <> 0"), c.where("page_no % 2 = 0"))


@query("SELECT event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS region FROM events")
def assign_region(v: Views) -> DataFrame:
    e = v("events").select("user_id", "event_id")
    starts = v("events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), F.col("event_id").alias("name"))
    return lineage.assign_region(e, starts, ["user_id"], "event_id", "start", "name").select("event_id", "region")


PLAN = "(VALUES ('signup', 1), ('view', 2), ('click', 3), ('purchase', 4), ('error', 5)) p(stage, rank)"
PREFIX = "f AS (SELECT source, stage, CAST(min(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY rank) AS INTEGER) AS ok FROM {stage})"


def plan_of(v: Views) -> DataFrame:
    return v.spark.createDataFrame([("signup", 1), ("view", 2), ("click", 3), ("purchase", 4), ("error", 5)], "stage string, rank int")


@query("WITH " + PREFIX + " SELECT source, stage FROM f WHERE ok = 1")
def valid_prefix(v: Views) -> DataFrame:
    return windows.valid_prefix(v("stage"), "source", "rank", "valid").select("source", "stage")


@query("WITH " + PREFIX + " SELECT s.source, p.stage FROM (SELECT DISTINCT source FROM {stage}) s, " + PLAN + " WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = s.source AND f.stage = p.stage AND ok = 1)")
def resume_plan(v: Views) -> DataFrame:
    return lineage.resume_plan(v("stage"), plan_of(v)).select("source", "stage")


@query("SELECT source, arg_min(stage, rank) AS next_stage FROM (SELECT s.source, p.stage, p.rank FROM (SELECT DISTINCT source FROM {stage}) s, " + PLAN + " WHERE NOT EXISTS (SELECT 1 FROM {stage} f WHERE f.source = s.source AND f.stage = p.stage AND f.valid)) x GROUP BY 1 UNION ALL SELECT source, NULL FROM {stage} WHERE valid GROUP BY 1 HAVING count(*) = 5")
def next_pending_stage(v: Views) -> DataFrame:
    every = v("stage").select("source", F.when(F.col("valid"), F.col("stage")).alias("stage"))
    return windows.next_pending_stage(every, plan_of(v), "source")


@query("SELECT job_id, count(status) AS n_items, count(*) FILTER (WHERE status <> 'ready') AS n_failed, CASE WHEN count(*) FILTER (WHERE status <> 'ready') = 0 THEN 'review' WHEN count(*) FILTER (WHERE status <> 'ready') = count(status) THEN 'failed' ELSE 'partial_failure' END AS state FROM {job_item} GROUP BY 1")
def job_status(v: Views) -> DataFrame:
    return lineage.job_status(v("job_item"))


@query("SELECT job_id, bool_or(status = 'ready') AS can_review, coalesce(bool_and(confirmed AND text <> '') FILTER (WHERE selected), false) AS can_typeset, bool_or(status = 'failed') AS can_retry FROM {job_item} GROUP BY 1")
def job_capabilities(v: Views) -> DataFrame:
    return lineage.job_capabilities(v("job_item"))


LATEST = "SELECT op_id, status, n_events FROM (SELECT op_id, status, count(*) OVER (PARTITION BY op_id) AS n_events, row_number() OVER (PARTITION BY op_id ORDER BY CASE WHEN status IN ('succeeded', 'failed') THEN 0 ELSE 1 END, ts DESC, seq DESC) AS k FROM {operation}) x WHERE k = 1"


@query(LATEST)
def latest_operation(v: Views) -> DataFrame:
    return lineage.latest_operation(v("operation"), "op_id", "ts", "seq")


@query("SELECT op_id, seq, max(progress) OVER (PARTITION BY op_id ORDER BY ts, seq) AS shown FROM {operation}")
def monotone_progress(v: Views) -> DataFrame:
    return lineage.monotone_progress(v("operation"), "op_id", ["ts", "seq"]).select("op_id", "seq", "shown")


@query("SELECT coalesce(e.status, 'queued') AS status, count(*) AS n FROM (SELECT c_custkey AS item FROM customer) p LEFT JOIN (SELECT op_id AS item, max_by(status, (ts, seq)) AS status FROM {operation} GROUP BY 1) e ON e.item = p.item GROUP BY 1")
def live_status(v: Views) -> DataFrame:
    """Planned items by their last state."""
    seen = v("operation").groupBy(F.col("op_id").alias("item")).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    return lineage.live_status(seen, v("customer").select(F.col("c_custkey").alias("item")))


def stream(v: Views) -> DataFrame:
    """The events of the folder, read as a stream, as operations."""
    schema = v("events").schema
    raw = jobs.event_stream(v.spark, f"{v.sf_dir}/events.parquet*", schema)
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("running")
    progress = F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value").cast("int"))).cast("long")
    return raw.select(F.col("user_id").alias("op_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), progress.alias("progress"), "event_type")


@query("SELECT op_id, max(progress) AS shown FROM {operation} GROUP BY 1")
def stream_progress(v: Views) -> DataFrame:
    return jobs.updated_to_end(stream(v), jobs.progress("op_id"), "progress")


@query(LATEST)
def stream_current_state(v: Views) -> DataFrame:
    return jobs.updated_to_end(stream(v), jobs.current_state("op_id", "ts", "seq"), "state")


@query("""SELECT coalesce(s.status, 'queued') AS status, count(*) AS n FROM (SELECT DISTINCT c_custkey AS op_id FROM customer) c LEFT JOIN (SELECT op_id, max_by(status, (status IN ('succeeded', 'failed', 'cancelled'), ts, seq)) AS status FROM {operation} GROUP BY 1) s USING (op_id) GROUP BY 1""")
def stream_live_counts(v: Views) -> DataFrame:
    """Each planned item's last state from the stream; those not seen yet are queued."""
    states = jobs.updated_to_end(stream(v), jobs.current_state("op_id", "ts", "seq"), "item-state")
    planned = v("customer").select(F.col("c_custkey").alias("item")).distinct()
    return written(lineage.live_status(states.withColumnRenamed("op_id", "item"), planned), "counts")
