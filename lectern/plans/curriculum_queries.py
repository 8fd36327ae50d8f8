"""Curriculum documents made of the lines of all documents: every line stays, with a mark in front that its length decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import curriculum
from lectern.plans.base import query
from lectern.plans.views import Views

#: What stands before a line, or in its place, by its length; as Spark and DuckDB read it alike.
MARKED = """CASE length(s) % 11 WHEN 0 THEN '(' || length(s) % 43 || ') ' || s WHEN 1 THEN '<탐구 활동>' WHEN 2 THEN '(가) 성취기준 해설' WHEN 3 THEN '(나) 성취기준 적용 시 고려 사항'
WHEN 4 THEN '[9과' || lpad(CAST(length(s) % 30 AS STRING), 2, '0') || '-01] ' || s WHEN 5 THEN '• ' || s WHEN 6 THEN '• ' || s || ' ' WHEN 7 THEN CAST(length(s) AS STRING) ELSE s END"""

UNITS_SQL = rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS s FROM documents),
m AS (SELECT doc_id, line_no, {MARKED} AS line FROM l),
e AS (SELECT doc_id, min(line_no) AS last_line FROM m WHERE regexp_matches(line, '^\s*3\.\s*교수') GROUP BY 1),
k AS (SELECT m.*, CASE WHEN regexp_matches(line, '^\s*\([0-9]{{1,2}}\)\s*\S') THEN 'unit' WHEN regexp_matches(line, '^\s*<\s*탐구\s*활동\s*>') THEN 'inquiry' WHEN regexp_matches(line, '^\s*\(가\)\s*성취기준\s*해설') THEN 'explain'
  WHEN regexp_matches(line, '^\s*\(나\)\s*성취기준\s*적용') THEN 'consider' WHEN regexp_matches(line, '^\s*\[9과[0-9][0-9]-[0-9][0-9]\]') THEN 'std' WHEN regexp_matches(line, '^\s*[•·⋅]') THEN 'bullet' END AS kind
  FROM m LEFT JOIN e ON e.doc_id = m.doc_id WHERE (last_line IS NULL OR line_no < last_line) AND trim(line, ' ') <> '' AND NOT regexp_matches(trim(line, ' '), '^[0-9]{{1,4}}$')),
n AS (SELECT *, TRY_CAST(CASE kind WHEN 'unit' THEN regexp_extract(line, '^\s*\(([0-9]{{1,2}})\)', 1) WHEN 'std' THEN regexp_extract(line, '^\s*\[9과([0-9][0-9])', 1) END AS INTEGER) AS number FROM k),
b AS (SELECT *, kind = 'unit' AND number BETWEEN 1 AND 40 AND line_no = min(line_no) OVER (PARTITION BY doc_id, number) AS begins FROM n),
s AS (SELECT *, last_value(CASE WHEN begins OR kind = 'std' THEN number END IGNORE NULLS) OVER w AS unit_no, last_value(CASE WHEN begins THEN 'none' WHEN kind IN ('inquiry', 'explain', 'consider', 'std') THEN kind END IGNORE NULLS) OVER w AS section,
  last_value(CASE WHEN kind IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS open_at, last_value(kind IGNORE NULLS) OVER w AS open_kind FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
t AS (SELECT doc_id, open_at, min(unit_no) AS unit_no, min(section) AS section, trim(regexp_replace(string_agg(CASE kind WHEN 'std' THEN regexp_replace(line, '^\s*\[9과[0-9][0-9]-[0-9][0-9]\]\s*', '') WHEN 'bullet' THEN regexp_replace(line, '^\s*[•·⋅]\s*', '')
  ELSE trim(line, ' ') || CASE WHEN regexp_matches(line, '\s$') THEN ' ' ELSE '' END END, '' ORDER BY line_no), '\s+', ' ', 'g')) AS text
  FROM s WHERE open_kind = 'std' OR open_kind = 'bullet' AND section IN ('inquiry', 'explain', 'consider') AND unit_no IS NOT NULL GROUP BY 1, 2),
a AS (SELECT doc_id, unit_no, section, text FROM t WHERE section = 'std' OR text <> '' UNION ALL SELECT doc_id, number, 'unit', regexp_extract(line, '^\s*\([0-9]{{1,2}}\)\s*(\S.*\S|\S)\s*$', 1) FROM b WHERE begins)
SELECT doc_id, unit_no, coalesce(max(CASE WHEN section = 'unit' THEN text END), '(' || unit_no || ')') AS name, count(*) FILTER (WHERE section = 'std') AS standards, CAST(coalesce(sum(CASE WHEN section = 'std' THEN length(text) END), 0) AS BIGINT) AS letters,
count(*) FILTER (WHERE section = 'inquiry') AS inquiry, count(*) FILTER (WHERE section = 'explain') AS "explain", count(*) FILTER (WHERE section = 'consider') AS consider FROM a GROUP BY 1, 2"""


@query(UNITS_SQL)
def curriculum_units(v: Views) -> DataFrame:
    """Units of all documents with their standards and sections, read from whole texts."""
    lines = v("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "s"))
    return curriculum.unit_report(curriculum.entries(lines.select("doc_id", "line_no", F.expr(MARKED).alias("line")), "9과"))


@query("""WITH b AS (SELECT r_regionkey % 2 AS subject, min(r_regionkey) * 100 AS base FROM region GROUP BY 1)
SELECT c_custkey, c_nationkey + b.base AS global_no FROM customer LEFT JOIN b ON b.subject = c_nationkey % 3""")
def global_unit_no(v: Views) -> DataFrame:
    """Customers' nations as units of two subjects, and of a third that isn't known."""
    subjects = v("region").groupBy((F.col("r_regionkey") % 2).alias("subject")).agg((F.min("r_regionkey") * 100).alias("base"))
    rows = v("customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("subject"), F.col("c_nationkey").alias("unit_no"))
    return curriculum.global_unit_no(rows, subjects).select("c_custkey", "global_no")
