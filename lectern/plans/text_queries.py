"""Text helpers over whole tables: numbers and scores stripped, choices split, standards and running heads told apart, ids of content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import items, mining
from lectern.plans.base import query
from lectern.plans.search_queries import PAGES_SQL, pages_of
from lectern.plans.views import Views
from lectern.sources import corpus


LINES = "(SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) d"


def lines_of(v: Views) -> DataFrame:
    """All lines of all documents, numbered from 1."""
    return v("documents").select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at").cast("long") + 1)


@query(f"""SELECT doc_id, line_no, ltrim(line) AS first, trim(line) AS asked FROM {LINES} WHERE NOT regexp_matches(ltrim(line), '^[0-9]') AND ltrim(line) <> '' AND NOT regexp_matches(line, '[\\])]\\s*$') AND NOT regexp_matches(line, '\\s$')""")
def stripped_stems(v: Views) -> DataFrame:
    """Lines with a number before and a score behind, by the document's length, stripped of both."""
    d = lines_of(v).withColumn("line", F.ltrim("line")).where(~F.col("line").rlike("^[0-9]") & (F.col("line") != "") & ~F.col("line").rlike(r"[\])]\s*$") & ~F.col("line").rlike(r"\s$"))
    numbered = F.concat((F.col("n_chars") % 99).cast("string"), F.lit(" . "), "line")
    scored = F.concat("line", F.lit(" ["), (F.col("n_chars") % 4 + 1).cast("string"), F.lit(".5점] "))
    return d.select("doc_id", "line_no", text.strip_number(numbered).alias("first"), text.strip_score(scored).alias("asked"))


@query("""SELECT id, turn, array_to_string(list_filter([trim(text), trim(role), trim(CASE WHEN size % 2 = 0 THEN ' ' ELSE text END)], lambda x: x <> ''), '|') AS choices FROM {talk_line} WHERE NOT regexp_matches(text, '[①②③④⑤]')""")
def split_choices(v: Views) -> DataFrame:
    t = v("talk_line").where(~F.col("text").rlike("[①②③④⑤]"))
    line = F.concat(F.lit("발문 ① "), "text", F.lit(" ②"), "role", F.lit(" ③ "), F.when(F.col("size") % 2 == 0, " ").otherwise(F.col("text")))
    return t.select("id", "turn", F.array_join(text.split_choices(line), "|").alias("choices"))


@query(f"""SELECT doc_id, line_no, CASE WHEN n_chars % 3 > 0 THEN lpad(CAST(n_chars % 9 + 1 AS VARCHAR), 1, '0') || '과' || lpad(CAST(n_chars % 20 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 9 + 1 AS VARCHAR), 2, '0') END AS code,
CASE WHEN n_chars % 3 > 0 THEN line END AS body FROM {LINES} WHERE line = ltrim(line) AND line <> ''""")
def parse_standard(v: Views) -> DataFrame:
    """Lines that begin with a code, or nearly, with a line of a document behind it."""
    d = lines_of(v).where((F.col("line") == F.ltrim("line")) & (F.col("line") != ""))
    n = F.col("n_chars")
    code = F.concat((n % 9 + 1).cast("string"), F.lit("과"), F.lpad((n % 20).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("doc_id") % 9 + 1).cast("string"), 2, "0"))
    whole = F.concat(F.when(n % 3 > 0, F.concat(F.lit(" ["), code, F.lit("] "))).otherwise(F.concat(F.lit("["), code, F.lit(" "))), "line")
    return d.select("doc_id", "line_no", mining.parse_standard(whole).alias("p")).select("doc_id", "line_no", "p.code", F.col("p.text").alias("body"))


@query(f"WITH {PAGES_SQL} SELECT document_id, page_no, regexp_matches(body, '^(The|Der|Le|El) ') OR regexp_matches(trim(body), '^[0-9]{{1,4}}$') AS head FROM line_pages")
def running_heads(v: Views) -> DataFrame:
    return pages_of(v).select("document_id", "page_no", mining.is_running_head(F.col("body"), "^(The|Der|Le|El) ").alias("head"))


@query("SELECT doc_id, sha256(trim(replace(text, chr(10), ''))) AS joined FROM documents")
def join_broken_lines(v: Views) -> DataFrame:
    return v("documents").select("doc_id", F.sha2(mining.join_broken_lines(F.split("text", "\n")), 256).alias("joined"))


@query("""SELECT doc_id, sha256('["' || doc_id || '","' || lang || '","' || source || '","' || n_chars || '"]') AS digest, substr(sha256(source || ':' || lang || ':' || doc_id), 1, 20) AS namespace FROM documents""")
def item_digests(v: Views) -> DataFrame:
    cols = [F.col(c) for c in ("doc_id", "lang", "source", "n_chars")]
    return v("documents").select("doc_id", text.item_digest(*cols).alias("digest"), text.namespace_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("namespace"))


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN '26023-' || lpad(CAST(n_chars % 10000 AS VARCHAR), 4, '0') END AS source_id FROM documents WHERE NOT contains(text, '[26023-')")
def source_ids(v: Views) -> DataFrame:
    d = v("documents").where(~F.contains("text", F.lit("[26023-")))
    coded = F.concat(F.col("text"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("[26023-"), F.lpad((F.col("n_chars") % 10000).cast("string"), 4, "0"), F.lit("]"))).otherwise("[26023-"))
    return d.select("doc_id", items.source_id(coded).alias("source_id"))


@query("SELECT count(*) FILTER (WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type = 'signup')) = 0 AS due FROM events WHERE event_type = 'error'")
def snapshot_due(v: Views) -> DataFrame:
    """Whether the day of the last signup has no error yet, read as snapshots."""
    e = v("events")
    today = e.where("event_type = 'signup'").agg(F.max(F.to_date("ts")).alias("d")).first().d
    return corpus.day_gate(e.where("event_type = 'error'").withColumnRenamed("ts", "at"), F.lit(today))
