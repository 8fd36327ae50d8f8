"""What sources and sinks write below the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.base import query
from lectern.plans.search_queries import CHUNKS_SQL
from lectern.plans.views import Views
from lectern.scratch import new_path
from lectern.sources import corpus


@query("""SELECT source, 'txt' AS ext, 'Text' AS format, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1
UNION ALL SELECT source, 'dat', 'other', CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def corpus_inventory(v: Views) -> DataFrame:
    """Documents as text files below one folder a source, their ids as files of a format that isn't known; bytes by folder and format."""
    root = new_path(v.spark, "inventory")
    docs = v("documents").where("text is not null")
    docs.select("source", F.col("text").alias("value")).write.partitionBy("source").option("lineSep", "\n").text(f"{root}/texts")
    docs.select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").format("csv").option("extension", "dat").save(f"{root}/ids")
    found = corpus.corpus_inventory(v.spark, root)
    return found.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "ext", "format").agg(F.sum("length").alias("bytes"))


@query("SELECT page AS page_no, flag || box_id AS text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(box_id % 7 AS DOUBLE) / 8 AS confidence FROM {box}")
def read_ocr_words(v: Views) -> DataFrame:
    """Boxes as the words that OCR writes beside its pages, many sidecars to a file."""
    path = new_path(v.spark, "ocr")
    box = F.transform(F.array("x0", "y0", "x1", "y1"), lambda x: x.cast("double"))
    word = F.struct(F.concat("flag", F.col("box_id").cast("string")).alias("text"), box.alias("bbox"), ((F.col("box_id") % 7).cast("double") / 8).alias("confidence"))
    v("box").groupBy(F.col("page").cast("int").alias("page")).agg(F.collect_list(word).alias("words")).write.json(path)
    return corpus.read_ocr_words(v.spark, path, one_a_line=True).select(F.col("page_no").cast("long").alias("page_no"), "text", "x0", "y0", "x1", "y1", "confidence")


@query("""SELECT '| lang | source | n |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL
SELECT '| ' || replace(coalesce(lang, ''), '|', '\\|') || ' | ' || replace(coalesce(source, ''), '|', '\\|') || ' | ' || count(*) || ' |' FROM documents GROUP BY lang, source""".replace("\\\\", "\\"))
def publish_report(v: Views) -> DataFrame:
    """The lines of a report on languages and sources in Markdown."""
    path = new_path(v.spark, "report")
    corpus.publish_report(v("documents").groupBy("lang", "source").agg(F.count("*").alias("n")), path, ["lang", "source"], "md")
    return v.spark.read.text(path).select(F.col("value").alias("line"))


def rotated(v: Views) -> str:
    """Four snapshots of two tables, which change from one to the next; three of them stay."""
    root = new_path(v.spark, "snapshots")
    for k in range(4):
        corpus.snapshot({"orders": v("orders").where(f"o_orderkey % 4 <= {k}").select("o_orderkey", "o_totalprice"), "customer": v("customer").select("c_custkey", F.lit(k).alias("round"))}, root)
    return root


@query("SELECT 4 - k AS slot, 'orders' AS \"table\", (SELECT count(*) FROM orders WHERE o_orderkey % 4 <= k) AS rows FROM (VALUES (1), (2), (3)) AS t(k) UNION ALL SELECT 4 - k, 'customer', (SELECT count(*) FROM customer) FROM (VALUES (1), (2), (3)) AS t(k)")
def list_snapshots(v: Views) -> DataFrame:
    return corpus.list_snapshots(v.spark, rotated(v), ["orders", "customer"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snapshot(v: Views) -> DataFrame:
    """The newest snapshot of all that are there, as it can be read."""
    return corpus.restore(v.spark, rotated(v), 1, "orders")


@query("SELECT 'restored' AS state, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 <= 1 UNION ALL SELECT 'kept', o_orderkey, -o_totalprice FROM orders WHERE o_orderkey % 4 = 3")
def restore(v: Views) -> DataFrame:
    """The oldest snapshot back, after the current state, which no snapshot had, has become the newest."""
    root = rotated(v)
    now = {"orders": v("orders").where("o_orderkey % 4 = 3").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice")), "customer": v("customer").select("c_custkey", F.lit(9).alias("round"))}
    back = corpus.restore(v.spark, root, 3, "orders", now)
    return back.select(F.lit("restored").alias("state"), "*").unionByName(corpus.restore(v.spark, root, 1, "orders").select(F.lit("kept").alias("state"), "*"))


FINAL = "final AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN text WHEN source <> 'src4' THEN text || chr(10) || 'another line' END AS text FROM documents)"


@query(f"WITH {CHUNKS_SQL.replace('RECURSIVE ', f'RECURSIVE {FINAL}, ', 1).replace('AS i FROM documents)', 'AS i FROM final)')} SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, sha256(body) AS body FROM chunk")
def reindex(v: Views) -> DataFrame:
    """Chunks of all documents, after those of one language came again, some of them without text."""
    docs = v("documents").select("doc_id", "lang", "source", "text")
    new = docs.where("lang = 'en'").select("doc_id", F.when(F.col("source") != "src4", F.concat("text", F.lit("\nanother line"))).alias("text"))
    current = corpus.line_chunks(docs, ["doc_id"], "text")
    return corpus.reindex(current, new, "doc_id").select("doc_id", "page_no", F.sha2("body", 256).alias("body"))
