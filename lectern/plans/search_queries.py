"""Evidence search and corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import squeezed, tokens
from lectern.operators import bank, index, search
from lectern.plans.base import query
from lectern.plans.views import Views
from lectern.scratch import new_path, remembered
from lectern.sources import corpus
from lectern.streaming import jobs

TERMS = ("from", "thre")

#: One page a line of ten characters or more, as DuckDB says it.
PAGES_SQL = """
line_pages AS (
  SELECT document_id, doc_type, page_no, body FROM (
    SELECT doc_id + 1 AS document_id, source AS doc_type, unnest(string_split(text, chr(10))) AS body,
           CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page_no FROM documents) p
  WHERE length(trim(body)) >= 10)"""
TOKENS_SQL = r"tok AS (SELECT document_id, page_no, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) AS token FROM line_pages)"


def pages_of(v: Views) -> DataFrame:
    """Pages with their document's type, without a join: the type stands beside the lines."""
    docs = v("documents").select((F.col("doc_id") + 1).alias("document_id"), F.col("source").alias("doc_type"), F.posexplode(F.split("text", "\n")).alias("at", "body"))
    return docs.where(F.length(F.trim("body")) >= 10).select("document_id", "doc_type", (F.col("at") + 1).alias("page_no"), "body")


def bm25_sql(mode_tf: list[str], length: str, where: str = "") -> str:
    n = range(len(mode_tf))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))" for i in n)
    return f"""WITH {PAGES_SQL},
c AS (SELECT document_id, doc_type, page_no, {length} AS len, {', '.join(f'{t} AS tf{i}' for i, t in enumerate(mode_tf))} FROM line_pages),
s AS (SELECT count(*) AS n, greatest(avg(len), 1.0::DOUBLE) AS avg_len, {', '.join(f'sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}' for i in n)} FROM c),
r AS (SELECT document_id, doc_type, page_no, {score} AS score FROM c, s WHERE {' AND '.join(f'tf{i} > 0' for i in n)} {where})"""


PREFIX_TF = [rf"len(regexp_extract_all(' ' || array_to_string(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+'), ' '), ' {t}'))" for t in TERMS]
PREFIX_LEN = r"len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'))"
SQUEEZED = r"regexp_replace(lower(body), '\s+', '', 'g')"


def index_of(v: Views) -> index.Index:
    """The stored index of the pages; made when first asked for in an application."""
    return remembered(v.spark, "index", f"{v.sf_dir}/documents.parquet", lambda path: index.build_index(pages_of(v), path))


@query(f"WITH {PAGES_SQL}, {TOKENS_SQL} SELECT token, count(DISTINCT (document_id, page_no)) AS df, count(*) AS n FROM tok GROUP BY 1")
def search_index(v: Views) -> DataFrame:
    return index_of(v).vocabulary


@query(bm25_sql(PREFIX_TF, PREFIX_LEN) + """
SELECT document_id, page_no, round(score, 6) AS score, CAST(greatest(1, least(100, round_even(score / max(score) OVER () * 100, 0))) AS INTEGER) AS match_pct, count(*) OVER () AS total
FROM r ORDER BY r.score DESC, document_id, page_no LIMIT 60""")
def search_top_k(v: Views) -> DataFrame:
    return search.search_index(index_of(v), " ".join(TERMS)).select("document_id", "page_no", F.round("score", 6).alias("score"), "match_pct", "total")


@query(bm25_sql(PREFIX_TF, PREFIX_LEN) + """
SELECT document_id, page_no, round(score, 6) AS score, count(*) OVER () AS total FROM r WHERE doc_type = 'src3' ORDER BY r.score DESC, document_id, page_no LIMIT 60""")
def search_doc_type_filter(v: Views) -> DataFrame:
    return search.search_index(index_of(v), " ".join(TERMS), doc_type="src3").select("document_id", "page_no", F.round("score", 6).alias("score"), "total")


@query(bm25_sql([f"CAST((length({SQUEEZED}) - length(replace({SQUEEZED}, '{t}', ''))) / {len(t)} AS BIGINT)" for t in TERMS], f"length({SQUEEZED})") + """
SELECT document_id, page_no, round(score, 6) AS score FROM r""")
def search_substring(v: Views) -> DataFrame:
    return search.bm25(pages_of(v), list(TERMS), "substring").select("document_id", "page_no", F.round("score", 6).alias("score"))


@query(f"WITH {PAGES_SQL}, {TOKENS_SQL} SELECT document_id, page_no FROM tok GROUP BY 1, 2 HAVING count(CASE WHEN starts_with(token, 'from') THEN 1 END) > 0 AND count(CASE WHEN starts_with(token, 'thre') THEN 1 END) > 0")
def prefix_and_match(v: Views) -> DataFrame:
    return search.prefix_and_match(pages_of(v), list(TERMS)).select("document_id", "page_no")


@query(f"WITH {PAGES_SQL}, {TOKENS_SQL} SELECT token, document_id, page_no, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY document_id, page_no) AS BIGINT) AS page_tokens FROM tok GROUP BY 1, 2, 3")
def build_postings(v: Views) -> DataFrame:
    return search.build_postings(pages_of(v))


@query(f"""WITH {PAGES_SQL}, {TOKENS_SQL},
bt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM benchmark),
q AS (SELECT item_id AS query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(term), term) AS pos FROM bt) b WHERE pos <= 2),
l AS (SELECT document_id, page_no, count(*) AS len FROM tok GROUP BY 1, 2),
st AS (SELECT (SELECT count(*) FROM line_pages) AS n, greatest((SELECT sum(len) FROM l) / (SELECT count(*) FROM line_pages)::DOUBLE, 1.0::DOUBLE) AS avg_len),
h AS (SELECT t.term, k.document_id, k.page_no, count(*) AS tf FROM (SELECT DISTINCT term FROM q) t JOIN tok k ON starts_with(k.token, t.term) GROUP BY 1, 2, 3),
d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
p AS (SELECT q.query_id, h.document_id, h.page_no, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score, count(*) AS have
      FROM q JOIN h ON q.term = h.term JOIN d ON d.term = h.term JOIN l ON l.document_id = h.document_id AND l.page_no = h.page_no, st GROUP BY 1, 2, 3),
f AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY round(score, 9) DESC, document_id, page_no) AS rank FROM p JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY 1) c ON c.query_id = p.query_id AND have = need)
SELECT query_id, document_id, page_no, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10""")
def search_many(v: Views) -> DataFrame:
    """Each item asks for the two shortest of all its words of four letters or more: the most frequent kind, and the hardest to look up."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1))
    two = F.slice(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("term")))), 1, 2)
    terms = v("benchmark").select(F.col("item_id").alias("query_id"), F.explode(two).alias("x")).select("query_id", "x.term")
    return search.search_many(index_of(v), terms).withColumn("score", F.round("score", 6))


@query(r"""WITH p AS (SELECT item_id * 1000 + i AS phrase_id, s[i] AS phrase FROM (SELECT item_id, string_split(text, '. ') AS s, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM benchmark) b)
SELECT phrase_id, count(doc_id) AS documents, coalesce(array_to_string(list_sort(list(doc_id) FILTER (WHERE k <= 5)), ','), '') AS sample
FROM (SELECT p.phrase_id, d.doc_id, row_number() OVER (PARTITION BY p.phrase_id ORDER BY d.doc_id) AS k FROM p LEFT JOIN documents d ON contains(d.text, p.phrase)) x GROUP BY 1""")
def attested(v: Views) -> DataFrame:
    sentences = v("benchmark").select("item_id", F.posexplode(F.split("text", "\\. ")).alias("i", "phrase"))
    return search.attested(sentences.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("phrase_id"), "phrase"), v("documents").select("doc_id", "text"))


@query(r"""SELECT item_id AS phrase_id, count(doc_id) AS documents, coalesce(array_to_string(list_sort(list(doc_id) FILTER (WHERE k <= 5)), ','), '') AS sample
FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS k FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)) x GROUP BY 1""")
def attested_whole(v: Views) -> DataFrame:
    return search.attested(v("benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")), v("documents").select("doc_id", "text"))


PHRASES = ("the", "License", "and ", "\n")


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, CAST(sum((length(text) - length(replace(text, '{p}', ''))) / {len(p)}) AS BIGINT) AS occurrences, count(*) FILTER (WHERE contains(text, '{p}')) AS containing FROM documents" for p in PHRASES[:3]))
def phrase_occurrences(v: Views) -> DataFrame:
    return search.phrase_occurrences(v("documents"), list(PHRASES[:3]))


@query("SELECT t.term, count(*) FILTER (WHERE contains(lower(d.text), t.term)) AS hits FROM documents d, (VALUES ('license'), ('from'), ('zzz')) t(term) GROUP BY 1")
def term_hit_counts(v: Views) -> DataFrame:
    return search.term_hit_counts(v("documents"), ["license", "from", "zzz"], "text")


@query(f"WITH {PAGES_SQL} SELECT document_id, page_no, CASE WHEN strpos(lower(body), 'from') > 0 THEN substr(body, greatest(strpos(lower(body), 'from') - 45, 1), strpos(lower(body), 'from') - greatest(strpos(lower(body), 'from') - 45, 1) + 84) ELSE substr(body, 1, 160) END AS snippet FROM line_pages")
def snippet(v: Views) -> DataFrame:
    return pages_of(v).select("document_id", "page_no", search.snippet(F.col("body"), F.lit("from")).alias("snippet"))


def starts_sql(term: str) -> str:
    """The places of the first 60 hits of a term in column t, from 0."""
    parts = f"string_split(t, '{term}')"
    return f"list_transform(range(1, least(len({parts}), 61)), lambda i: list_sum(list_transform({parts}[1:i], lambda x: length(x))) + (i - 1) * {len(term)})"


NEAR_SQL = f"""near AS (SELECT document_id, page_no, round(coalesce(greatest(0.0::DOUBLE, 1 - (list_min(list_transform(list_concat(a, b), lambda s: CASE WHEN len(list_filter(a, lambda x: x >= s)) > 0 AND len(list_filter(b, lambda x: x >= s)) > 0
THEN greatest(list_min(list_filter(a, lambda x: x >= s)), list_min(list_filter(b, lambda x: x >= s))) + 4 - s END)) - 8) / 140.0::DOUBLE), 0.0::DOUBLE), 9) AS proximity
FROM (SELECT document_id, page_no, {starts_sql(TERMS[0])} AS a, {starts_sql(TERMS[1])} AS b FROM (SELECT document_id, page_no, {SQUEEZED} AS t FROM line_pages) n WHERE contains(t, '{TERMS[0]}') AND contains(t, '{TERMS[1]}')) m)"""


@query(f"WITH {PAGES_SQL}, {NEAR_SQL} SELECT document_id, page_no, round(proximity, 6) AS proximity FROM near")
def proximity(v: Views) -> DataFrame:
    pages = search.substring_and_match(pages_of(v), list(TERMS))
    return pages.select("document_id", "page_no", F.round(search.proximity(squeezed(F.col("body")), list(TERMS)), 6).alias("proximity"))


@query(bm25_sql([f"CAST((length({SQUEEZED}) - length(replace({SQUEEZED}, '{t}', ''))) / {len(t)} AS BIGINT)" for t in TERMS], f"length({SQUEEZED})") + f", {NEAR_SQL}" + """
SELECT document_id, page_no, round(score * (1 + 2.2::DOUBLE * proximity), 6) AS score FROM r JOIN near USING (document_id, page_no) ORDER BY score * (1 + 2.2::DOUBLE * proximity) DESC, document_id, page_no LIMIT 60""")
def search_near(v: Views) -> DataFrame:
    return search.search_near(pages_of(v), " ".join(TERMS)).select("document_id", "page_no", F.round("score", 6).alias("score"))


HIT_SQL = r"(starts_with(regexp_replace(lower(x), '^[^\p{L}\p{N}]+', ''), 'from') OR starts_with(regexp_replace(lower(x), '^[^\p{L}\p{N}]+', ''), 'thre'))"


@query(f"""WITH {PAGES_SQL}, w AS (SELECT document_id, page_no, string_split(body, ' ') AS w FROM line_pages),
f AS (SELECT *, greatest(coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: {HIT_SQL.replace('lower(x)', 'lower(w[i])')})), 1) - 9, 0) AS cut FROM w)
SELECT document_id, page_no, CASE WHEN cut > 0 THEN '… ' ELSE '' END || array_to_string(list_transform(w[cut + 1:cut + 24], lambda x: CASE WHEN {HIT_SQL} THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN len(w) > cut + 24 THEN ' …' ELSE '' END AS snippet FROM f""")
def marked_snippet(v: Views) -> DataFrame:
    return pages_of(v).select("document_id", "page_no", search.marked_snippet(F.col("body"), list(TERMS)).alias("snippet"))


#: Lines packed into chunks as the operator packs them, one line after the other.
CHUNKS_SQL = r"""RECURSIVE src AS (SELECT doc_id, rtrim(unnest(string_split(text, chr(10)))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM src WHERE trim(line) <> ''),
fold AS (SELECT doc_id, k, 1 AS chunk, length(line) AS used FROM ln WHERE k = 1
  UNION ALL SELECT ln.doc_id, ln.k, CASE WHEN f.used + length(ln.line) + 1 > 700 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + length(ln.line) + 1 > 700 THEN length(ln.line) ELSE f.used + length(ln.line) + 1 END
  FROM fold f JOIN ln ON ln.doc_id = f.doc_id AND ln.k = f.k + 1),
chunk AS (SELECT f.doc_id, f.chunk AS page_no, string_agg(ln.line, chr(10) ORDER BY ln.k) AS body FROM fold f JOIN ln ON ln.doc_id = f.doc_id AND ln.k = f.k GROUP BY 1, 2)"""


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, sha256(body) AS body FROM chunk")
def line_chunks(v: Views) -> DataFrame:
    return corpus.line_chunks(v("documents"), ["doc_id"], "text").select("doc_id", "page_no", F.sha2("body", 256).alias("body"))


@query(f"""WITH {CHUNKS_SQL}, last AS (SELECT doc_id, max(page_no) AS last_chunk FROM chunk GROUP BY 1), w AS (SELECT d.doc_id, greatest(1, least(d.n_chars % 7, l.last_chunk)) AS page_no, l.last_chunk FROM documents d JOIN last l USING (doc_id))
SELECT w.doc_id, CAST(w.page_no AS INTEGER) AS page_no, CAST(w.last_chunk AS INTEGER) AS last_chunk, sha256(c.body) AS body FROM w JOIN chunk c ON c.doc_id = w.doc_id AND c.page_no = w.page_no""")
def chunk_lookup(v: Views) -> DataFrame:
    chunks = corpus.line_chunks(v("documents"), ["doc_id"], "text")
    wanted = v("documents").select("doc_id", (F.col("n_chars") % 7).cast("int").alias("n"))
    return corpus.chunk_lookup(chunks, wanted, "doc_id").select("doc_id", "page_no", "last_chunk", F.sha2("body", 256).alias("body"))


@query(r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) AS INTEGER) AS page_no, body FROM (
SELECT conv_id, unnest(string_split(t, chr(10) || chr(10))) AS raw, trim(raw) AS body, unnest(range(1, len(string_split(t, chr(10) || chr(10))) + 1)) AS i FROM (
  SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY 1) c) x WHERE length(body) >= 10""")
def paragraph_pages(v: Views) -> DataFrame:
    talks = v("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n\n").alias("t"))
    return corpus.paragraph_pages(talks, ["conv_id"], "t")


@query("SELECT -(conv_id + 1) AS document_id, 'lesson ' || conv_id AS title, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def lessons(v: Views) -> DataFrame:
    return corpus.lessons(v("conversations"))


@query(f"WITH {PAGES_SQL} SELECT d.doc_id + 1 AS document_id, count(p.page_no) AS pages FROM documents d LEFT JOIN line_pages p ON p.document_id = d.doc_id + 1 GROUP BY 1")
def document_listing(v: Views) -> DataFrame:
    return corpus.document_listing(v("documents").select((F.col("doc_id") + 1).alias("document_id")), pages_of(v), "document_id")


@query(f"""WITH {PAGES_SQL}, m AS (SELECT document_id, avg(length(body)) AS mean FROM line_pages GROUP BY 1)
SELECT d.doc_id + 1 AS document_id, CASE WHEN mean IS NULL THEN 'no pages' ELSE 'likely scanned' END AS reason FROM documents d LEFT JOIN m ON m.document_id = d.doc_id + 1 WHERE mean IS NULL OR mean < 40""")
def skipped_documents(v: Views) -> DataFrame:
    return corpus.skipped_documents(v("documents").select((F.col("doc_id") + 1).alias("document_id")), pages_of(v), "document_id", 40.0)


@query(f"WITH {PAGES_SQL} SELECT document_id, page_no, max(page_no) OVER (PARTITION BY document_id) AS last_page FROM line_pages")
def page_text(v: Views) -> DataFrame:
    return corpus.last_page_window(pages_of(v)).select("document_id", "page_no", "last_page")


@query("SELECT CASE WHEN id < 0 THEN 'lesson' ELSE 'document' END AS kind, CASE WHEN id < 0 THEN title || ' #1' ELSE title || ' p.1' END AS label FROM (SELECT doc_id + 1 AS id, source AS title FROM documents UNION ALL SELECT DISTINCT -(conv_id + 1), 'lesson ' || conv_id FROM conversations) x")
def kind_of(v: Views) -> DataFrame:
    both = v("documents").select((F.col("doc_id") + 1).alias("id"), F.col("source").alias("title")).unionByName(corpus.lessons(v("conversations")).select(F.col("document_id").alias("id"), "title"))
    kind, label = search.kind_label(F.col("id"), F.col("title"), F.lit(1))
    return both.select(kind.alias("kind"), label.alias("label"))


@query("SELECT replace(replace(CAST(doc_id AS VARCHAR) || chr(9) || replace(replace(replace(coalesce(text, ''), chr(9), ' '), chr(10), ' '), chr(13), ' '), '', ''), '', '') AS line FROM documents")
def to_tsv(v: Views) -> DataFrame:
    return bank.to_tsv(v("documents").select("doc_id", "text"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'),
'(?i)</?(p|div|li|ul|h[1-6]|br|tr|article|section|nav|title)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages),
u AS (SELECT page_id, string_split(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), chr(10) || chr(10)) AS parts FROM t),
b AS (SELECT page_id, trim(unnest(parts)) AS body, unnest(range(1, len(parts) + 1)) AS i FROM u)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS page_no, sha256(body) AS body FROM b WHERE length(body) >= 10""")
def web_pages(v: Views) -> DataFrame:
    plain = v("pages").select("page_id", corpus.web_text(F.col("html")).alias("text"))
    return corpus.paragraph_pages(plain, ["page_id"], "text").select("page_id", "page_no", F.sha2("body", 256).alias("body"))


@query("""SELECT s_suppkey, s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0""")
def upsert_documents(v: Views) -> DataFrame:
    s = v("supplier").select("s_suppkey", "s_name", "s_acctbal")
    return bank.upsert(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal + 1 END ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def seed_merge(v: Views) -> DataFrame:
    s = v("supplier").select("s_suppkey", "s_acctbal")
    seed = s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") + 1))
    return bank.seed_merge(s.where("s_suppkey % 2 = 0"), seed, ["s_suppkey"], ["s_acctbal"])


@query("SELECT s_suppkey, coalesce(s_nationkey, -1) AS s_nationkey, 'new' AS track FROM supplier")
def evolve_schema(v: Views) -> DataFrame:
    return corpus.evolve_schema(v("supplier").select("s_suppkey", "s_nationkey"), {"s_nationkey": -1, "track": "new"})


@query(f"WITH {PAGES_SQL} SELECT count(*) AS pages, CAST(sum(length(body)) AS BIGINT) AS chars FROM line_pages")
def keep_meaningful_pages(v: Views) -> DataFrame:
    lines = v("documents").select(F.explode(F.split("text", "\n")).alias("body"))
    return corpus.keep_meaningful_pages(lines).agg(F.count("*").alias("pages"), F.sum(F.length("body")).alias("chars"))


@query(r"""SELECT lang, token, CAST(n AS BIGINT) AS n FROM (SELECT lang, token, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS k
FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) t GROUP BY 1, 2) x WHERE k <= 20""")
def top_tokens(v: Views) -> DataFrame:
    n = v("documents").select("lang", F.explode(tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("k <= 20").drop("k")


def arrivals(v: Views) -> tuple[str, str]:
    """Documents as they come in, one folder of files after the other: drafts of all, final texts of some sources, and documents that are taken back."""
    docs = v("documents").select((F.col("doc_id") + 1).alias("document_id"), F.col("source").alias("doc_type"), "lang", "text")
    rounds = [
        docs.withColumn("text", F.concat(F.lit("draft three\n"), F.coalesce("text", F.lit("")))), docs.where("doc_type >= 'src2'"),
        docs.where("lang = 'en'").withColumn("text", F.concat("text", F.lit("\nrevised from three sources"))), docs.where("doc_type = 'src4'").withColumn("text", F.lit(None).cast("string")),
    ]
    root = new_path(v.spark, "arrivals")
    for k, rows in enumerate(rounds):
        # A document is one row, so it never comes in two batches of the same version.
        rows.select("document_id", F.lit(k).cast("long").alias("version"), "doc_type", "text").coalesce(1).write.mode("append").parquet(root)
    return root, "document_id long, version long, doc_type string, text string"


def pages_of_arrivals(docs: DataFrame) -> DataFrame:
    """One page a line of ten characters or more; a document without one is a row with a null body."""
    parts = F.split("text", "\n")
    numbered = F.transform(parts, lambda x, i: F.struct((i + 1).alias("page_no"), x.alias("body")))
    kept = docs.withColumn("p", F.filter(numbered, lambda p: F.length(F.trim(p.body)) >= 10))
    return kept.select("document_id", "version", "doc_type", F.explode_outer("p").alias("p")).select("document_id", "version", F.col("p.page_no").alias("page_no"), "doc_type", F.col("p.body").alias("body"))


LAST_SQL = """last AS (SELECT doc_id + 1 AS document_id, source AS doc_type, CASE WHEN source = 'src4' THEN NULL WHEN lang = 'en' THEN text || chr(10) || 'revised from three sources'
  WHEN source >= 'src2' THEN text ELSE 'draft three' || chr(10) || coalesce(text, '') END AS text FROM documents)"""


@query(bm25_sql(PREFIX_TF, PREFIX_LEN).replace("WITH ", f"WITH {LAST_SQL}, ", 1).replace("doc_id + 1 AS document_id, source AS doc_type", "document_id, doc_type").replace("doc_id + 1 AS document_id, source AS doc_type", "document_id, doc_type").replace(LAST_SQL.replace("doc_id + 1 AS document_id, source AS doc_type", "document_id, doc_type"), LAST_SQL).replace("FROM documents) p", "FROM last) p") + """
SELECT document_id, page_no, round(score, 6) AS score, CAST(greatest(1, least(100, round_even(score / max(score) OVER () * 100, 0))) AS INTEGER) AS match_pct, count(*) OVER () AS total
FROM r ORDER BY r.score DESC, document_id, page_no LIMIT 200""")
def incremental_index(v: Views) -> DataFrame:
    """The best pages after documents came in and were replaced and removed, four batches and their merges later."""
    folder, schema = arrivals(v)
    root = new_path(v.spark, "segments")
    stream = pages_of_arrivals(jobs.event_stream(v.spark, folder, schema, spent=True))
    jobs.incremental_index(stream, root, new_path(v.spark, "segments-state"), most=2).start().awaitTermination()
    found = search.search_index(index.open_segments(v.spark, root), " ".join(TERMS), limit=200)
    return found.select("document_id", "page_no", F.round("score", 6).alias("score"), "match_pct", "total")
