"""Evidence search: pages, postings, BM25, snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lectern.functions.text import occurrences, query_terms, squeezed, tokens
from lectern.functions.windows import relative_pct
from lectern.operators.index import Index, PieceIndex, build_index, build_piece_index, places_of_terms
from lectern.scratch import written

K1, B = 1.5, 0.75


def build_postings(pages: DataFrame, body: str = "body") -> DataFrame:
    """token, document_id, page_no, tf and the page's number of tokens."""
    t = pages.select("document_id", "page_no", tokens(F.col(body)).alias("ts"))
    t = t.select("document_id", "page_no", F.size("ts").cast("long").alias("page_tokens"), F.explode("ts").alias("token"))
    return t.groupBy("token", "document_id", "page_no").agg(F.count("*").alias("tf"), F.max("page_tokens").alias("page_tokens"))


def holds_prefix(body: Column, term: str) -> Column:
    """Some token starts with the term."""
    return F.exists(tokens(body), lambda t: t.startswith(term.lower()))


def starts_with(term: str) -> Callable[[Column], Column]:
    return lambda x: x.startswith(term.lower())


def prefix_and_match(pages: DataFrame, terms: list[str], body: str = "body") -> DataFrame:
    """Pages in which, for every term, some token starts with it; no terms match nothing."""
    if not terms:
        return pages.limit(0)
    return pages.where(reduce(lambda a, b: a & b, (holds_prefix(F.col(body), t) for t in terms)))


def substring_and_match(pages: DataFrame, terms: list[str], body: str = "body") -> DataFrame:
    """Pages whose text without white space holds every term."""
    if not terms:
        return pages.limit(0)
    norm = squeezed(F.col(body))
    return pages.where(reduce(lambda a, b: a & b, (F.contains(norm, F.lit(t.lower())) for t in terms)))


def bm25(pages: DataFrame, terms: list[str], mode: str = "prefix", body: str = "body") -> DataFrame:
    """Matching pages with `score`; frequencies and the mean length are the whole corpus's."""
    if mode == "prefix":
        ts = tokens(F.col(body))
        base = pages.withColumn("__ts", ts)
        tf = [F.size(F.filter("__ts", starts_with(t))).cast("long") for t in terms]
        length = F.size("__ts")
    else:
        base = pages.withColumn("__ts", squeezed(F.col(body)))
        tf = [occurrences(F.col("__ts"), F.lit(t.lower())) for t in terms]
        length = F.length("__ts")
    counted = base.withColumn("__len", F.coalesce(length.cast("long"), F.lit(0))).withColumns({f"__tf{i}": c for i, c in enumerate(tf)}).drop("__ts")
    stats = counted.agg(
        F.count("*").alias("__n"), F.greatest(F.coalesce(F.avg("__len"), F.lit(0.0)), F.lit(1.0)).alias("__avg"),
        *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))),
    )
    hits = counted.where(reduce(lambda a, b: a & b, (F.col(f"__tf{i}") > 0 for i in range(len(terms))), F.lit(bool(terms))))
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    parts = [
        F.log(1 + (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
        for i in range(len(terms))
    ]
    scored = joined.withColumn("score", reduce(lambda a, b: a + b, parts, F.lit(0.0)))
    return scored.select(*pages.columns, "score")


def search(pages: DataFrame, query: str, limit: int = 60, doc_id: int | None = None, doc_type: str | None = None, mode: str = "prefix") -> DataFrame:
    """The best pages with score, match_pct and, apart from the limit, the total of matches.

    Filters come before the limit, so they never cost matches.
    """
    found = bm25(pages, query_terms(query), mode)
    if doc_id is not None:
        found = found.where(F.col("document_id") == doc_id)
    if doc_type is not None:
        found = found.where(F.col("doc_type") == doc_type)
    best = found.agg(F.max("score").alias("__best"), F.count("*").alias("total"))
    out = found.crossJoin(F.broadcast(best)).withColumn("match_pct", relative_pct(F.col("score"), F.col("__best")))  # one row
    return out.drop("__best").orderBy(F.desc("score"), "document_id", "page_no").limit(limit)


def part_of_score(index: Index, tf: Column, df: Column, length: Column) -> Column:
    return F.log(1 + (F.lit(index.pages) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(index.mean_tokens)))


def search_index(index: Index, query: str, limit: int = 60, doc_id: int | None = None, doc_type: str | None = None) -> DataFrame:
    """What `search` gives in prefix mode, from the stored index: only postings of tokens that start with a term are read."""
    terms = [t.lower() for t in query_terms(query)]
    if not terms:
        return index.postings.select("document_id", "page_no", "doc_type", F.lit(0.0).alias("score"), F.lit(0).alias("match_pct"), F.lit(0).cast("long").alias("total")).limit(0)
    fits = [F.col("token").startswith(t) for t in terms]
    read = index.postings.where(reduce(lambda a, b: a | b, fits))
    tf = [F.coalesce(F.sum(F.when(f, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, f in enumerate(fits)]
    hits = read.groupBy("document_id", "page_no").agg(F.first("doc_type").alias("doc_type"), F.first("page_tokens").alias("len"), *tf)
    df = hits.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    whole = hits.where(reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(len(terms)))))
    parts = [part_of_score(index, F.col(f"tf{i}"), F.col(f"df{i}"), F.col("len")) for i in range(len(terms))]
    found = whole.crossJoin(F.broadcast(df)).withColumn("score", reduce(lambda a, b: a + b, parts, F.lit(0.0)))  # one row
    if doc_id is not None:
        found = found.where(F.col("document_id") == doc_id)
    if doc_type is not None:
        found = found.where(F.col("doc_type") == doc_type)
    best = found.agg(F.max("score").alias("best"), F.count("*").alias("total"))
    out = found.select("document_id", "page_no", "doc_type", "score").crossJoin(F.broadcast(best))  # one row
    out = out.withColumn("match_pct", relative_pct(F.col("score"), F.col("best"))).drop("best")
    return out.orderBy(F.desc("score"), "document_id", "page_no").limit(limit)


#: Letters by which terms and tokens meet in `search_many`.
PREFIX = 3


def search_many(index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """For each query (query_id, term: one row a term) its best pages by exact tokens that start with the terms.

    Terms meet the vocabulary, not the postings, by their first letters: a token has heads of 1 to PREFIX letters. The
    pairs are stored, so their size decides whether the postings are shuffled to meet them.
    """
    terms = queries.select("query_id", F.lower("term").alias("term")).where("term <> ''").distinct()
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(PREFIX))), lambda k: F.substr(F.col("token"), F.lit(1), k))
    asked = written(terms.select("term").distinct().withColumn("head", F.substring("term", 1, PREFIX)), "terms")
    vocabulary = index.vocabulary.select("token", F.explode(heads).alias("head"))
    pairs = written(vocabulary.join(asked, "head").where(F.expr("startswith(token, term)")).select("term", "token"), "term-tokens")
    hits = index.postings.join(pairs, "token").groupBy("term", "document_id", "page_no").agg(F.sum("tf").alias("tf"), F.max("page_tokens").alias("len"))
    hits = written(hits, "term-hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    one = hits.join(df, "term").withColumn("part", part_of_score(index, F.col("tf"), F.col("df"), F.col("len")))
    per_page = terms.join(one, "term").groupBy("query_id", "document_id", "page_no").agg(F.sum("part").alias("score"), F.count("*").alias("have"))
    full = per_page.join(need, "query_id").where("have = need")
    # Scores are sums in any order: ranks go by what is the same in every order.
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "document_id", "page_no")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "document_id", "page_no", "score", "rank")


def proximity(norm: Column, terms: list[str]) -> Column:
    """From 0 to 1, the nearer the terms stand together: 1 - (span - least span) / 140 of the narrowest stretch with all terms.

    Start places of each term, 60 at most, are arrays; the narrowest stretch starts at one of them, so for each start the
    nearest ends of the other terms behind it give its span.
    """
    if len(terms) < 2:
        return F.lit(1.0)
    def starts(term: str) -> Column:
        pieces = F.split(norm, "\\Q" + term.lower() + "\\E", 62)
        size = len(term)
        some = F.slice(pieces, 1, F.greatest(F.lit(0), F.least(F.size(pieces) - 1, F.lit(60))))
        return F.aggregate(some, F.array().cast("array<int>"), lambda at, x: F.concat(at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)) + size, F.lit(0)) + F.length(x))))

    places = [(len(t), starts(t)) for t in terms]

    def end_behind(s: Column, size: int, at: Column) -> Column:
        return F.array_min(F.transform(F.filter(at, lambda x: x >= s), lambda x: x + size))

    def span(s: Column) -> Column:
        reach = [end_behind(s, size, at) for size, at in places]
        whole = reduce(lambda a, b: a & b, (r.isNotNull() for r in reach))
        return F.when(whole, F.greatest(*reach) - s)

    best = F.array_min(F.transform(F.flatten(F.array(*(at for _, at in places))), span))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - (best - sum(map(len, terms))) / F.lit(140.0)), F.lit(0.0))


#: Hits of a term that are looked at for nearness.
HITS = 60


def narrowest(at: list[Column], sizes: list[int]) -> Column:
    """The shortest stretch with a hit of every term, from arrays of where the terms' hits begin; null if there is none.

    One sweep over the merged lists from the last hit to the first: each term's nearest end is kept, and every hit may
    begin a stretch.
    """
    begun = F.flatten(F.array(*(F.transform(a, lambda x: F.struct(x.alias("at"), F.lit(i).alias("term"))) for i, a in enumerate(at))))  # noqa: B023
    start = F.struct(*(F.lit(None).cast("int").alias(f"e{i}") for i in range(len(at))), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, hit: Column) -> Column:
        ends = [F.when(hit.term == i, hit["at"] + n).otherwise(acc[f"e{i}"]) for i, n in enumerate(sizes)]
        span = F.when(reduce(lambda a, b: a & b, (e.isNotNull() for e in ends)), (F.greatest(*ends) if len(ends) > 1 else ends[0]) - hit["at"])
        return F.struct(*(e.alias(f"e{i}") for i, e in enumerate(ends)), F.least(acc.best, span).alias("best"))

    return F.aggregate(F.reverse(F.array_sort(begun)), start, step, lambda acc: acc.best)


def nearness(at: list[Column], terms: list[str]) -> Column:
    """What `proximity` gives, from places."""
    if len(terms) < 2:
        return F.lit(1.0)
    best = narrowest([F.slice(a, 1, HITS) for a in at], [len(t) for t in terms])
    return F.coalesce(F.greatest(F.lit(0.0), 1 - (best - sum(map(len, terms))) / F.lit(140.0)), F.lit(0.0))


def search_pieces(index: PieceIndex, query: str) -> DataFrame:
    """(document_id, page_no, score, proximity) of the pages that hold every term of a query anywhere, from a stored index of pieces.

    The same as `bm25` by substrings and `proximity`, without reading the pages' text.
    """
    terms = [t.lower() for t in query_terms(query)]
    if not terms:
        return index.postings.select("document_id", "page_no", F.lit(0.0).alias("score"), F.lit(0.0).alias("proximity")).limit(0)
    hits = places_of_terms(index, terms)
    hits = hits.withColumns({f"tf{i}": F.size(f"at{i}").cast("long") for i in range(len(terms))})
    df = hits.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    whole = hits.where(reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(df))  # one row
    totals = Index(index.postings, index.postings, index.pages, index.mean_letters)
    parts = [part_of_score(totals, F.col(f"tf{i}"), F.col(f"df{i}"), F.col("letters")) for i in range(len(terms))]
    near = nearness([F.col(f"at{i}") for i in range(len(terms))], terms)
    return whole.select("document_id", "page_no", reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score"), near.alias("proximity"))


def search_near_pieces(index: PieceIndex, query: str, limit: int = 60) -> DataFrame:
    """What `search_near` gives, from a stored index of pieces."""
    found = search_pieces(index, query).withColumn("score", F.col("score") * (1 + NEARNESS * F.col("proximity"))).drop("proximity")
    return found.orderBy(F.desc("score"), "document_id", "page_no").limit(limit)


def snippet(body: Column, term: Column, before: int = 45, after: int = 80) -> Column:
    """Text around the first hit, or the first 160 characters."""
    at = F.instr(F.lower(body), F.lower(term))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(body, start, at - start + F.length(term) + after)).otherwise(F.substring(body, 1, 160))


#: How much nearness adds to a score at most.
NEARNESS = 2.2


def search_near(pages: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """The best pages by substrings, their scores raised where the terms stand together."""
    terms = query_terms(query)
    near = proximity(squeezed(F.col("body")), terms)
    found = bm25(pages, terms, "substring").withColumn("score", F.col("score") * (1 + NEARNESS * near))
    return found.orderBy(F.desc("score"), "document_id", "page_no").limit(limit)


def marked_snippet(body: Column, terms: list[str], before: int = 8, size: int = 24) -> Column:
    """`size` words from `before` words before the first hit on, hits in brackets, ` … ` where text is left out; the first words if there is no hit.

    A word is a hit if it starts with a term, marks before its first letter apart.
    """
    words = F.split(body, " ")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+", "")
    hit = lambda w: reduce(lambda a, b: a | b, (bare(w).startswith(t.lower()) for t in terms), F.lit(False))
    first = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(first - before, F.lit(0))
    shown = F.transform(F.slice(words, start + 1, F.lit(size)), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(start > 0, "… ").otherwise(""), F.array_join(shown, " "), F.when(F.size(words) > start + size, " …").otherwise(""))


def kind_label(document_id: Column, title: Column, page_no: Column) -> tuple[Column, Column]:
    """(kind, label): negative ids are lessons."""
    lesson = document_id < 0
    kind = F.when(lesson, "lesson").otherwise("document")
    label = F.when(lesson, F.concat(title, F.lit(" #"), page_no.cast("string"))).otherwise(F.concat(title, F.lit(" p."), page_no.cast("string")))
    return kind, label


#: Letters of the phrases, about, that are looked for in one pass over the corpus.
LETTERS = 1 << 22


def holders(phrases: list[tuple], corpus: DataFrame, kind: T.DataType) -> DataFrame:
    """(phrase_id, doc_id) for each document that holds a phrase, all phrases at once by one automaton; each pair once for a row."""
    shared = corpus.sparkSession.sparkContext.broadcast(phrases)
    out = T.StructType([T.StructField("phrase_id", kind), corpus.schema["doc_id"]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[str, list] = {}
        for key, phrase in shared.value:
            owners.setdefault(phrase, []).append(key)
        everywhere = owners.pop("", [])
        automaton = ahocorasick.Automaton()
        for phrase, keys in owners.items():
            automaton.add_word(phrase, keys)
        automaton.make_automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, found, rows = batch.slice(at, 512), [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    held = {id(keys): keys for _, keys in automaton.iter(text)} if len(owners) else {}
                    own = everywhere + [k for keys in held.values() for k in keys]
                    found += own
                    rows += [row] * len(own)
                ids = pa.array(found, arrow_kind)
                yield pa.RecordBatch.from_arrays([ids, part.column(0).take(pa.array(rows, pa.int64()))], names=["phrase_id", "doc_id"])

    arrow_kind = to_arrow_type(kind)
    return corpus.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(find, out)


def attested(phrases: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """For each phrase (phrase_id, phrase): in how many documents it occurs, and the first n of them.

    Phrases are looked for in blocks of about LETTERS letters, each in one pass over the whole texts. Documents count
    once, whatever their rows; a null phrase is in none, the empty one in all that have a text.
    """
    p = written(phrases.where(F.col("phrase").isNotNull()).select("phrase_id", "phrase"), "phrases")
    blocks = -(-(p.agg(F.sum(F.length("phrase") + 1)).first()[0] or 1) // LETTERS)
    dealt = p.withColumn("block", F.pmod(F.xxhash64("phrase_id", "phrase"), F.lit(blocks)))
    kind = p.schema["phrase_id"].dataType
    parts = [holders([tuple(r) for r in dealt.where(F.col("block") == b).select("phrase_id", "phrase").collect()], corpus, kind) for b in range(blocks)]
    hits = written(reduce(DataFrame.unionByName, parts).distinct(), "attested")
    order = Window.partitionBy("phrase_id").orderBy("doc_id")
    first = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    sample = first.groupBy("phrase_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("sample"))
    count = hits.groupBy("phrase_id").agg(F.count("*").alias("documents"))
    out = phrases.select("phrase_id").join(count, "phrase_id", "left").join(sample, "phrase_id", "left")
    return out.select("phrase_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("sample", F.lit("")).alias("sample"))


def phrase_occurrences(df: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """For each phrase its occurrences without overlap and the rows that hold it, in one pass."""
    each = F.array(*(F.struct(F.lit(p).alias("phrase"), occurrences(F.col(text), F.lit(p)).alias("n")) for p in phrases))
    return df.select(F.explode(each).alias("x")).groupBy("x.phrase").agg(F.sum(F.coalesce("x.n", F.lit(0))).alias("occurrences"), F.count_if(F.col("x.n") > 0).alias("containing"))


def term_hit_counts(df: DataFrame, terms: list[str], text: str) -> DataFrame:
    """Rows whose text holds each term."""
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.contains(F.lower(F.col(text)), F.lit(t.lower())).alias("hit")) for t in terms))
    return df.select(F.explode(each).alias("x")).groupBy("x.term").agg(F.count_if("x.hit").alias("hits"))


def standard_terms(texts: DataFrame, points: int) -> DataFrame:
    """(code, term, points): the different terms of a standard's texts (code, text), however many rows there are for it."""
    return texts.select("code", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct().withColumn("points", F.lit(points))


def standard_candidates(contexts: DataFrame, bodies: DataFrame, propositions: DataFrame, stop: list[str], k: int = 5) -> DataFrame:
    """For each context (context_id, text): the standards that share terms, 2 points for each in their body and 3 in their propositions (both code, text)."""
    terms = contexts.select("context_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where((F.length("term") >= 2) & ~F.col("term").isin(stop))
    words = standard_terms(bodies, 2).unionByName(standard_terms(propositions, 3)).join(terms.select("term").distinct(), "term", "left_semi")
    words = words.groupBy("code", "term").agg(F.sum("points").alias("points"))
    got = terms.join(words, "term").groupBy("context_id", "code").agg(F.sum("points").cast("long").alias("points"))
    order = Window.partitionBy("context_id").orderBy(F.desc("points"), "code")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
