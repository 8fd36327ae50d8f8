"""Corpus sources and sinks: inventories, pages and chunks, reports, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Formats by file ending.
FORMATS = {"pdf": "PDF", "hwp": "HWP", "hwpx": "HWP", "docx": "Word", "pptx": "PowerPoint", "xlsx": "Excel", "txt": "Text", "md": "Text", "json": "JSON", "parquet": "Parquet"}


def corpus_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with ending, format label and length; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    label = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return files.withColumn("ext", ext).withColumn("format", F.coalesce(F.try_element_at(label, F.col("ext")), F.lit("other"))).orderBy("path")


def paragraph_pages(docs: DataFrame, key: list[str], text: str, sep: str = "\n\n", least: int = 10) -> DataFrame:
    """Blocks between blank lines of at least `least` characters, numbered from 1 after the filter."""
    blocks = F.filter(F.transform(F.split(F.col(text), sep), lambda b: F.trim(b)), lambda b: F.length(b) >= least)
    return docs.select(*key, F.posexplode(blocks).alias("at", "body")).select(*key, (F.col("at") + 1).alias("page_no"), "body")


def keep_meaningful_pages(pages: DataFrame, least: int = 10) -> DataFrame:
    return pages.where(F.length(F.trim("body")) >= least)


def line_chunks(docs: DataFrame, key: list[str], text: str, size: int = 700) -> DataFrame:
    """Lines packed greedily into chunks of about `size` characters; a line is never split, blank lines go."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc.buf != "") & (F.length(acc.buf) + F.length(line) + 1 > size)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.buf))).otherwise(acc.done).alias("done"),
            F.when(full | (acc.buf == ""), line).otherwise(F.concat(acc.buf, F.lit("\n"), line)).alias("buf"),
        )

    chunks = F.aggregate(lines, start, step, lambda acc: F.when(acc.buf != "", F.concat(acc.done, F.array(acc.buf))).otherwise(acc.done))
    return docs.select(*key, F.posexplode(chunks).alias("at", "body")).select(*key, (F.col("at") + 1).alias("page_no"), "body")


def chunk_lookup(chunks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Chunk n of each wanted document (key, n), n held between 1 and the last."""
    last = chunks.groupBy(key).agg(F.max("page_no").alias("last_chunk"))
    w = wanted.join(last, key).withColumn("page_no", F.greatest(F.lit(1), F.least("n", "last_chunk")))
    return w.join(chunks, [key, "page_no"])


def skipped_documents(docs: DataFrame, pages: DataFrame, key: str, mean: float = 15.0) -> DataFrame:
    """Documents without a page, and those with fewer characters a page than a text has."""
    per = pages.groupBy(key).agg(F.avg(F.length("body")).alias("mean_chars"))
    both = docs.select(key).join(per, key, "left")
    return both.where(F.col("mean_chars").isNull() | (F.col("mean_chars") < mean)).select(key, F.when(F.col("mean_chars").isNull(), "no pages").otherwise("likely scanned").alias("reason"))


def reindex(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Chunks with those of the incoming lessons replaced; an incoming lesson without text removes its chunks."""
    kept = current.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(line_chunks(incoming, [key], "text").select(*current.columns))


def document_listing(docs: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    return docs.join(pages.groupBy(key).agg(F.count("*").alias("pages")), key, "left").withColumn("pages", F.coalesce("pages", F.lit(0)))


def page_text(pages: DataFrame, document_id: int, page_no: int) -> DataFrame:
    """One page with the number of its document's last page."""
    own = pages.where(F.col("document_id") == document_id)
    last = own.agg(F.max("page_no").alias("last_page"))
    return own.where(F.col("page_no") == page_no).crossJoin(F.broadcast(last))  # one row


def evolve_schema(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns added with their default; nulls of present ones filled."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def read_ocr_words(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Words with boxes of OCR sidecars: {"page": n, "words": [{"text", "bbox": [x0, y0, x1, y1], "confidence"}]}.

    A sidecar is a file, or with `one_a_line` a line of files that have many, which Spark can split.
    """
    schema = "page int, words array<struct<text:string,bbox:array<double>,confidence:double>>"
    raw = spark.read.schema(schema).option("multiLine", not one_a_line).json(path).withColumn("file", F.input_file_name())
    w = raw.select("file", F.col("page").alias("page_no"), F.posexplode("words").alias("word_no", "w"))
    return w.select("file", "page_no", "word_no", "w.text", *(F.col("w.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), "w.confidence")


def publish_report(df: DataFrame, path: str, order: list[str], form: str = "json") -> None:
    """A report in a fixed order, complete or absent by the writer's commit; `md` is a table in Markdown, nulls as empty cells."""
    if form != "md":
        df.orderBy(*order).write.mode("overwrite").format(form).save(path)
        return
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]\s*", " ")
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]
    body = df.select(F.lit(2).alias("part"), row([cell(c) for c in df.columns]).alias("line"), *keys)
    head = df.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), row(cells).alias("line")) for i, cells in enumerate(([F.lit(c) for c in df.columns], [F.lit("---")] * len(df.columns)))))).alias("x")).select("x.*")
    lines = head.unionByName(body, allowMissingColumns=True).orderBy("part", *(f"k{i}" for i in range(len(order))))
    lines.select("line").write.mode("overwrite").text(path)


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The whole snapshots below `root`, the newest first; a version counts from when its mark is written."""
    path, fs = _files(spark, root)
    if not fs.exists(path(root)):
        return []
    found = [int(f.getPath().getName().removeprefix("version=")) for f in fs.listStatus(path(root)) if f.getPath().getName().startswith("version=")]
    return sorted((n for n in found if fs.exists(path(f"{root}/version={n}/_SUCCESS"))), reverse=True)


def snapshot(tables: dict[str, DataFrame], root: str, slots: int = 3, keep: tuple[int, ...] = ()) -> None:
    """Write all tables as a new version; of the older ones the newest `slots` - 1 stay, and those in `keep`.

    Nothing is renamed or written over: readers of a version aren't disturbed, and a failed snapshot leaves no mark.
    """
    spark = next(iter(tables.values())).sparkSession
    path, fs = _files(spark, root)
    new = 1 + max((int(f.getPath().getName().removeprefix("version=")) for f in (fs.listStatus(path(root)) if fs.exists(path(root)) else []) if f.getPath().getName().startswith("version=")), default=0)
    for name, df in tables.items():
        df.write.parquet(f"{root}/version={new}/table={name}")
    fs.create(path(f"{root}/version={new}/_SUCCESS")).close()
    for old in versions(spark, root)[slots:]:
        if old not in keep:
            fs.delete(path(f"{root}/version={old}"), True)


def list_snapshots(spark: SparkSession, root: str, tables: list[str], slots: int = 3) -> DataFrame:
    """slot (1 is the newest), table and rows of every snapshot that is there."""
    path, fs = _files(spark, root)
    out = spark.createDataFrame([], "slot int, table string, rows long")
    for k, n in enumerate(versions(spark, root)[:slots], 1):
        for t in tables:
            if fs.exists(path(f"{root}/version={n}/table={t}")):
                rows = spark.read.parquet(f"{root}/version={n}/table={t}")
                out = out.unionByName(rows.agg(F.lit(k).alias("slot"), F.lit(t).alias("table"), F.count("*").alias("rows")))
    return out


def restore(spark: SparkSession, root: str, slot: int, table: str, current: dict[str, DataFrame] | None = None, slots: int = 3) -> DataFrame:
    """A table of a snapshot; the `current` tables, if given, become the newest snapshot first, and the restored one stays."""
    version = versions(spark, root)[slot - 1]
    if current:
        snapshot(current, root, slots, keep=(version,))
    return spark.read.parquet(f"{root}/version={version}/table={table}")


def lessons(conversations: DataFrame) -> DataFrame:
    """Conversations as lessons: turns in order, a negative document id."""
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n")
    return conversations.groupBy("conv_id").agg(t.alias("text")).select((-(F.col("conv_id") + 1)).alias("document_id"), F.concat(F.lit("lesson "), F.col("conv_id").cast("string")).alias("title"), "text")


def web_text(html: Column) -> Column:
    """Text of a web page: scripts and styles dropped, block tags to blank lines, entities undone."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|li|ul|h[1-6]|br|tr|article|section|nav|title)[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def day_gate(snapshots: DataFrame, today: Column) -> DataFrame:
    """Whether today's automatic snapshot is still to be made (snapshots: at)."""
    return snapshots.agg((F.count_if(F.to_date("at") == today) == 0).alias("due"))


def last_page_window(pages: DataFrame) -> DataFrame:
    return pages.withColumn("last_page", F.max("page_no").over(Window.partitionBy("document_id")))
