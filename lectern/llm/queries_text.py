"""Queries over whole tables with production parameters: thin uses of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, fim, gif, hard_negatives, langid, licences, mixing, partenum, radix_dedup, sharding, simhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The path of the word-end BPE file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame) -> DataFrame:
    decoded = bpe.bpe_encode(docs, word_tokenizer(), keep=["doc_id"], decode=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: token counts and digests."""
    return token_digests(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return radix_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of their links."""
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by filters of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and their lines, that are the text of a known licence."""
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents put into 40 shards of nearly equal sizes."""
    return sharding.shards_of(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.read_back(table(spark, sf_dir, "pages"))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIFs and read back."""
    return gif.media_digests(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and restored: forms, lengths and digests."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = fim.restored(made)
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    found = hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
    return found.drop("anchor_row", "positive_row", "negative_row")


def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their n-gram set and the component of similar sets."""
    return partenum.similar_sets(table(spark, sf_dir, "documents"))
