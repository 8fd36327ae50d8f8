"""From documents to tokens: each stage calls one operator on all that the stage before it kept.

A stage's result is written as Parquet and read again as the next one's documents, so a
lost executor costs no more than tasks of the stage at hand; the table before it is then
deleted.

Defined results: null texts, empty ones and those without a letter go in the first
stage; of rows with equal or nearly equal texts one stays, that with the smallest id,
one without an id only where no other is there; ties and repeated rows are copies like
any other; texts of any length are read whole; an empty table gives an empty result; all
stages but the last return the columns of their input, with what is in them, whatever
other columns there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import scratch
from lectern.llm import langid, mixing, radix_dedup, simhash
from lectern.llm.queries_text import table, token_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found: null texts and texts without a letter."""
    found = langid.identify(docs, langid.learn(docs))
    lang_pred = found.columns[len(docs.columns)]
    return found.where(F.col(f"`{lang_pred}`") != langid.UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of the documents with equal normalised texts."""
    return radix_dedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts whose SimHashes are near and whose five-word shingles have a similarity of 0.8 or more."""
    return simhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_copies(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document in the mix."""
    return token_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", bpe),
]

#: Bloom filters and links of near copies aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of `sf_dir`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.forget(before)
        before = docs
    return docs
