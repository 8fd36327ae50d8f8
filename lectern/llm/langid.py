"""Operator 9: language ID by bit-sliced Bloom filters of n-grams.

Each language's filter holds its most frequent n-grams. The filters share their
positions: row p of the table has one bit for each language, so the bitwise and of an
n-gram's rows gives all languages that contain it at once. A text's n-grams are counted
for each language, counts are corrected for the filter's rate of false positives, and
the largest decides.

The filters are learnt from a bounded sample, SAMPLE whole documents of each language
chosen by a digest of the id, in distributed counts; GRAMS n-grams of each reach the
driver.

Defined results: null text or text without a letter is `und` with score 0; so is every
text if nothing could be learnt; ties go to the language that sorts first; a null id
counts as an empty one when it is dealt to training or held out; repeated rows repeat
their results; texts of any length are read whole; an empty table gives an empty result;
kept columns of the input stay as they are, and results whose names they have get
underscores behind theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.arrow_io import append_columns
from lectern.llm.grams import TextSums, gram_hashes, has_letter, words_of
from lectern.scratch import written

ORDERS = (2, 3, 4, 5)
#: Documents of each language to learn from.
SAMPLE = 1500
#: N-grams in each language's filter.
GRAMS = 20_000
ROWS = 1 << 18
HASHES = 4
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Filters:
    """The table (ROWS x bytes of language bits), the languages, and each one's rate of false positives."""

    table: np.ndarray
    langs: list[str]
    wrong: np.ndarray

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, one column of 0 or 1 for each language whose filter holds it."""
        mask = np.full((len(grams), self.table.shape[1]), 255, np.uint8)
        for rows in positions(grams):
            mask &= self.table[rows]
        return np.unpackbits(mask, axis=1, bitorder="little")[:, : len(self.langs)]


def positions(grams: np.ndarray) -> list[np.ndarray]:
    low, high = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) % np.uint64(ROWS)).astype(np.int64) for i in range(HASHES)]


def build(languages: np.ndarray, grams: np.ndarray) -> Filters:
    """Filters of (language, n-gram hash) pairs, given as two arrays."""
    langs, of = np.unique(np.asarray(languages, object).astype(str), return_inverse=True)
    table = np.zeros((ROWS, max(1, -(-len(langs) // 8))), np.uint8)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(langs) + 1))
    for k in range(len(langs)):
        own = np.asarray(grams, np.int64)[order[ends[k] : ends[k + 1]]].view(np.uint64)
        for rows in positions(own):
            table[rows, k // 8] |= np.uint8(1 << k % 8)
    ones = [int(((table[:, k // 8] >> k % 8) & 1).sum()) for k in range(len(langs))]
    return Filters(table, langs.tolist(), (np.array(ones, float) / ROWS) ** HASHES)


def sample(df: DataFrame, doc_id: str, text: str, lang: str, size: int) -> DataFrame:
    """Columns lang and text of up to `size` documents of each language, none held out, chosen by a digest of the id."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = own.where(~held_out(F.col("doc_id"))).withColumn("draw", F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)))
    rates = own.groupBy("lang").agg((F.lit(1.2 * size) / F.count("*")).alias("rate")).withColumnRenamed("lang", "of")
    rates = written(rates, "rates")  # one row a language, whose size then decides that texts needn't be shuffled
    near = own.join(rates, F.col("lang") == F.col("of")).where(F.col("draw") < F.col("rate") * F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).select("lang", "text")


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE, grams: int = GRAMS) -> Filters:
    """The filters of at most `grams` n-grams of each language, the most frequent in the sample; of those that tie for the last places none is in."""

    def count(batches):
        for batch in batches:
            found: dict[str, dict[str, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                distinct = found.setdefault(lang, {})
                for w in words_of(text):
                    distinct[w] = distinct.get(w, 0) + 1
            for lang, distinct in sorted(found.items()):
                if distinct:
                    owner, h = gram_hashes(list(distinct), ORDERS)
                    keys, at = np.unique(h, return_inverse=True)
                    n = np.bincount(at, weights=np.fromiter(distinct.values(), float)[owner]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    grouped = sample(df, doc_id, text, lang, size).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram")
    counted = written(grouped.agg(F.sum("n").alias("n")), "gram-counts")
    # The least count that at most `grams` n-grams of a language reach: found from how many have each count.
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    sizes = counted.groupBy("lang", "n").agg(F.count("*").alias("k")).withColumn("upto", upto)
    # The largest count is in however many reach it, as in a sample so small that all are equal.
    least = written(sizes.where((F.col("upto") <= grams) | (F.col("upto") == F.col("k"))).groupBy("lang").agg(F.min("n").alias("least")), "least-counts")
    top = counted.join(least, "lang").where(F.col("n") >= F.col("least"))
    found = top.select("lang", "gram").toArrow()
    return build(found["lang"].to_numpy(zero_copy_only=False), found["gram"].to_numpy())


def identify(df: DataFrame, filters: Filters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all), `lang_pred` and `score`: the part of the text's n-grams, corrected, that its language's filter holds."""
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def compute():
        f = shared.value
        width = len(f.langs) + 1

        def features(words: list[str]) -> np.ndarray:
            out = np.zeros((len(words), width), np.int32)
            if words:
                owner, h = gram_hashes(words, ORDERS)
                held = f.containing(h)
                for k in range(width - 1):
                    out[:, k] = np.bincount(owner, weights=held[:, k], minlength=len(words))
                out[:, -1] = np.bincount(owner, minlength=len(words))
            return out

        sums = TextSums(features)

        def work(texts: pa.Array) -> list[pa.Array]:
            texts = texts.to_pylist()
            got, _ = sums(texts)
            n = got[:, -1:]
            if width == 1:
                return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
            hits = (got[:, :-1] - n * f.wrong) / (1 - f.wrong)
            best = hits.argmax(axis=1)
            score = np.clip(hits[np.arange(len(texts)), best] / np.maximum(n[:, 0], 1), 0, 1)
            unknown = [not has_letter(t) for t in texts]
            return [pa.array([UNKNOWN if u else f.langs[b] for u, b in zip(unknown, best)]), pa.array(np.where(unknown, 0.0, score))]

        return work

    return append_columns(df, text, keep, added, compute)
