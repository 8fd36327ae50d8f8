"""Operator 6: toxicity by subword-bag embeddings and a linear softmax.

A word is the mean of its character n-grams' embeddings, a document the mean of its
words', and a linear softmax on top gives the class. Embeddings and softmax start at
random and are trained jointly in numpy: EPOCHS passes over batches of BATCH documents,
the steps of an embedding shrinking with the gradients it has seen, and each step
followed by the proximal one of a group penalty, which takes the embeddings of n-grams
that tell nothing to zero. Documents labelled 1 weigh TOXIC_WEIGHT times as much.

Training reads a bounded sample: PER_CLASS toxic documents and CLEAN_SHARE times as many
others, chosen by a digest of the id, and of each no more documents than have ENTRIES
times as many different words between them. Words are counted on the executors; the
driver holds the sample's counts only, as arrays.

As everything above the embeddings is linear until the softmax, scoring needs one
number for each n-gram, its part of the difference of the two logits; that table is
broadcast, its size fixed by BUCKETS. Misspelt words unseen in training share n-grams
with seen ones.

Defined results: a text without words, null or empty, scores the softmax's bias alone;
labels other than 0 and 1 are ignored; a document with several labels counts once for
each; repeated rows repeat their scores; texts of any length are scored whole; if the
sample lacks a class, every score is 0; an empty table gives an empty result; other
columns are ignored, and kept ones stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.arrow_io import append_columns
from lectern.llm.grams import TOGETHER, TextSums, gram_hashes, words_of
from lectern.llm.langid import held_out

ORDERS = (3, 4, 5)
BUCKETS = 1 << 21
DIM = 4
PER_CLASS = 1000
CLEAN_SHARE = 4
#: Different words, counted by document, of the sampled documents labelled 1; CLEAN_SHARE times as many of the others.
ENTRIES = 600_000
EPOCHS = 14
BATCH = 64
TOXIC_WEIGHT = 1.7
#: Spread of the embeddings at the start, and of the softmax's weights.
START = (0.1, 1.0)
#: Step sizes of the embeddings and of the softmax.
RATES = (20.0, 0.05)
#: Strength of the group penalty, and what is added to the gradients seen so far.
PENALTY, DAMPING = 1e-5, 3e-5


class Model:
    """Each bucket's part of the logit, and the bias; `none` if there was nothing to learn from."""

    def __init__(self, table: np.ndarray | None, bias: float):
        self.table, self.bias = table, bias


def sample(docs: DataFrame, labels: DataFrame, per_class: int, entries: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(label, words, counts) of the sampled documents in a fixed order, none held out."""
    known = labels.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(~held_out(F.col("of"))).withColumn("draw", F.xxhash64(F.lit("toxicity"), "of", "label"))
    picks = [known.where(F.col("label") == k).orderBy("draw", "of").limit(per_class * (1 if k else CLEAN_SHARE)) for k in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    # At most (1 + CLEAN_SHARE) * per_class rows of three numbers.
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "label", "draw", "text")

    def count(batches):
        for batch in batches:
            got = []
            for t in batch.column(3).to_pylist():
                n: dict[str, int] = {}
                for w in words_of(t):
                    n[w] = n.get(w, 0) + 1
                got.append(n)
            words = pa.array([sorted(n) for n in got], pa.list_(pa.string()))
            counts = pa.array([[n[w] for w in sorted(n)] for n in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], words, counts], names=["doc_id", "label", "draw", "words", "counts"])

    counted = rows.mapInArrow(count, "doc_id long, label int, draw long, words array<string>, counts array<int>")
    upto = F.sum(F.size("words")).over(Window.partitionBy("label").orderBy("draw", "doc_id", F.array_join("words", " ")))
    bound = F.when(F.col("label") == 1, entries).otherwise(entries * CLEAN_SHARE)
    return counted.withColumn("upto", upto).where(F.col("upto") <= bound).orderBy("label", "upto").select("label", "words", "counts")


class Batch:
    """Some documents as sparse rows over the n-grams they hold, with what both directions of a step need."""

    def __init__(self, labels: np.ndarray, doc: np.ndarray, part: np.ndarray, word: np.ndarray, grams: np.ndarray, at: np.ndarray, total: int):
        """`doc` (ascending), `part` (of its document) and `word` of each entry; the grams of word w are grams[at[w]:at[w + 1]], of `total`."""
        n = at[word + 1] - at[word]
        places = np.repeat(at[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys, of = np.unique(np.repeat(doc, n) * total + grams[places], return_inverse=True)
        self.labels = labels
        self.weight = np.bincount(of, weights=np.repeat(part / np.maximum(n, 1), n)).astype(np.float32)
        rows, gram = np.divmod(keys, total)
        self.ends = np.searchsorted(rows, np.arange(len(labels) + 1))
        self.grams, column = np.unique(gram, return_inverse=True)
        self.column = column.astype(np.int32)
        self.by_gram = np.argsort(column, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(column[self.by_gram], np.arange(len(self.grams)))

    def means(self, e: np.ndarray) -> np.ndarray:
        """Each document's mean of the embeddings `e` of this batch's n-grams."""
        out = np.zeros((len(self.labels), e.shape[1]), np.float32)
        some = self.ends[1:] > self.ends[:-1]
        if some.any():
            out[some] = np.add.reduceat(e[self.column] * self.weight[:, None], self.ends[:-1][some], axis=0)
        return out

    def back(self, d_mean: np.ndarray) -> np.ndarray:
        """The embeddings' gradient from that of the means."""
        spread = np.repeat(d_mean, np.diff(self.ends), axis=0) * self.weight[:, None]
        return np.add.reduceat(spread[self.by_gram], self.starts, axis=0)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams, word by word, and where each word's begin; some words at a time."""
    parts, sizes = [], []
    for low in range(0, len(words), TOGETHER):
        some = words[low : low + TOGETHER]
        owner, h = gram_hashes(some, ORDERS)
        parts.append((h % np.uint64(BUCKETS)).astype(np.int32)[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(some)))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def batches_of(labels: np.ndarray, doc: np.ndarray, words: list[str], word: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> tuple[list[Batch], np.ndarray]:
    """The documents in batches, dealt at random, and the buckets of their n-grams."""
    grams, at = word_buckets(words)
    buckets = np.unique(grams)
    place_of = np.zeros(BUCKETS, np.int32)
    place_of[buckets] = np.arange(len(buckets))
    grams = place_of[grams]
    total = np.maximum(np.bincount(doc, weights=count, minlength=len(labels)), 1)
    order = rng.permutation(len(labels))
    by_doc = np.argsort(doc, kind="stable")  # entries of each document
    ends = np.searchsorted(doc[by_doc], np.arange(len(labels) + 1))
    out = []
    for low in range(0, len(labels), BATCH):
        members = order[low : low + BATCH]
        own = np.concatenate([by_doc[ends[d] : ends[d + 1]] for d in members])
        if len(own):
            of = np.repeat(np.arange(len(members)), ends[members + 1] - ends[members])
            out.append(Batch(labels[members], of, count[own] / total[doc[own]], word[own], grams, at, len(buckets)))
    return out, buckets


def train(labels: np.ndarray, doc: np.ndarray, words: list[str], word: np.ndarray, count: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Embeddings and softmax from (doc, word, count) entries; `labels` of the documents."""
    rng = np.random.default_rng(0)
    batches, buckets = batches_of(labels, doc, words, word, count, rng)
    e = rng.normal(0, START[0], (len(buckets), DIM)).astype(np.float32)
    w, b = rng.normal(0, START[1], (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = np.zeros(len(buckets), np.float32)
    for epoch in range(epochs):
        rate = RATES[0] * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            x = batches[k]
            own = e[x.grams]
            means = x.means(own)
            logits = means @ w + b
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            gap = odds / odds.sum(axis=1, keepdims=True) - np.eye(2, dtype=np.float32)[x.labels]
            gap *= np.where(x.labels == 1, TOXIC_WEIGHT, 1.0).astype(np.float32)[:, None] / len(x.labels)
            slope = x.back(gap @ w.T)
            seen[x.grams] += (slope * slope).sum(axis=1)
            step = (rate / np.sqrt(seen[x.grams] + DAMPING**2))[:, None]
            own = own - step * slope
            length = np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), 1e-12)
            e[x.grams] = own * np.maximum(0, 1 - step * PENALTY / length)
            w -= RATES[1] * (means.T @ gap)
            b -= RATES[1] * gap.sum(axis=0)
    table = np.zeros(BUCKETS, np.float32)
    table[buckets] = e @ (w[:, 1] - w[:, 0])
    return Model(table, float(b[1] - b[0]))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, entries: int = ENTRIES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the sample."""
    rows = sample(docs, labels, per_class, entries, doc_id, text, label).toArrow().combine_chunks()
    found = rows["label"].to_numpy().astype(np.int64)
    if len(set(found.tolist())) < 2:
        return Model(None, 0.0)
    lists = rows["words"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return Model(None, 0.0)
    doc = np.repeat(np.arange(len(found), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    counts = rows["counts"].combine_chunks().flatten().to_numpy()
    return train(found, doc, coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all) and `score`, how likely the label is 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute():
        m = shared.value

        def features(words: list[str]) -> np.ndarray:
            out = np.zeros((len(words), 1))
            if words:
                owner, h = gram_hashes(words, ORDERS)
                n = np.bincount(owner, minlength=len(words))
                out[:, 0] = np.bincount(owner, weights=m.table[(h % np.uint64(BUCKETS)).astype(np.int64)], minlength=len(words)) / np.maximum(n, 1)
            return out

        sums = TextSums(features)

        def work(texts: pa.Array) -> list[pa.Array]:
            if m.table is None:
                return [pa.array(np.zeros(len(texts)))]
            got, n = sums(texts.to_pylist())
            logit = got[:, 0] / np.maximum(n, 1) + m.bias
            return [pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))]

        return work

    return append_columns(df, text, keep, T.StructType([T.StructField("score", T.DoubleType())]), compute)
