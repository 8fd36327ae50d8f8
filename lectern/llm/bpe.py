"""Operator 1: BPE encoding and decoding.

Encoding follows a tokenizers JSON file of the kind "BPE with word ends": NFC, lower
case, a split pattern, byte-level symbols, then merges by rank. Each word's symbols
stand in a doubly linked list; a priority queue holds candidate merges by (rank,
position), and entries whose neighbours have changed since are skipped as stale.
Decoding concatenates vocabulary strings with the separator such a file implies when
it names no decoder (one blank).

Defined results: a null text is an empty one and gives no ids; white space alone gives
none either; special tokens' strings inside a text give their ids, as in the library;
repeated rows repeat their results; texts of any length are encoded whole; an empty table
gives an empty result; kept columns stay as they are, and results whose names they have
get underscores behind theirs.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.arrow_io import append_columns

#: Bytes of chunks and their ids that a Python worker keeps at hand, at most twice; an entry costs ENTRY besides. Results don't depend on it.
CACHED, ENTRY = 24 << 20, 200
#: Chunks of a text that are looked up at a time.
TOGETHER = 1 << 14
#: White space for str.split() that the tokenizer's pattern counts as symbols.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(moved)) for b in range(256)]


def names_of(spec: dict) -> list[str]:
    """The string of each id; empty where there is none."""
    names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """All that decoding needs of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return names_of(json.load(f))


class WordBpe:
    """Vocabulary, merge ranks and split pattern of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = names_of(spec)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.ranks: list[dict[int, int]] = [{} for _ in self.names]  # by left symbol, then right symbol
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a]][self.vocab[b]] = rank
        self.made = [self.vocab[a + b] for a, b in pairs]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s, -1) for s in symbols]
        self.final = [self.vocab.get(s + self.suffix, -1) for s in symbols]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge a word's symbols by rank, the leftmost of equal ranks first.

        An entry of the queue is rank * 2**32 + position, so that whole numbers are compared.
        """
        ranks, made = self.ranks, self.made
        queue, a = [], ids[0]
        for i, b in enumerate(ids[1:]):
            r = ranks[a].get(b)
            if r is not None:
                queue.append(r << 32 | i)
            a = b
        if not queue:
            return ids
        heapq.heapify(queue)
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            top = heapq.heappop(queue)
            i, merged = top & 0xFFFFFFFF, made[top >> 32]
            j, a = after[i], ids[i]
            if a < 0 or j < 0:
                continue  # stale: one of the two is gone
            now = ranks[a].get(ids[j])
            if now is None or made[now] != merged:
                continue  # stale: the pair has become another
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks[merged].get(ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks[ids[h]].get(merged)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self.merge([x for x in ids if x >= 0] if min(ids) < 0 else ids)

    def chunk(self, text: str) -> bytes:
        """Packed ids of a stretch without white space."""
        if text.isascii() and text.isalpha():
            ids = self.word(text)
        else:
            ids = [i for piece in self.pieces.findall(text) for i in self.word(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)


class Packed(dict):
    """Packed ids by chunk, computed when first asked for; `older` is asked before that."""

    def __init__(self, bpe: WordBpe, older: dict[str, bytes]):
        super().__init__()
        self.bpe, self.older, self.room = bpe, older, CACHED

    def __missing__(self, chunk: str) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            got = self.bpe.chunk(chunk)
        if len(chunk) < 64:
            self[chunk] = got
            self.room -= ENTRY + len(chunk) + len(got)
        return got


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One table in each Python worker."""
    return WordBpe(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))


class Encoder:
    def __init__(self, bpe: WordBpe):
        self.bpe, self.packed = bpe, Packed(bpe, {})

    def plain(self, text: str) -> bytes:
        # Sigma loses its context-dependent lower case: the tokenizer lowers one character at a time.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        chunks = self.bpe.pieces.findall(text) if SEPARATORS.search(text) else text.split()
        parts = []
        for at in range(0, len(chunks), TOGETHER):
            if self.packed.room <= 0:  # what is asked for again moves from the full table into the new one
                self.packed.older = {}
                self.packed = Packed(self.bpe, self.packed)
            parts += map(self.packed.__getitem__, chunks[at : at + TOGETHER])
        return b"".join(parts)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        at, parts = 0, []
        for m in self.bpe.special.finditer(text):
            parts += [self.plain(text[at:m.start()]), np.array([self.bpe.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*parts, self.plain(text[at:])])


def joined_strings(names: list[str]) -> Callable[[bytes | None], str]:
    """What decodes packed ids: their strings in `names`, one blank between them."""
    known = np.array([bool(x) for x in names])

    def one(packed: bytes | None) -> str:
        found = np.frombuffer(packed or b"", "<u4")
        if len(found) and (found.max() >= len(names) or not known[found].all()):
            found = found[found < len(names)]
            found = found[known[found]]
        return " ".join(map(names.__getitem__, found.tolist()))

    return one


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """`keep` columns of `df` (None: all), `ids` (little-endian unsigned 32-bit integers, packed) and `n_tokens`.

    With `decode` also `decoded`, what `bpe_decode` makes of the ids, by the same Python worker.
    No shuffle: each task encodes its own rows and keeps the ids of frequent words at hand.
    `tokenizer` is the path of the file on every machine, as where the package that holds it is installed.
    """
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decode:
        added.append(T.StructField("decoded", T.StringType()))

    def compute():
        encode = encoder(tokenizer)
        one = joined_strings(load(tokenizer).names) if decode else None

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = [encode(t) for t in texts.to_pylist()]
            arrays = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            return [*arrays, pa.array(map(one, ids), pa.string())] if decode else arrays

        return work

    return append_columns(df, text, keep, T.StructType(added), compute)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all) and `decoded`, the vocabulary strings of packed `ids`, one blank between them.

    Null or no ids give an empty text. An id outside the vocabulary gives nothing, as in the library.
    """
    added = T.StructType([T.StructField("decoded", T.StringType())])

    def compute():
        one = joined_strings(vocabulary(tokenizer))
        return lambda packed: [pa.array([one(x) for x in packed.to_pylist()], pa.string())]

    return append_columns(df, ids, keep, added, compute)
