import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm.queries_text import token_digests, word_tokenizer
from tests.llm.helpers import docs, empty


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60) | st.sampled_from(["<|endoftext|>a<|startoftext|>", "it's 12's", "ΑΣ Σ ΣΑΣ", "é́ \x1c\x1f a\x1cb", "a" * 3000, "don't'll"]))
def test_like_the_library(text):
    from tokenizers import Tokenizer

    lib = test_like_the_library.__dict__.setdefault("lib", Tokenizer.from_file(word_tokenizer()))
    got = np.frombuffer(bpe.encoder(word_tokenizer())(text), "<u4").tolist()
    assert got == lib.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, library):
    d = docs(spark)
    got = sorted(map(tuple, token_digests(d).collect()), key=str)
    want = []
    for r in d.collect():
        ids, text = expected(library, r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decoding_while_encoding(spark):
    d = docs(spark)
    both = bpe.bpe_encode(d, word_tokenizer(), keep=["doc_id"], decode=True)
    apart = bpe.bpe_decode(bpe.bpe_encode(d, word_tokenizer(), keep=["doc_id"]), word_tokenizer())
    assert both.columns == apart.columns and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))


def test_full_caches_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 700} {'x' * (i % 80)}" for i in range(5000))
    want = bpe.Encoder(bpe.load(word_tokenizer()))(text)
    monkeypatch.setattr(bpe, "CACHED", 3000)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    small = bpe.Encoder(bpe.load(word_tokenizer()))
    assert small(text) == want and small(text) == want and len(small.packed) < 100


def test_clashing_names_and_empty_table(spark):
    from pyspark.sql import functions as F

    d = docs(spark).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("x"))
    out = bpe.bpe_encode(d, word_tokenizer())
    assert out.columns == [*d.columns, *(f"{c}_" if c in d.columns else c for c in ("ids", "n_tokens"))]
    assert {(r.ids, r.n_tokens) for r in out.collect()} == {("clash", "x")}
    assert out.where("doc_id = 11").first().n_tokens_ == 1
    assert bpe.bpe_decode(bpe.bpe_encode(empty(spark), word_tokenizer()), word_tokenizer()).count() == 0


def test_unknown_ids_decode_to_nothing(spark):
    packed = np.array([3306, 4_000_000_000], "<u4").tobytes()
    d = spark.createDataFrame([(bytearray(packed),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.bpe_decode(d, word_tokenizer()).collect()] == ["hello</w>", ""]
