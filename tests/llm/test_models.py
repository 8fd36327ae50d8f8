import zlib

import numpy as np
import pytest

from lectern.llm import grams, langid, toxicity
from tests.llm.helpers import ROWS, docs, empty

SYLLABLES = {"aa": ["ka", "lo", "mi", "pu"], "bb": ["dre", "stu", "vog", "zin"], "cc": ["été", "ñor", "üb", "ßal"]}


def corpus(n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(2, 5))) for _ in range(30)]
        rows.append((i, " ".join(words), lang, "s", None))
    return rows


def test_grams_are_those_of_each_word():
    owner, h = grams.gram_hashes(["ab", "abc", "ab"], (2, 3))
    by = [sorted(h[owner == k].tolist()) for k in range(3)]
    assert by[0] == by[2] and len(by[0]) == 3 + 2 and len(by[1]) == 4 + 3
    assert len(set(by[0]) & set(by[1])) == 3  # _a, ab and _ab


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(0)
    own = {x: rng.integers(-(2**62), 2**62, 3000) for x in ("de", "en", "fr")}
    f = langid.build(np.repeat(list(own), 3000), np.concatenate(list(own.values())))
    assert f.langs == ["de", "en", "fr"]
    for k, x in enumerate(f.langs):
        held = f.containing(own[x].view(np.uint64))
        assert held[:, k].all()
        others = [j for j in range(3) if j != k]
        assert np.allclose(held[:, others].mean(axis=0), f.wrong[others], atol=0.02)


def test_many_languages():
    f = langid.build(np.array([f"l{k:02}" for k in range(20)]), np.arange(20) * 7919 + 1)
    assert f.table.shape[1] == 3
    assert all(f.containing(np.array([k * 7919 + 1], np.uint64))[0, k] for k in range(20))


def test_languages_of_held_out_documents(spark):
    d = docs(spark, corpus())
    out = langid.identify(d.select("doc_id", "text"), langid.learn(d), keep=["doc_id"]).collect()
    truth = {r[0]: r[2] for r in corpus()}
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 40 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_texts(spark):
    d = docs(spark, corpus(60))
    filters = langid.learn(d)
    out = {r.doc_id: r for r in langid.identify(docs(spark), filters).where("doc_id is not null").collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {4, 5, 6, 9}
    assert out[4].score == 0
    assert langid.identify(empty(spark), filters).count() == 0


def test_no_training_rows(spark):
    out = langid.identify(docs(spark), langid.learn(empty(spark)))
    assert {r.lang_pred for r in out.collect()} == {"und"}


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = [r for r in corpus(120) if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    extra = [(i, "zzz yyy xxx", "zz", "s", None) for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    assert langid.learn(docs(spark, rows + extra)).langs == ["aa", "bb", "cc"]


def toxic_corpus(n=400):
    rng = np.random.default_rng(5)
    bad = ["idiot", "moron", "idiotic", "morons"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["tha", "re", "ing", "on", "est", "lo"], rng.integers(1, 4))) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[int(rng.integers(40))] = bad[i // 4 % 4]
            words[int(rng.integers(40))] = bad[i // 4 % 3]
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rows, labels = toxic_corpus()
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model, keep=["doc_id"]).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held])
    assert right > 0.9
    near = docs(spark, [(0, rows[1][1] + " idiotz idiotz", "en", "s", None), (1, rows[1][1], "en", "s", None)])
    a, b = (r.score for r in toxicity.score(near, model).orderBy("doc_id").collect())
    assert a > b


def test_toxicity_of_odd_texts(spark):
    rows, labels = toxic_corpus(80)
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.score(docs(spark), model).collect()
    assert all(0 <= r.score <= 1 for r in out)
    bias = {r.score for r in out if not grams.words_of(r.text)}
    assert len(bias) == 1
    assert toxicity.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, None)]])
def test_nothing_to_learn_from(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark), lab)
    assert {r.score for r in toxicity.score(docs(spark), model).collect()} == {0.0}


def test_training_is_repeatable():
    args = (np.array([0, 1, 1]), np.array([0, 1, 2, 2]), ["good", "bad"], np.array([0, 1, 1, 0]), np.array([3, 1, 1, 1]))
    a, b = toxicity.train(*args), toxicity.train(*args)
    assert np.array_equal(a.table, b.table) and a.bias == b.bias


def test_scores_are_means_of_means(spark):
    """Scores of whole texts against a slow scorer that follows the definition n-gram by n-gram."""
    rows, labels = toxic_corpus(120)
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def slow(text):
        parts = []
        for word in grams.words_of(text):
            _, h = grams.gram_hashes([word], toxicity.ORDERS)
            parts.append(np.mean([model.table[int(x) % toxicity.BUCKETS] for x in h]) if len(h) else 0.0)
        return 1 / (1 + np.exp(-((np.mean(parts) if parts else 0.0) + model.bias)))

    for r in toxicity.score(docs(spark, rows[:20] + ROWS), model).collect():
        assert abs(r.score - slow(r.text)) < 1e-5


def test_embeddings_start_at_random_and_training_does_the_work():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(["tha", "re", "ing", "lo"], 3)) for _ in range(200)] + ["idiot"]
    words = sorted(set(words))
    labels = np.arange(200) % 4 == 0
    doc = np.repeat(np.arange(200), 20)
    word = rng.integers(0, len(words) - 1, len(doc))
    word[::80] = words.index("idiot")  # in each document labelled 1
    args = (labels.astype(np.int64), doc, words, word, np.ones(len(doc), np.int64))

    def right(model):
        parts = np.array([model.table[(grams.gram_hashes([w], toxicity.ORDERS)[1] % np.uint64(toxicity.BUCKETS)).astype(int)].mean() for w in words])
        logit = np.bincount(doc, weights=parts[word], minlength=200) / 20 + model.bias
        return ((logit > 0) == labels).mean()

    assert right(toxicity.train(*args, epochs=0)) < 0.9 < right(toxicity.train(*args))


def test_sampled_words_are_bounded(spark):
    rows, labels = toxic_corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs(spark, rows), lab, 1000, 300, "doc_id", "text", "toxic").collect()
    for k, share in ((1, 1), (0, toxicity.CLEAN_SHARE)):
        sizes = [len(r.words) for r in got if r.label == k]
        assert 0 < sum(sizes) <= 300 * share


def test_predictions_against_brute_force(spark):
    """Language counts of whole texts against sets of n-grams looked up one by one."""
    filters = langid.learn(docs(spark, corpus()))
    for r in langid.identify(docs(spark, corpus(30) + ROWS), filters).collect():
        hits, n = np.zeros(len(filters.langs)), 0
        for word in grams.words_of(r.text):
            for h in grams.gram_hashes([word], langid.ORDERS)[1]:
                rows = [int(p[0]) for p in langid.positions(np.array([h]))]
                bits = [[int(filters.table[p, k // 8]) >> k % 8 & 1 for p in rows] for k in range(len(filters.langs))]
                hits += [all(b) for b in bits]
                n += 1
        corrected = (hits - n * filters.wrong) / (1 - filters.wrong)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == filters.langs[int(corrected.argmax())]
            assert abs(r.score - min(1, max(0, corrected.max() / n))) < 1e-9


def test_clashing_names_and_odd_tables(spark):
    clash = docs(spark).selectExpr("*", "'mine' AS lang_pred", "-7.0D AS score", "'x' AS source_text")
    found = langid.identify(clash, langid.learn(docs(spark, corpus(60))))
    assert found.columns[-2:] == ["lang_pred_", "score_"]
    assert {(r.lang_pred, r.score) for r in found.collect()} == {("mine", -7.0)}
    rows, labels = toxic_corpus(80)
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = toxicity.score(clash, model)
    assert scored.columns[-1] == "score_" and scored.count() == len(ROWS)
    nothing = docs(spark, [(None, None, None, None, None)] * 3)
    assert {r.lang_pred for r in langid.identify(nothing, langid.learn(nothing)).collect()} == {"und"}
