import hashlib
import re
import uuid
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern import scratch
from lectern.llm import radix_dedup, simhash
from lectern.operators.components import stars
from tests.llm.helpers import LONG, ROWS, docs, empty, stored


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def exact(rows):
    """(doc_id, keep_id, size, sha) of each row, by brute force."""
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    return sorted(((r[0], min((i for i in groups[norm(r[1])] if i is not None), default=None), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows), key=str)


def test_exact_groups(spark, tmp_path):
    edge = "y" * 48
    rows = [*ROWS, (20, edge, *ROWS[0][2:]), (21, edge + "z", *ROWS[0][2:]), (22, edge, *ROWS[0][2:]), (23, LONG * 2 + "a", *ROWS[0][2:]), (24, LONG * 2 + "b", *ROWS[0][2:]), (25, LONG * 2 + "b", *ROWS[0][2:])]
    found = radix_dedup.exact_groups(stored(spark, tmp_path, docs(spark, rows))).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == exact(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({norm(r[1]) for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("clashing", [False, True])
def test_labels_by_prints_and_by_value(spark, tmp_path, monkeypatch, clashing):
    """Texts that part in any round; prints that clash change nothing, and where none does, labels don't shuffle digits."""
    if clashing:
        monkeypatch.setattr(radix_dedup, "print_of", lambda digit: F.lit(7).cast("long"))
    texts = ["a" * n + c for n in (0, 47, 48, 511, 512, 4095, 4096, 33000) for c in ("", "x", "y", "xy")] * 2
    stored_docs = stored(spark, tmp_path, docs(spark, [(i, t, "en", "s", None) for i, t in enumerate(texts)]))
    seen = []
    monkeypatch.setattr(radix_dedup, "written", lambda df, name: seen.append((name, df)) or scratch.written(df, name))
    found = radix_dedup.exact_groups(stored_docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == [(i, texts.index(t), texts.count(t)) for i, t in enumerate(texts)]
    plan = next(df for name, df in seen[3:] if name == "labelled")._jdf.queryExecution().optimizedPlan().toString()
    assert ("print" in plan.split("Join")[1]) != clashing


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_a_bucket_of_live_digits_is_one_file(spark, tmp_path, monkeypatch, broadcast):
    """Else as many files as tasks times buckets are written, and each later round opens all of them."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    files = []

    def seen(df, name, key):
        out = scratch.bucketed(df, name, key)
        files.extend(Path(out._lectern_path.removeprefix("file:")).glob("part-*"))
        return out

    monkeypatch.setattr(radix_dedup, "bucketed", seen)
    texts = ["a" * 48 + str(i % 50) for i in range(200)]
    stored_docs = stored(spark, tmp_path, docs(spark, [(i, t, "en", "s", None) for i, t in enumerate(texts)]).repartition(4))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = radix_dedup.exact_groups(stored_docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == [(i, i % 50, 4) for i in range(200)]
    assert 1 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_that_change_are_an_error(spark, tmp_path):
    other = F.udf(lambda: "a" * 48 + uuid.uuid4().hex).asNondeterministic()
    with pytest.raises(ValueError, match="stored table"):
        radix_dedup.exact_groups(stored(spark, tmp_path, docs(spark)).withColumn("text", other()))


def test_exact_groups_of_nothing(spark):
    assert radix_dedup.exact_groups(empty(spark)).count() == 0


def test_one_of_equal_rows_stays(spark, tmp_path):
    left = radix_dedup.without_copies(stored(spark, tmp_path, docs(spark)))
    assert left.columns == docs(spark).columns
    assert [r.doc_id for r in left.where("doc_id = 8").collect()] == [8]


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [None, "", "one", "one two", "Eins ZWEI drei", "ÄÖ a b c d", *[r[1] for r in ROWS if r[1] and len(r[1]) < 100]]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def reachable(fps):
    """The smallest index that each fingerprint reaches, by brute force."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 2 and label[i] > label[j]:
                    label[i], changed = label[j], True
    return label


def test_links_connect_all_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:10]:
        v = int(x)
        for _ in range(6):  # chains of one or two bits each
            v ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.append(v)
    fps = sorted(set([*fps, 0, 1, 2**64 - 1, 2**64 - 2]))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in stars(simhash.links(table)).collect()}
    got = [root.get(x, x) for x in signed]
    want = reachable(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_blocks_of_full_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    fps = [(1 << i) | (1 << j) for i in range(8) for j in range(i)]  # one tile, all within four bits
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = {r.node: r.root for r in stars(simhash.links(table)).collect()}
    assert {root.get(x, x) for x in fps} == {3}


def test_components_of_odd_rows(spark, tmp_path):
    found = simhash.near_components(stored(spark, tmp_path, docs(spark))).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[4] == by_id[5] == by_id[6] == 4
    assert sum(r.kept for r in found) == len({(r.component_id, r.fp if r.component_id is None else 0) for r in found})
    assert simhash.near_components(empty(spark)).count() == 0


def test_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in stars(links).collect()} == {0}
