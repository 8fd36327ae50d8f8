import heapq
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb

from lectern.llm import licences, sharding
from tests.llm.helpers import ROWS, docs, empty, stored


def test_canonical_forms(spark):
    from pyspark.sql import functions as F

    same = [
        "MIT Licence\n\nCopyright (c) 2020 Someone\nPermission to  SUB-LICENSE is granted!",
        "  mit license\n(c) Another, 1999\npermission to sublicense is granted",
        "MIT LICENSE\r\n© 2021 X\r\nPermission to sublicense, is -- granted.",
    ]
    got = {r[0] for r in spark.createDataFrame([(x,) for x in same], "t string").select(licences.canonical(F.col("t"))).collect()}
    assert got == {"mit license permission to sublicense is granted"}


def reflowed(text, width):
    """Paragraphs wrapped at a width; None: one line for each; 0: one line in all."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n\s*", text)]
    if width == 0:
        return " ".join(paragraphs)
    return "\n\n".join("\n".join(textwrap.wrap(p, width)) if width else p for p in paragraphs)


def test_known_texts_in_any_wrapping(spark, tmp_path):
    rows, names = [], []
    known = licences.known_texts()
    assert len({name for name, _ in known}) >= 20
    for name, body in known:
        body = re.sub("<copyright holders?>", "Ann Example and the Other Contributors Ltd.", body.replace("<year>", "2003, 2005-2019"))
        forms = [reflowed(body, w) for w in (None, 0, *range(48, 128, 4))]
        for text in [*forms, body.upper(), body.replace("\n", "\r\n"), " * " + body.replace("\n", "\n * ")]:
            rows.append((len(rows), text, None, None, None))
            names.append(name)
    d = stored(spark, tmp_path, docs(spark, rows))
    got = {r.doc_id: r.licence for r in licences.scan(d, licences.known_licences(spark)).collect()}
    assert [(i, names[i]) for i in got if got[i] != names[i]] == []


def test_statements_only_are_dropped(spark):
    from pyspark.sql import functions as F

    cases = {
        "Copyright (c) 2020 Someone": "",
        "(c) 2001-2005 by A. Person and others": "",
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM": "copyright holders be liable for any claim",
        "the above\ncopyright notice": "the above copyright notice",
        "copyright law applies\n(c) You must retain it": "copyright law applies c you must retain it",
        "Copyright 1999 " + "word " * 60 + "end": "copyright 1999 " + "word " * 60 + "end",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", licences.canonical(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == cases


def test_scan(spark, tmp_path):
    name, body = next(x for x in licences.known_texts() if x[0] == "MIT")
    rows = [*ROWS, (50, "Copyright (c) 2020 Me\n" + body.upper(), None, None, None), (51, "some text\nReleased under the MIT licence.\nmore", None, None, None),
            (52, "Released under the MIT License.", None, None, None), (53, "Copyright 2020", None, None, None), (54, body + " x", None, None, None)]
    d = stored(spark, tmp_path, docs(spark, rows).selectExpr("*", "1 AS digest", "2 AS row", "3 AS licence"))
    found = licences.scan(d, licences.known_licences(spark)).collect()
    got = {r.doc_id: r for r in found}
    assert got[50].licence == name and got[51].licence is None and got[51].line_licences == "MIT"
    assert got[52].licence == "MIT" and got[53].canonical_sha256 is None and got[54].licence is None
    assert got[4].licence is None and got[4].line_licences == ""
    assert len(found) == len(rows)
    assert licences.scan(empty(spark), licences.known_licences(spark)).count() == 0
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")  # not by way of pandas, where ids with nulls become floats
    assert sorted(map(str, c.sql(licences.oracle_scan()).fetchall())) == sorted(str(tuple(r)) for r in found)


def one_by_one(sizes, shards):
    """How many units of each size each shard gets, by the heap alone."""
    heap, got = [(0, k) for k in range(shards)], defaultdict(Counter)
    for size in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        got[size][k] += 1
        heapq.heappush(heap, (load + size, k))
    return got


def test_schedule_is_that_of_one_unit_after_another():
    rng = random.Random(1)
    for _ in range(60):
        shards = rng.randint(1, 9)
        sizes = Counter({rng.randint(1, 60): rng.randint(1, 200) for _ in range(rng.randint(1, 12))})
        want = one_by_one(sizes.elements(), shards)
        for size, upto, used in sharding.schedule(list(sizes.items()), shards):
            got = {k: b - a for k, a, b in zip(used, [0, *upto], upto)}
            assert got == dict(want[size])


def test_loads_are_those_of_the_heap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 40)
    rows = [(i, f"text {i % 700} " * (1 + i % 9), "en", "s", None) for i in range(2000)] + [(i, "hot", "en", "s", None) for i in range(900)]
    groups = Counter()
    for r in rows:
        groups[r[1]] += len(r[1].encode()) + 16
    want = Counter()
    for size, shards in one_by_one(groups.values(), 40).items():
        for k, n in shards.items():
            want[k] += size * n
    got = Counter()
    for r in sharding.shards_of(stored(spark, tmp_path, docs(spark, rows).selectExpr("*", "1 AS size", "2 AS shard", "3 AS row"))).collect():
        got[r.shard] += r.size
    assert got == want


def test_shards(spark, tmp_path):
    rows = [(i, f"text {i % 700} " * (1 + i % 9), "en", "s", None) for i in range(3000)] + ROWS
    got = sharding.shards_of(stored(spark, tmp_path, docs(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = defaultdict(Counter)
    for r in rows:
        texts[len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())][r[0]] += 1
    assert Counter((r.size, r.text_crc32) for r in got) == Counter({k: sum(c.values()) for k, c in texts.items()})
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sizes_are_near_equal(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 40), "en", "s", None) for i in range(20_000)]
    loads = Counter()
    for r in sharding.shards_of(stored(spark, tmp_path, docs(spark, rows))).collect():
        loads[r.shard] += r.size
    assert len(loads) == 40 and max(loads.values()) <= 1.02 * min(loads.values())


def test_no_documents(spark):
    assert sharding.shards_of(empty(spark)).count() == 0
