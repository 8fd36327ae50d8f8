import duckdb
import pytest

from lectern.llm import mixing
from lectern.llm.queries_text import table
from tests.llm.helpers import ROWS, docs, empty, stored


def test_targets_are_shared_by_weight_and_capped(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a is capped at 20; c would get twice b's share and is below its cap
    assert got["a"] == 20.0 and sum(got.values()) == pytest.approx(1.5 * 2510)
    assert got["b"] / 1 == pytest.approx(got["c"] / 2) and got[None] <= 1000


@pytest.mark.parametrize("copies", [1, 40])
def test_taken_words(spark, tmp_path, copies):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"s{i % 4}", None) for i in range(60, 60 + 60 * copies)] + ROWS
    d = stored(spark, tmp_path, docs(spark, rows))
    found = mixing.mix(d).collect()
    assert len(found) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    again = mixing.mix(d).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    longest = max(r.size for r in found if r.size < 1000)
    by = {}
    for r in found:
        if r.doc_id is not None and r.doc_id >= 60:
            by.setdefault((r.doc_id % 4, r.target), []).append(r)
    for (_, target), own in by.items():
        if max(r.size for r in own) < 1000:
            assert abs(sum(r.taken for r in own) - target) <= longest


def test_like_sql(spark, tmp_path):
    rows = [(i, "w " * (1 + i * 13 % 90), "en", f"s{i % 5}" if i % 5 else None, None) for i in range(500)]
    d = stored(spark, tmp_path, docs(spark, rows))
    documents = d.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(mixing.ORACLE_MIX).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(d).collect())
    assert [w[:3] + w[4:] for w in want] == [g[:3] + g[4:] for g in got]
    assert [w[3] for w in want] == pytest.approx([g[3] for g in got])


def test_copies_are_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    d = stored(spark, tmp_path, docs(spark).withColumn("target", F.lit("clash")))
    out = mixing.mix_copies(d)
    assert out.columns == d.columns
    taken = sum(r.taken for r in mixing.mix(d).collect())
    assert out.select(F.sum(mixing.words(F.col("text")))).first()[0] == taken


def test_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0


def test_reads_the_table(spark, tmp_path):
    stored(spark, tmp_path, docs(spark))
    assert mixing.mix(table(spark, str(tmp_path), "documents")).count() == len(ROWS)
