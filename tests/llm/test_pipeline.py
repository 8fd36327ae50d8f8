import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import langid, mixing
from tests.llm.helpers import ROWS, docs, empty, stored
from tests.llm.test_models import corpus
from tests.llm.test_near_copies import kept_ids


def test_stages_keep_the_columns(spark, tmp_path):
    d = stored(spark, tmp_path, docs(spark, corpus(60) + ROWS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name


def test_against_brute_force(spark, tmp_path):
    rows = corpus(90)
    rows += [(500 + i, rows[i][1].replace(" ", "  "), *rows[i][2:]) for i in range(10)]  # copies
    rows += [(600, None, "aa", "s", None), (601, "123 !", "aa", "s", None)]
    d = stored(spark, tmp_path, docs(spark, rows))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if langid.has_letter(r[1])]
    first = {}
    for r in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1]), r)
    left = sorted(first.values())
    stay = set(kept_ids(left))
    left = [r for r in left if r[0] in stay]
    kept = stored(spark, tmp_path / "kept", docs(spark, left))
    copies = [r.doc_id for r in mixing.mix_copies(kept).collect()]
    assert sorted(r.doc_id for r in got) == sorted(copies)
    assert d.count() == len(rows)


def test_other_columns_stay_as_they_are(spark, tmp_path):
    extra = {"score": -7.0, "lang_pred": "mine", "__row": 1, "__target": 2, "__id": 3, "__text": "t", "row": 4, "fp": 5, "source_size": 6, "Row_": 7}
    d = docs(spark, corpus(30) + ROWS)
    for name, value in extra.items():
        d = d.withColumn(name, F.lit(value))
    d = stored(spark, tmp_path, d)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        assert {tuple(r) for r in out.select(*(F.col(f"`{c}`") for c in extra)).collect()} == {tuple(extra.values())}, name


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_empty_and_null_tables(spark, tmp_path, rows):
    stored(spark, tmp_path, docs(spark, rows) if rows else empty(spark))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
