"""The entry module, and a selection of queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from lectern.plans import ORACLES, QUERIES
from lectern.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "~" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", ["search_top_k", "answer_key", "set_dashboard", "question_check", "set_check", "status_rollup", "gap_islands", "words_in_region", "latest_operation", "resume_plan", "stream_progress"])
def test_like_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = c.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    key = lambda r: str([plain(x) for x in r])
    assert sorted(map(key, got.select(*(f"`{x}`" for x in cols)).collect())) == sorted(map(key, want.fetchall()))


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
