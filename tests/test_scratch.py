"""Tables in the shared folder: what is left on disk, and what a join with a bucketed one shuffles."""

import os

from pyspark.sql import functions as F

from lectern import scratch
from lectern.llm import partenum
from tests.llm.helpers import docs
from tests.llm.test_partenum import brute, mixed_rows


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}


def tables(spark):
    top = scratch.shared_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith("lectern-")}


def test_a_write_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(scratch.CLEANED)
    out = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count(), "counts")
    assert sorted(map(tuple, out.collect()))[0] == (0, 143)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(scratch.CLEANED) == setting


def test_a_join_with_buckets_shuffles_one_side(spark, capsys):
    out = scratch.bucketed(spark.range(1000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 9).alias("text")), "texts", "k")
    joined = out.hint("merge").join(spark.range(0, 2000, 3).select(F.col("id").alias("k")), "k")
    joined.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert joined.count() == 334
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lectern_")]
    scratch.forget(out)


def test_texts_and_sets_go_when_nothing_reads_them(spark):
    before, rows = tables(spark), mixed_rows(3, 4)
    found = partenum.similar_sets(docs(spark, rows))
    assert not {x.split("-")[1] for x in tables(spark) - before} & {"nodes", "sets", "led", "members", "picked"}
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)
