"""Drafts whose frames go over line ends."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import mining
from lectern.plans import ORACLES, QUERIES

ASK, PASSAGE = "에 대한 설명으로 옳은 것은?", "을 나타낸 것이다."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Conversations whose first word ends a line, in lines of 3 * 4 = 12 letters each, or doesn't."""
    path = str(tmp_path_factory.mktemp("talks"))
    texts = {1: "Asraie.\nM ab", 2: "Asraie.Mx ab", 3: "a\n\nbcdefg xy", 4: "Lyan.\nEn abc", 5: "no such word"}
    rows = [(conv, turn, ("user", "assistant")[turn % 2], t) for conv, t in texts.items() for turn in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def like_sql(spark, folder, name):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    want = c.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    got = sorted(map(str, (tuple(r) for r in QUERIES[name](spark, folder).select(*cols).collect())))
    assert got == sorted(map(str, want.fetchall()))
    return got


def test_asks_over_line_ends(spark, folder):
    d = spark.createDataFrame([("Thertion.\nThedatth" + ASK,), ("그림" + ASK,)], "a string")
    frames = lambda **k: [r[0] for r in d.select(mining.ask_frame(F.col("a"), F.lit("합답형"), **k)).collect()]
    assert frames() == [None, "ASK_DESCRIPTION_CORRECT"]
    assert frames(wrapped=True) == ["ASK_DESCRIPTION_CORRECT"] * 2
    assert any("ASK_DESCRIPTION_CORRECT" in r for r in like_sql(spark, folder, "ask_frames"))


def test_passages_over_line_ends(spark, folder):
    d = spark.createDataFrame([("\n 그림은 Asraie.\n\nMentetaga" + PASSAGE,), ("그림은 판" + PASSAGE + "\n끝",), ("첫째 줄\n그림은 판" + PASSAGE,), (None,)], "p string")
    frames = lambda **k: [r[0] for r in d.select(mining.intro_frame(F.col("p"), **k)).collect()]
    assert frames() == [None, "INTRO_FIGURE_SINGLE", None, None]
    assert frames(wrapped=True) == ["INTRO_FIGURE_SINGLE", "INTRO_FIGURE_SINGLE", None, None]
    assert any("INTRO_FIGURE_SINGLE" in r for r in like_sql(spark, folder, "intro_frames"))


@pytest.mark.parametrize("name", ["draft_check", "draft_issue_counts"])
def test_drafts_over_line_ends(spark, folder, name):
    assert like_sql(spark, folder, name)
