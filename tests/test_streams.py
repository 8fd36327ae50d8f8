"""Streamed state lies in the shared folder and equals its SQL."""

import random

import duckdb
import pytest

from lectern.operators import index, lineage
from lectern.plans import ORACLES, QUERIES
from lectern.plans.views import TABLES
from lectern.streaming import jobs
from tests.test_entry import FOLDER


@pytest.mark.parametrize("name", ["stream_progress", "stream_current_state", "stream_live_counts"])
def test_streamed_table(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER), c.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.inputFiles() and all("/lectern-" in f for f in got.inputFiles())


EVENT = "op_id long, seq long, ts long, status string, progress long"


def events(seed, n, ops):
    rng = random.Random(seed)
    return [(rng.randrange(ops), seed * 1000 + i, rng.randrange(50), rng.choice(["queued", "running", "failed", "succeeded"]), rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("most", [2, 10])
def test_batches_write_their_own_keys_and_restarts_change_nothing(spark, tmp_path, most):
    """Files come in two goes with a restart in between; the table is what one go over all of them gives."""
    arrivals, root, state = (f"{tmp_path}/{x}" for x in ("arrivals", "table", "state"))
    keyed, seen, keys = jobs.current_state("op_id", "ts", "seq"), [], []
    for k in range(7):
        rows = events(k, 40 if k == 0 else 6, 30)
        seen += rows
        keys.append(len({r[0] for r in rows}))
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(arrivals)
        if k in (2, 6):
            jobs.keyed_updates(jobs.event_stream(spark, arrivals, EVENT), keyed, root, state, most).start().awaitTermination()
            want = sorted(map(tuple, lineage.latest_operation(spark.createDataFrame(seen, EVENT), "op_id", "ts", "seq").collect()))
            assert sorted(map(tuple, jobs.keyed_table(spark, keyed, root).collect())) == want
    last = index.read_manifest(spark, root, index.manifests(spark, root)[-1])
    assert last.rows == keys if most == 10 else len(last.segments) <= 2
    # What no manifest of the last two names is gone.
    named = {s for n in index.manifests(spark, root) for s in index.read_manifest(spark, root, n).segments}
    assert {p.name for p in (tmp_path / "table").iterdir()} == {*named, "manifest"}


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(f"{tmp_path}/none")
    got = jobs.updated_to_end(jobs.event_stream(spark, f"{tmp_path}/none", EVENT), jobs.progress("op_id"), "none")
    assert got.columns == ["op_id", "shown"] and got.count() == 0
