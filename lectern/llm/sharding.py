"""Operator 7: sharding by longest-processing-time scheduling.

Documents with equal texts stay together. Their groups, largest first, go to the
least-loaded shard through a heap. Groups of equal size are all alike to the schedule,
so what the driver needs is the histogram of group sizes: how many groups have each
size. Different sizes that add up to a total are at most about the square root of twice
that total in number, and far fewer where texts have a common bound. For each size,
largest first, the heap says how many of its groups go to each shard, exactly as if they
had been dealt one by one; many groups of one size are dealt at once by the level to
which they fill the shards. A group then takes the shard of its rank within its size.

Ranks within a size and slots within a shard are numbered in two steps, from counts of
chunks whose number grows with the rows there are, so no task orders a whole size or a
whole shard.

Defined results: null text has no bytes and counts as empty; one group with more than a
shard's share makes its shard larger than the others; rows that repeat get places of
their own; texts of any length count with all their bytes; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.scratch import written

SHARDS = 40
OVERHEAD = 16
#: Rows of one key that a task orders, about.
CHUNK = 50_000


def filled(loads: list[int], size: int, n: int) -> list[int]:
    """How many of `n` units of one size each shard gets, each unit going to the least load so far (ties: the first shard).

    A unit is put at its shard's load before it; the n smallest such (load, shard) are taken. All below some level are
    among them, and at the level itself the first shards'.
    """
    if n < 2 * len(loads):
        heap = [(load, k) for k, load in enumerate(loads)]
        heapq.heapify(heap)
        got = [0] * len(loads)
        for _ in range(n):
            load, k = heap[0]
            got[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        return got
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * n
    while low < high:  # the highest level with at most n places below it
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
    got = below(low)
    left = n - sum(got)
    for k, load in enumerate(loads):
        if left and load <= low and (low - load) % size == 0:
            got[k] += 1
            left -= 1
    return got


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, upto, shards) for each (size, number of groups), largest size first.

    Of the groups of a size, those whose rank is below upto[0] go to shards[0], those below upto[1] to shards[1], ...
    """
    loads = [0] * shards
    out = []
    for size, n in sorted(histogram, reverse=True):
        got = filled(loads, size, n)
        loads = [load + size * g for load, g in zip(loads, got)]
        used = [k for k, g in enumerate(got) if g]
        out.append((size, list(accumulate(got[k] for k in used)), used))
    return out


def ranked(df: DataFrame, key: str, order: list[str], rank: str, spread: Column) -> DataFrame:
    """`df` with `rank`: a row's place, from 0, among those with its `key`, by chunk of `spread` (a digest) and then `order`."""
    # Narrow, and stored, so that their size decides whether the rows are shuffled to meet them.
    sizes = written(df.groupBy(key).agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "key-sizes")
    dealt = df.join(sizes, key).withColumn("chunk", F.pmod(spread, F.col("chunks"))).drop("chunks")
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "chunk").agg(F.count("*").alias("n")).select(key, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = written(starts, "starts")  # a row for each CHUNK rows of a key: small, and then known to be
    own = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(*order))
    return dealt.withColumn(rank, own).join(starts, [key, "chunk"]).withColumn(rank, F.col(rank) + F.col("start") - 1).drop("chunk", "start")


def shards_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each row of `df`: doc_id, size (bytes and OVERHEAD), text_crc32, law (`bytes`), shard, slot and grown_shard (null)."""
    spark = df.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = written(
        df.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(t, 256)).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("text_key").agg(F.sum("size").alias("group_size")), "group-sizes")
    histogram = groups.groupBy("group_size").agg(F.count("*").alias("n")).toArrow()
    plan = schedule(list(zip(histogram["group_size"].to_pylist(), histogram["n"].to_pylist())), shards)
    kinds = [("group_size", pa.int64()), ("upto", pa.list_(pa.int64())), ("shards", pa.list_(pa.int32()))]
    table = pa.table({name: pa.array([p[i] for p in plan], kind) for i, (name, kind) in enumerate(kinds)})
    plan = written(spark.createDataFrame(table), "plan")
    placed = ranked(groups, "group_size", ["text_key"], "rank", F.xxhash64("text_key")).join(plan, "group_size")
    # `upto` ascends: the number of its elements that a rank has reached says which shard is its own.
    index = F.size(F.filter("upto", lambda u: u <= F.col("rank"))) + 1
    homes = written(placed.select("text_key", F.element_at("shards", index).alias("shard")), "homes")
    dealt = written(rows.join(homes, "text_key").drop("text_key"), "dealt")
    return ranked(dealt, "shard", ["row"], "slot", F.xxhash64("row")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
