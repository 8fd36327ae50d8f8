"""The nearest signature by mean absolute difference, with pivots and the triangle inequality.

Some observed signatures of each group are its pivots. |d(a, p) - d(o, p)| never exceeds d(a, o), and the nearest pivot
bounds what an asset can win with; so an observed signature whose distance to any pivot is out of reach is left out.
Observed signatures and assets are cut into blocks along their distance to the first pivot, and a block is sent only to
blocks of assets that its distances to all pivots leave in reach: a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.arrow import runs_of
from lectern.scratch import written

PIVOTS = 4
#: Signatures in a block, about, and assets that are compared with a block at a time.
BLOCK, STRIP = 2048, 64
#: Scores are rounded to six digits, so what lies that near may still tie; and room for the sums' last digits.
SLACK = 2e-6


def difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def blocked(rows: DataFrame, reach: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (group, id, sig, d) with the number of a block along the first distance, and each block's least and largest distances, widened by `reach`."""
    along = rows.select("group", F.col("d")[0].alias("first"))
    spread = along.groupBy("group").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.ceil(F.count("*") / BLOCK).alias("slices"))
    at = F.floor(F.least(F.col("slices") - 1, (F.col("d")[0] - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * F.col("slices")))
    sliced = rows.join(spread, "group").withColumn("slice", at.cast("long")).drop("low", "high", "slices")
    crowd = sliced.groupBy("group", "slice").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = sliced.join(crowd, ["group", "slice"])
    block = F.col("slice") * F.lit(2**31) + F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = written(dealt.withColumn("block", block).withColumn("reach", reach).drop("slice", "parts"), "signature-blocks")
    sides = [x for i in range(PIVOTS) for x in (F.min(F.col("d")[i] - F.col("reach")).alias(f"low{i}"), F.max(F.col("d")[i] + F.col("reach")).alias(f"high{i}"))]
    return dealt, written(dealt.groupBy("group", "block").agg(*sides), "signature-bounds")


def nearest_signatures(assets: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """(asset_id, observed_id, score) for each asset (asset_id, sig) that has observed signatures (observed_id, sig) alike in `by` and as long.

    Score is one less the mean absolute difference, rounded to six digits; of equal scores the least observed_id wins.
    Signatures that are null, empty or have a null are left out, as are rows with a null in `by`.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((assets, "asset_id"), (observed, "observed_id"))}
    whole = F.col("sig").isNotNull() & (F.size("sig") > 0) & ~F.exists("sig", lambda x: x.isNull())
    sides = [df.where(whole).select(F.col(c).alias("id"), F.col("sig").cast("array<double>").alias("sig"), F.size("sig").alias("width"), *by) for df, c in ((assets, "asset_id"), (observed, "observed_id"))]
    keys = [*by, "width"]
    o = sides[1].where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    drawn = o.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= PIVOTS)
    pivots = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "sig"))).alias("p")).select(*keys, F.col("p.sig").alias("p"))
    pivots = written(pivots.withColumn("group", F.monotonically_increasing_id()), "pivots")
    far = F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: difference(F.col("sig"), F.col("p")[F.least(i, F.size("p") - 1)]))
    a, o = (x.join(pivots, keys).select("group", "id", "sig", far.alias("d")) for x in (sides[0], o))
    (a, a_bounds), (o, o_bounds) = blocked(a, F.array_min("d") + SLACK), blocked(o, F.lit(0.0))
    o_bounds = o_bounds.select("group", F.col("block").alias("o_block"), *(F.col(f"{s}{i}").alias(f"o_{s}{i}") for s in ("low", "high") for i in range(PIVOTS)))
    near = " AND ".join(f"o_low{i} <= high{i} AND low{i} <= o_high{i}" for i in range(PIVOTS))
    pairs = written(a_bounds.join(o_bounds, "group").where(near).select("group", F.col("block").alias("a_block"), "o_block"), "block-pairs")
    left = a.withColumnRenamed("block", "a_block").join(pairs, ["group", "a_block"]).select("group", "a_block", "o_block", F.lit(0).alias("kind"), "sig", "d", "reach", F.col("id").alias("asset_id"), F.lit(None).cast(kinds["observed_id"]).alias("observed_id"))
    right = o.withColumnRenamed("block", "o_block").join(pairs, ["group", "o_block"]).select("group", "a_block", "o_block", F.lit(1).alias("kind"), "sig", "d", "reach", F.lit(None).cast(kinds["asset_id"]).alias("asset_id"), F.col("id").alias("observed_id"))
    met = left.unionByName(right).repartition("group", "a_block", "o_block").sortWithinPartitions("group", "a_block", "o_block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for key, rows in runs_of(batches, 4):
            part = [rows.column(c).combine_chunks() for c in ("sig", "d", "reach", "asset_id", "observed_id")]
            sig, d = (x.flatten().to_numpy().reshape(rows.num_rows, -1) for x in part[:2])
            if key[3] == 0:
                held = key[:3], sig, d, part[2].to_numpy(), part[3]
            elif held and held[0] == key[:3]:
                yield from compared(*held[1:], sig, d, part[4])

    found = met.mapInArrow(run, f"asset_id {kinds['asset_id']}, observed_id {kinds['observed_id']}, diff double")
    score = F.bround(1 - F.col("diff"), 6)
    best = found.groupBy("asset_id").agg(F.min(F.struct((-score).alias("m"), "observed_id")).alias("b"))
    return best.select("asset_id", F.col("b.observed_id").alias("observed_id"), (-F.col("b.m")).alias("score"))


def compared(sig: np.ndarray, d: np.ndarray, reach: np.ndarray, ids: pa.Array, others: np.ndarray, far: np.ndarray, other_ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of each asset's observed signatures in reach, those within SLACK of its nearest one: asset, observed, difference."""
    for at in range(0, len(sig), STRIP):
        strip = slice(at, at + STRIP)
        open_ = np.ones((len(sig[strip]), len(others)), bool)
        for i in range(d.shape[1]):
            open_ &= np.abs(d[strip, None, i] - far[None, :, i]) <= reach[strip, None]
        rows, columns = np.nonzero(open_)
        if not len(rows):
            continue
        total = np.zeros(len(rows))
        for k in range(sig.shape[1]):  # in the order of the elements, as Spark's aggregate adds them
            total += np.abs(sig[strip][rows, k] - others[columns, k])
        total /= sig.shape[1]
        least = np.full(len(sig[strip]), np.inf)
        np.minimum.at(least, rows, total)
        kept = np.flatnonzero(total <= least[rows] + SLACK)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[kept] + at)), other_ids.take(pa.array(columns[kept])), pa.array(total[kept])], names=["asset_id", "observed_id", "diff"])
