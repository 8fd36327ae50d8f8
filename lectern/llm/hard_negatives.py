"""Operator 11: hard negatives by LEMP-style coordinate pruning.

Rows are put into length buckets, each dealt into blocks of at most ROWS rows. Anchors,
in blocks too, meet the row blocks from long to short. For each anchor and row block the
score still needed, over the product of lengths, is the least cosine that helps; above
one the block is left out. Otherwise that cosine bounds the values that a useful row can
have in each of the anchor's FOCUS largest coordinates. A block keeps its unit vectors'
values sorted by coordinate, so each range is a stretch of such a list, and candidates
are the rows in all stretches. Only they are multiplied out, exactly, in integers. What
is needed rises as an anchor's best scores are found.

Two searches use this. Positives: the best rows of the anchor's label. Negatives: for
each anchor and positive the best rows of other labels whose score is LEAST to MOST
hundredths of the positive's.

Every task has one anchor block and a share of the row blocks, and gives its own best
rows for each anchor; these are merged by rank. So no group grows with the table, and
every pair of an anchor and a row is decided exactly: bounds only leave out what cannot
be among the results (they are widened by SLACK against rounding).

Defined results: rows with a null label, a null vector or a component that is null or not
finite take no part; rows with a null id are no anchors and come last among ties; rows
with equal ids are rows of their own, each an anchor; rows only meet rows of as many
components; components beyond what keeps a score within 62 bits count as that bound; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.arrow import runs_of
from lectern.scratch import written

SCALE = 256
#: Ids that are divisible by EVERY are anchors; rows whose id is divisible by MOVED get the next label of LABELS.
EVERY, MOVED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of a positive's score that a hard negative's has.
LEAST, MOST = 30, 90
#: Rows in a block, anchors in a block, coordinates looked at for an anchor.
ROWS, ANCHORS, FOCUS = 4096, 8192, 4
#: Lengths in a bucket differ by less than this factor.
STRETCH = 1.1
SLACK = 1e-6
NONE = -(2**62)


def usable(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, v, norm) of the rows that take part: components scaled to whole numbers, and the vector's length."""
    bound = F.floor(F.pow(F.lit(2.0), F.lit(62.0)) ** 0.5 / F.sqrt(F.greatest(F.size("v"), F.lit(1)))).cast("double")
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, -bound), bound)).cast("long"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    moved = F.when(F.col("id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    named = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").cast("long").alias("label"))
    kept = named.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), moved.alias("label"), whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def in_blocks(rows: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """`rows` with a number `name` that deals those alike in `by` into blocks of about `size` rows."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(counts, by).withColumn(name, F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")


class Block:
    """Rows of one length bucket, with a sorted list of unit values for each coordinate that has been asked for."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        order = np.lexsort((ids, none))  # so that places break ties
        self.ids, self.none, self.rows, self.labels, self.vectors, norms = ids[order], none[order], rows[order], labels[order], vectors[order], norms[order]
        self.longest, self.shortest = norms.max(), norms.min()
        self.units = vectors[order] / np.maximum(norms, 1e-300)[:, None]
        # Products of doubles are exact while all sums stay below 2**53.
        self.largest = np.abs(self.vectors).max(initial=0)
        self.doubles = self.vectors.astype(np.float64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.units[:, f], kind="stable")
            self.lists[f] = self.units[order, f], order
        return self.lists[f]

    def candidates(self, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Places of rows that may have at least this cosine with a unit vector; None stands for all."""
        if cosine <= 0:
            return None
        focus = np.argpartition(-np.abs(unit), min(FOCUS, len(unit)) - 1)[:FOCUS]
        turn = np.arccos(min(1.0, cosine))
        within, least = [], len(self.ids)
        for f in focus.tolist():
            own = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(own + turn) - SLACK if own + turn < np.pi else -2.0
            high = np.cos(own - turn) + SLACK if own > turn else 2.0
            values, order = self.sorted_list(f)
            a, b = np.searchsorted(values, low), np.searchsorted(values, high, "right")
            if b - a < len(values):
                within.append((b - a, order[a:b]))
        if not within:
            return None
        within.sort(key=lambda x: x[0])
        found = within[0][1]
        if len(within) > 1 and len(found):
            seen = np.zeros(len(self.ids), np.uint8)
            for _, places in within:
                seen[places] += 1
            found = found[seen[found] == len(within)]
        return np.sort(found)

    def scores(self, anchor: np.ndarray, places: np.ndarray | None) -> np.ndarray:
        exact = float(self.largest) * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**53
        own = (self.doubles if exact else self.vectors) if places is None else (self.doubles if exact else self.vectors)[places]
        return (own @ (anchor.astype(np.float64) if exact else anchor)).astype(np.int64)


class Best:
    """The best rows of one search: those with scores from low to high, of which `size` are wanted."""

    def __init__(self, low: int, high: int, size: int):
        self.low, self.high, self.size = low, high, size
        self.score = self.id = self.row = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray, rows: np.ndarray) -> None:
        """Take in rows that come sorted by falling score, ties by id."""
        a, b = np.searchsorted(-score, -self.high), np.searchsorted(-score, -self.low, "right")
        b = min(b, a + self.size)
        if a >= b:
            return
        score, ids, none, rows = (np.concatenate([x, y[a:b]]) for x, y in ((self.score, score), (self.id, ids), (self.none, none), (self.row, rows)))
        order = np.lexsort((rows, ids, none, -score))[: self.size]
        self.score, self.id, self.none, self.row = score[order], ids[order], none[order], rows[order]
        if len(order) == self.size:
            self.low = max(self.low, int(self.score[-1]))


def search(anchors: DataFrame, rows: DataFrame, by: list[str], same_label: bool, size: int) -> DataFrame:
    """(row, k, other, other_id, score): for anchor `row` and each of its ranges lows[k] to highs[k] the best `size` rows of its own label or of others, and more.

    Both sides have columns row, id, label, v, norm and `by`, which must agree, the
    vectors' width first; anchors also lows and highs. Each task gives the best of its
    share: `best` ranks them.
    """
    spark = rows.sparkSession
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(STRETCH)))).otherwise(-(2**31))
    dealt = in_blocks(rows.withColumn("bucket", bucket), [*by, "bucket"], ROWS, "block")
    asked = written(in_blocks(anchors, by, ANCHORS, "part"), "anchor-blocks")
    # A group's anchor blocks are dealt over so many shares of its row blocks that all tasks have work.
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = written(asked.groupBy(*by).agg((F.max("part") + 1).alias("parts")), "anchor-groups")
    dealt = dealt.join(groups, by).withColumn("share", F.pmod(F.xxhash64("bucket", "block"), F.lit(shares)))
    dealt = written(dealt.select(*by, "parts", "share", "bucket", "block", "row", "id", "label", "v", "norm"), "row-blocks")
    ranges = [F.lit(None).cast("array<bigint>").alias(c) for c in ("lows", "highs")]
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    of_rows = dealt.select(*by, each, "share", F.lit(1).alias("kind"), (-F.col("bucket")).alias("place"), "block", "row", "label", "norm", "id", "v", *ranges)
    of_anchors = asked.join(dealt.select(*by, "share").distinct(), by)
    zero = F.lit(0).cast("long")
    of_anchors = of_anchors.select(*by, "part", "share", F.lit(0).alias("kind"), zero.alias("place"), zero.alias("block"), "row", "label", "norm", "id", "v", "lows", "highs")
    keys = [*by, "part", "share", "kind", "place", "block"]
    met = of_anchors.unionByName(of_rows).repartition(*by, "part", "share").sortWithinPartitions(*keys)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, work = None, None
        for key, rows in runs_of(batches, len(keys)):
            if key[: n + 2] != task:
                if work:
                    yield from work.found()
                task, work = key[: n + 2], None
            row, label, norm, ids = (rows.column(c).combine_chunks() for c in ("row", "label", "norm", "id"))
            vectors = rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, key[0])
            parts = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), row.to_numpy(), label.to_numpy(), vectors, norm.to_numpy()
            if key[n + 2] == 0:
                work = Anchors(*parts, rows.column("lows").to_pylist(), rows.column("highs").to_pylist(), same_label, size)
            elif work:
                work.meet(Block(*parts))
        if work:
            yield from work.found()

    return met.mapInArrow(run, "row long, k int, other long, other_id long, score long")


class Anchors:
    """A block of anchors with the best rows found so far for each of their ranges."""

    def __init__(self, ids, none, rows, labels, vectors, norms, lows, highs, same_label: bool, size: int):
        self.rows, self.labels, self.vectors, self.norms, self.same = rows, labels, vectors, norms, same_label
        self.units = vectors / np.maximum(norms, 1e-300)[:, None]
        self.best = [[Best(a, b, size) for a, b in zip(x, y)] for x, y in zip(lows, highs)]

    def meet(self, block: Block) -> None:
        for i, best in enumerate(self.best):
            low, high = min(b.low for b in best), max(b.high for b in best)
            length = self.norms[i] * (block.longest if low > 0 else block.shortest)
            cosine = low / length - SLACK if length > 0 else 0.0 if low <= 0 else 2.0
            if cosine > 1:
                continue
            places = block.candidates(self.units[i], cosine)
            if places is not None and not len(places):
                continue
            score = block.scores(self.vectors[i], places)
            labels, rows = (block.labels, block.rows) if places is None else (block.labels[places], block.rows[places])
            fit = (score >= low) & (score <= high) & ((labels == self.labels[i]) & (rows != self.rows[i]) if self.same else labels != self.labels[i])
            fit = np.flatnonzero(fit)
            if len(fit):
                fit = fit[np.argsort(-score[fit], kind="stable")]
                at = fit if places is None else places[fit]
                for b in best:
                    b.add(score[fit], block.ids[at], block.none[at], block.rows[at])

    def found(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.best), 512):
            some = [(r, k, b) for r, best in zip(self.rows[i : i + 512].tolist(), self.best[i : i + 512]) for k, b in enumerate(best) if len(b.score)]
            if some:
                sizes = [len(b.score) for _, _, b in some]
                column = lambda name: np.concatenate([getattr(b, name) for _, _, b in some])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([r for r, _, _ in some], sizes), pa.int64()), pa.array(np.repeat([k for _, k, _ in some], sizes), pa.int32()),
                    pa.array(column("row")), pa.array(column("id"), mask=column("none")), pa.array(column("score")),
                ], names=["row", "k", "other", "other_id", "score"])


def best(found: DataFrame, size: int) -> DataFrame:
    """`found` of `search` with rank: the best `size` for each anchor and range, whatever task found them."""
    order = [F.desc("score"), F.col("other_id").asc_nulls_last(), "other"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "k").orderBy(*order))).where(F.col("rank") <= size)


def hundredths(score: Column, least: int, up: bool) -> Column:
    """`least` * score / 100 as a whole number, rounded up or down."""
    part = score.cast("decimal(38,0)") * least / 100
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive, and their places anchor_row, positive_row, negative_row."""
    rows = written(usable(df, vec_id, vector, label).withColumn("width", F.size("v")), "vectors")
    anchors = rows.where(F.col("id") % EVERY == 0)
    free = lambda x: F.array(F.lit(x).cast("long"))
    open_ended = anchors.select("*", free(NONE).alias("lows"), free(-NONE).alias("highs"))
    open_ended, labelled = (x.withColumn("own", F.col("label")) for x in (open_ended, rows))
    near = search(open_ended, labelled, ["width", "own"], True, POSITIVES)
    near = written(best(near, POSITIVES).select("row", F.col("rank").alias("place"), F.col("other").alias("positive_row"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = hundredths(F.col("positive_score"), LEAST, True), hundredths(F.col("positive_score"), MOST, False)
    ranges = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))).alias("of"))
    ranged = anchors.join(ranges, "row").select(*anchors.columns, F.col("of.low").alias("lows"), F.col("of.high").alias("highs"))
    far = best(search(ranged, rows, ["width"], False, NEGATIVES), NEGATIVES)
    far = far.select("row", (F.col("k") + 1).alias("place"), "rank", F.col("other").alias("negative_row"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    return far.join(near, ["row", "place"]).join(named, "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
        F.col("row").alias("anchor_row"), "positive_row", "negative_row",
    )


ORACLE_HARD = f"""
WITH named AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM named a JOIN named b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND {LEAST} * p.positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
