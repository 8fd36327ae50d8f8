"""Range joins of boxes by grid cells, and sweeps over a page's rows in the order of a coordinate.

A box lies on the level of the power of two that its longer side has at most, and in the few
cells of that size that it touches. Two boxes that meet share a cell of the larger one's level,
so each is looked for on its own level and on all higher ones that the other side has: cells are
join keys, and a page with many boxes spreads over as many keys as it has cells. Pages with few
boxes on one side need no cells.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scratch import bucketed, forget, fresh, written

SIDES = ("x0", "y0", "x1", "y1")
#: The least level there is; cells of that size hold points.
LOWEST = -20


def level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    side = F.greatest(x1 - x0, y1 - y0)
    return F.when(side > 2.0**LOWEST, F.ceil(F.log2(side))).otherwise(LOWEST).cast("int")


def cell(x: Column, at: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(2.0), at.cast("double")))


#: Boxes of `b` on a page up to which its boxes are compared with all of `a`; cells are for pages with more.
FEW = 64


def meeting(a: DataFrame, b: DataFrame, page: list[str], points: bool = False) -> DataFrame:
    """Pairs of rows of `a` (`page` and columns a_...) and `b` (b_...), boxes a_x0 to a_y1 and b_x0 to b_y1, that touch or overlap on a page; each once.

    Boxes with a null side, or with sides the wrong way round, meet nothing. If the boxes of `a` are `points`, without
    width and height, none of them is larger than one of `b`, and one of the two joins over cells is enough. Pages with FEW
    boxes of `b` or less, which bounds the pairs, are joined as they are. Both sides are stored, `b` by page, so that
    what was shuffled to make them is deleted before they are joined.
    """
    n = fresh("n", a, b)
    b = bucketed(standing(b, "b_").repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), *page), "boxes", *page)
    a = standing(a, "a_")
    a = both_sides(written(a.drop("a_x1", "a_y1"), "standing")) if points else written(a, "standing")
    crowded = written(b.groupBy(*page).agg(F.count("*").alias(n)).where(F.col(n) > FEW).drop(n), "crowded-pages")
    if crowded.isEmpty():
        forget(crowded)
        return beside(a, b, page, points)
    alone, full = (lambda df: df.join(crowded, page, "left_anti")), (lambda df: df.join(crowded, page, "left_semi"))
    return beside(a, alone(b), page, points).unionByName(meeting_in_cells(full(a), full(b), page, points))


def standing(df: DataFrame, p: str) -> DataFrame:
    """Boxes whose sides aren't null or the wrong way round."""
    return df.where((F.col(f"{p}x0") <= F.col(f"{p}x1")) & (F.col(f"{p}y0") <= F.col(f"{p}y1")))


def touching() -> Column:
    return (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))


def beside(a: DataFrame, b: DataFrame, page: list[str], points: bool = False) -> DataFrame:
    """What meets among all pairs of a page; both sides of points are the same, so only one of them is stored and shuffled."""
    return (both_sides(a.drop("a_x1", "a_y1").join(b, page)) if points else a.join(b, page)).where(touching())


def both_sides(points: DataFrame) -> DataFrame:
    return points.withColumns({"a_x1": F.col("a_x0"), "a_y1": F.col("a_y0")})


def meeting_in_cells(a: DataFrame, b: DataFrame, page: list[str], points: bool = False) -> DataFrame:
    """The same over cells, for boxes that stand and pages with any number of them."""

    def placed(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn(f"{p}level", level(*(F.col(p + s) for s in SIDES)))

    def in_cells(df: DataFrame, p: str) -> DataFrame:
        """Each row once for each cell of level `grid level` that it touches."""
        at = F.col("grid level")
        across = F.sequence(cell(F.col(f"{p}x0"), at), cell(F.col(f"{p}x1"), at))
        down = F.sequence(cell(F.col(f"{p}y0"), at), cell(F.col(f"{p}y1"), at))
        return df.withColumn("grid x", F.explode(across)).withColumn("grid y", F.explode(down))

    a, b = placed(a, "a_"), placed(b, "b_")
    levels = {p: df.select(*page, F.col(f"{p}level").alias("grid level")).distinct() for p, df in (("a_", a), ("b_", b))}
    keys = [*page, "grid level", "grid x", "grid y"]
    # Of the cells that two boxes share, the one with the corner where their common part begins counts.
    once = (cell(F.greatest("a_x0", "b_x0"), F.col("grid level")) == F.col("grid x")) & (cell(F.greatest("a_y0", "b_y0"), F.col("grid level")) == F.col("grid y"))

    def joined(large: DataFrame, p: str, small: DataFrame, q: str, least: Column) -> DataFrame:
        own = in_cells(large.withColumn("grid level", F.col(f"{p}level")), p)
        looked = in_cells(small.join(levels[p], page).where(least), q)
        return own.join(looked, keys).where(touching() & once).drop("grid level", "grid x", "grid y")

    up = joined(b, "b_", a, "a_", F.col("grid level") >= F.col("a_level"))
    if points:
        return up.drop("a_level", "b_level")
    down = joined(a, "a_", b, "b_", F.col("grid level") > F.col("b_level"))
    return up.unionByName(down).drop("a_level", "b_level")


def swept(rows: DataFrame, page: list[str], order: list[str], columns: list[str], sweep, schema: str) -> DataFrame:
    """What `sweep()` gives for each page: a new one takes each row (`columns`, in `order`) and gives None or a row of the result behind `page`.

    A page's rows come one after the other, in one task; what is held is what the sweep keeps.
    """
    n = len(page)
    ordered = rows.repartition(*page).sortWithinPartitions(*page, *order).select(*page, *columns)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or row[:n] != now:
                    now, own = row[:n], sweep()
                got = own(*row[n:])
                if got is not None:
                    found.append((*row[:n], *got))
            if found:
                arrays = [pa.array([f[i] for f in found], batch.column(i).type if i < n else None) for i in range(len(found[0]))]
                yield pa.RecordBatch.from_arrays(arrays, names=names).cast(pa.schema([(names[i], batch.column(i).type if i < n else types[i - n]) for i in range(len(names))]))

    names = [*page, *(part.split()[0].strip("`") for part in schema.split(", "))]
    types = [{"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[part.split()[1]] for part in schema.split(", ")]
    return ordered.mapInArrow(run, f"{kinds}, {schema}")


class NearestBefore:
    """A sweep from left to right: for each word the marker at its left whose height is nearest, of these the rightmost, then the one with the least id.

    Held are the heights of markers so far, sorted, and for each the marker furthest to the right.
    """

    def __init__(self):
        self.heights: list[float] = []
        self.last: dict[float, tuple] = {}

    def __call__(self, x: float, kind: int, y: float, word, marker):
        if kind == 0:
            key = (-x, marker)
            if y not in self.last:
                insort(self.heights, y)
                self.last[y] = key
            elif key < self.last[y]:
                self.last[y] = key
            return None
        at = bisect_left(self.heights, y)
        near = self.heights[max(0, at - 1) : at + 1]
        if not near:
            return None
        return word, min((abs(h - y), self.last[h]) for h in near)[1][1]


class FirstAtHeight:
    """A sweep from top to bottom: for each point the least (col, y0, item) of the items whose heights hold it; a heap drops items once they have ended."""

    def __init__(self):
        self.open: list[tuple] = []

    def __call__(self, y: float, kind: int, col, item, y1: float, point):
        if kind == 0:
            heapq.heappush(self.open, (col, y, item, y1))
            return None
        while self.open and self.open[0][3] < y:
            heapq.heappop(self.open)
        return (point, self.open[0][2]) if self.open else None
