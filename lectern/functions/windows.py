"""Expressions over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def renumber(df: DataFrame, part: list[str], order: list[Column], to: str = "ord") -> DataFrame:
    """Dense ordinals from 1 within each part."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def next_ord(df: DataFrame, part: list[str], ord_col: str = "ord") -> DataFrame:
    """For each part, the ordinal that a new row gets."""
    return df.groupBy(*part).agg((F.coalesce(F.max(ord_col), F.lit(0)) + 1).cast("long").alias("next_ord"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null in the key all stay.

    Rows with null keys take no part in the window, so they can't pile up in one task.
    """
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    ranked = df.where(~null).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n").unionByName(df.where(null))


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each class."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def gap_islands(df: DataFrame, part: list[str], value: str, ties: list[str], tol: float, to: str = "island") -> DataFrame:
    """Number the runs of values in which each differs from the one before by at most `tol`."""
    w = Window.partitionBy(*part).orderBy(value, *ties)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > tol).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(to, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def lead_boundary(df: DataFrame, part: list[str], order: list[str], start: str, end: Column, margin: float, to: str) -> DataFrame:
    """A region ends `margin` before the next one starts, or at `end`."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(to, F.coalesce(F.lead(start).over(w) - margin, end))


def carry_forward(df: DataFrame, part: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """The last value that isn't null, for this and all following rows."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def split_at_largest_gaps(df: DataFrame, part: list[str], value: str, ties: list[str], k: int, to: str = "piece") -> DataFrame:
    """Cut each ordered sequence into k pieces at its k-1 largest gaps, the earliest of equal ones."""
    w = Window.partitionBy(*part).orderBy(value, *ties)
    gaps = df.withColumn("__gap", F.col(value) - F.lag(value).over(w)).withColumn("__at", F.row_number().over(w))
    ranked = gaps.withColumn("__rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.col("__gap").desc_nulls_last(), "__at")))
    cut = ((F.col("__rank") <= k - 1) & F.col("__gap").isNotNull()).cast("int")
    order = Window.partitionBy(*part).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("__cut", cut).withColumn(to, F.sum("__cut").over(order)).drop("__gap", "__at", "__rank", "__cut")


def relative_pct(score: Column, best: Column) -> Column:
    """Score over the best, in per cent, rounded half to even, from 1 to 100."""
    return F.greatest(F.lit(1), F.least(F.lit(100), F.bround(score / best * 100, 0).cast("int")))


def adjacent_values(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Previous and next value in order; null where the place isn't unique."""
    at = Window.partitionBy(*part).orderBy(*order)
    alone = F.count("*").over(Window.partitionBy(*part, *order)) == 1
    return df.withColumn("previous", F.when(alone, F.lag(value).over(at))).withColumn("next", F.when(alone, F.lead(value).over(at)))


def latest(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """The last row of each part."""
    return df.groupBy(*part).agg(F.max_by(F.struct(*[c for c in df.columns if c not in part]), order).alias("__r")).select(*part, "__r.*")


def undo(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """All rows but the last of each part."""
    last = df.groupBy(*part).agg(F.max(order).alias(order))
    return df.join(last, [*part, order], "left_anti")


def valid_prefix(stages: DataFrame, source: str, order: str, valid: str) -> DataFrame:
    """The leading run of stages that are all valid."""
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("__ok", F.min(F.coalesce(F.col(valid), F.lit(False)).cast("int")).over(w)).where("__ok = 1").drop("__ok")


def next_pending_stage(stages: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """For each source the first planned stage (columns stage, rank) that it hasn't completed; null if none is left."""
    sources = stages.select(source).distinct()
    missing = sources.crossJoin(plan).join(stages.select(source, "stage"), [source, "stage"], "left_anti")  # the plan is a fixed list of stages
    return sources.join(missing.groupBy(source).agg(F.min_by("stage", "rank").alias("next_stage")), source, "left")


def first_big_gap(df: DataFrame, part: list[str], top: str, bottom: str, veto: str, gap: float, content: float) -> DataFrame:
    """Where content ends: the first vertical gap of at least `gap` after at least `content` of it, unless a vetoing box follows."""
    w = Window.partitionBy(*part).orderBy(top, bottom)
    end = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.min(top).over(Window.partitionBy(*part))
    later = F.max(F.col(veto).cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    cut = (F.col(top) - end >= gap) & (end - start >= content) & (later == 0)
    return df.withColumn("__end", F.when(cut, end)).groupBy(*part).agg(F.coalesce(F.min("__end"), F.max(bottom)).alias("content_end"))
