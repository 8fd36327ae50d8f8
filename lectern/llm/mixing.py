"""Operator 5: mixing sources to target weights by Pareto order sampling.

A source's target, in words, over its size is the number of copies of each of its
documents. The whole copies are certain. For what is left, each document has an
inclusion probability that grows with its weight (the square root of its size) and
comes to the rest of the target in words; documents are ranked by random odds over
inclusion odds, and the first ones are taken until the rest of the target is reached.
The last document is taken if that comes nearer to the target.

The place where a source is cut is found by two rounds of sums over 4,096 ranges of the
rank, so only rows of one range in 16.8 million are ever sorted; every row is then
decided by comparing its rank with its source's cut. DataFrame functions only.

Defined results: null text has no words and is taken with 0 words; a null source is a
source of its own, the last; random numbers come from a digest of id and size, so reruns
agree and rows alike in both share one decision; an empty table gives an empty result;
other columns of the input pass through `mix_copies` unchanged, whatever their names, and
are ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.scratch import written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
RANGES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes` (one row for each source: source, source_size) with `target`: shares by weight that stop at a cap.

    The excess over caps goes to the others by weight until none is above: sources in
    the order of cap over weight are capped as long as that is below what a unit of
    weight gets when they are. One row for each source passes through one task.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("n", n).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_COPIES)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("rest", F.sum("source_size").over(everything) * TOTAL_SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("unit", F.col("rest") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    unit = F.max(F.when(F.col("cap") / F.col("weight") > F.col("unit"), F.col("unit"))).over(everything)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(unit * F.col("weight"), F.col("cap").cast("double")))).drop("n", "weight", "cap", "rest", "unit")


def rank(doc_id: Column, size: Column, share: Column, mean_weight: Column) -> Column:
    """Random odds over inclusion odds; 0 where inclusion is certain, null where it is impossible."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    p = F.try_divide(share * F.sqrt(size.cast("double")), mean_weight)
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / F.try_divide(p, 1 - p))


def by_source(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with the columns `other` has for their source; null is a source like any other."""
    other = other.withColumnRenamed("source", "__other")
    return rows.join(other, F.col("source").eqNullSafe(F.col("__other")), how).drop("__other")


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source with a rest to sample: the row (cut_rank, cut_id) where it is reached, and whether that row is taken."""
    plan = plan.where("rest > 0").select("source", "rest", "share", "mean_weight").withColumn("under", F.lit(0).cast("long"))
    ranked = rows.where("size > 0")
    place = [F.floor(F.col("at") * RANGES), F.floor(F.col("at") * RANGES * RANGES)]
    found = plan.withColumn("cell", F.lit(0).cast("long"))
    for k in (0, 1):
        own = place_rows(ranked, found, k).select("source", place[k].alias("next"), "size")
        sums = own.groupBy("source", "next").agg(F.sum("size").alias("in_cell"))
        upto = Window.partitionBy("source").orderBy("next")
        sums = sums.withColumn("upto", F.sum("in_cell").over(upto))
        met = by_source(sums, found).where(F.col("under") + F.col("upto") >= F.col("rest"))
        start = (F.col("under") + F.col("upto") - F.col("in_cell")).alias("under")
        crossed = met.groupBy("source").agg(F.min(F.struct("next", start, "rest", "share", "mean_weight")).alias("c"))
        found = written(crossed.select("source", "c.rest", "c.share", "c.mean_weight", "c.under", F.col("c.next").alias("cell")), "cuts")
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first())
    last = place_rows(ranked, found, 2).withColumn("upto", F.col("under") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = last.where("upto >= rest").groupBy("source").agg(F.min(F.struct("upto", "rank", F.col("doc_id").isNotNull().alias("named"), "doc_id", "size", "rest")).alias("c"))
    return over.select("source", F.col("c.rank").alias("cut_rank"), F.col("c.doc_id").alias("cut_id"), (F.col("c.upto") - F.col("c.rest") <= F.col("c.rest") - (F.col("c.upto") - F.col("c.size"))).alias("cut_in"))


def place_rows(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Rows of the range found so far (k=0: all), with their rank and its place between 0 and 1."""
    out = by_source(rows, found)
    out = out.withColumn("rank", rank(F.col("doc_id"), F.col("size"), F.col("share"), F.col("mean_weight")))
    out = out.withColumn("at", F.coalesce(F.col("rank") / (1 + F.col("rank")), F.lit(1.0)))
    return out if k == 0 else out.where(F.floor(F.col("at") * RANGES**k) == F.col("cell"))


def plan_of(rows: DataFrame) -> DataFrame:
    """By source: size, target, whole copies, the rest in words, and what the ranks need."""
    size = F.col("size")
    sizes = rows.groupBy("source").agg(F.sum(size).alias("source_size"), F.try_divide(F.sum(size * F.sqrt(size.cast("double"))), F.sum(size)).alias("mean_weight"))
    copies = F.try_divide("target", "source_size")  # null for a source without words
    plan = targets(sizes).withColumn("whole", F.coalesce(F.floor(copies), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return plan.withColumn("share", F.coalesce(F.try_divide("rest", "source_size"), F.lit(0.0)))


def decided(df: DataFrame) -> DataFrame:
    """`df` (columns __id, __source, __size and maybe __row) with source_size, target and copies."""
    rows = written(df.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size")), "sizes")
    plan = written(plan_of(rows), "plan")
    law = by_source(plan, cuts(rows, plan), "left").withColumnRenamed("source", "of")
    law = written(law.select(*(F.col(c).alias(f"__{c}") for c in law.columns)), "law")
    out = df.join(law, F.col("__source").eqNullSafe(F.col("__of")))
    r = rank(F.col("__id"), F.col("__size"), F.col("__share"), F.col("__mean_weight"))
    before = F.coalesce(F.col("__id") < F.col("__cut_id"), F.col("__id").isNull() & F.col("__cut_id").isNotNull())
    taken = F.col("__cut_in").isNotNull() & ((r < F.col("__cut_rank")) | ((r == F.col("__cut_rank")) & (before | (F.col("__id").eqNullSafe(F.col("__cut_id")) & F.col("__cut_in")))))
    return out.withColumn("__copies", F.col("__whole") + F.coalesce(taken, F.lit(False)).cast("long"))


def marked(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """`df` as one column, __row, beside what the mix looks at: no name of its columns can clash."""
    return df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{source}`").alias("__source"), words(F.col(f"`{text}`")).alias("__size"), F.struct("*").alias("__row"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of `df`: doc_id, size, source_size, target (of its source) and taken, the words the mix takes."""
    return decided(marked(df, doc_id, text, source).drop("__row")).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def mix_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of `df` as often as the mix takes them."""
    out = decided(marked(df, doc_id, text, source)).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


ORACLE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * sqrt(size::DOUBLE)) / nullif(sum(size), 0) AS mean_weight,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][n % 3 + 1] AS weight, source_size * 2 AS cap FROM s
), k AS (
  SELECT *, (sum(source_size) OVER () * 1.5
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM w
), t AS (
  SELECT source, source_size, mean_weight,
    least(cap::DOUBLE, coalesce(max(CASE WHEN cap / weight > unit THEN unit END) OVER () * weight, cap::DOUBLE)) AS target
  FROM k
), p AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole, target - coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT * source_size AS rest FROM t
), r AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.rest,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    rest / nullif(source_size, 0) * sqrt(size::DOUBLE) / mean_weight AS pr
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), q AS (
  SELECT *, CASE WHEN pr >= 1 THEN 0.0::DOUBLE WHEN pr > 0 THEN (u / (1 - u)) / (pr / (1 - pr)) END AS rk FROM r
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rk NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN rest > 0 AND rk IS NOT NULL AND (upto < rest OR (upto - size < rest AND upto - rest <= rest - (upto - size))) THEN 1 ELSE 0 END) AS taken
FROM c
"""
