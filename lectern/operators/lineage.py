"""Manifests, alignment, stages and residuals of multi-stage document jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.windows import valid_prefix


def manifest_join(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Expected sources (sha256, items) against observed ones: existence, equal hash and equal count, null where unknown."""
    o = observed.select(key, F.lit(True).alias("exists"), F.col("sha256").alias("o_sha"), F.col("items").alias("o_items"))
    out = expected.join(o, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    out = out.withColumn("hash_ok", F.col("sha256") == F.col("o_sha")).withColumn("items_ok", F.col("items") == F.col("o_items"))
    return out.select(key, "exists", "hash_ok", "items_ok", (F.col("exists") & F.coalesce("hash_ok", F.lit(False)) & F.coalesce("items_ok", F.lit(True))).alias("ok"))


def aligned_pairs(source: DataFrame, generated: DataFrame, number: str) -> DataFrame:
    """Each number with its occurrences on both sides: a pair if once on each, else an issue."""
    a, b = source.groupBy(number).agg(F.count("*").alias("n_source")), generated.groupBy(number).agg(F.count("*").alias("n_generated"))
    both = a.join(b, number, "full_outer").select(number, F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_generated", F.lit(0)).alias("n_generated"))
    s, g = F.col("n_source"), F.col("n_generated")
    return both.withColumn("state", F.when((s == 1) & (g == 1), "pair").when(s == 0, "missing_source").when(g == 0, "missing_generated").when(s > 1, "duplicate_source").otherwise("duplicate_generated"))


def align_pages(source: DataFrame, generated: DataFrame) -> DataFrame:
    """Pages of both sides by number, unmatched ones kept."""
    return source.select("doc_id", "page_no", F.lit(True).alias("a")).join(generated.select("doc_id", "page_no", F.lit(True).alias("b")), ["doc_id", "page_no"], "full_outer").select("doc_id", "page_no", F.coalesce("a", F.lit(False)).alias("in_source"), F.coalesce("b", F.lit(False)).alias("in_generated"))


def assign_region(lines: DataFrame, starts: DataFrame, part: list[str], at: str, start: str, name: str) -> DataFrame:
    """Each line with the last start at or before it: both in one ordered run, so no range join is needed."""
    from pyspark.sql.window import Window

    a = lines.withColumn("__k", F.lit(1)).withColumn("__at", F.col(at)).withColumn("__name", F.lit(None).cast(starts.schema[name].dataType))
    b = starts.select(*part, F.col(start).alias("__at"), F.col(name).alias("__name")).withColumn("__k", F.lit(0))
    w = Window.partitionBy(*part).orderBy("__at", "__k", F.col("__name").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("region", F.last("__name", ignorenulls=True).over(w))
    return both.where("__k = 1").drop("__k", "__at", "__name")


def resume_plan(stages: DataFrame, plan: DataFrame) -> DataFrame:
    """Stages (source, stage, rank, valid) still to run: those of the plan behind the leading run of valid ones."""
    done = valid_prefix(stages, "source", "rank", "valid").select("source", "stage")
    todo = stages.select("source").distinct().crossJoin(plan)  # the plan is a list of stages
    return todo.join(done, ["source", "stage"], "left_anti")


def job_status(items: DataFrame) -> DataFrame:
    """For each job: no failure is review, all failed is failed, else partial_failure; with counts."""
    bad = F.col("status").isin("failed", "manual_required", "conversion_failed")
    n = items.groupBy("job_id").agg(F.count("status").alias("n_items"), F.count_if(bad).alias("n_failed"))
    return n.withColumn("state", F.when(F.col("n_failed") == 0, "review").when(F.col("n_failed") == F.col("n_items"), "failed").otherwise("partial_failure"))


def job_capabilities(items: DataFrame) -> DataFrame:
    """What can be done with a job: review, typeset (every selected item is confirmed and has text), retry."""
    return items.groupBy("job_id").agg(
        F.bool_or(F.col("status") == "ready").alias("can_review"),
        F.coalesce(F.bool_and(F.when(F.col("selected"), F.col("confirmed") & (F.col("text") != ""))), F.lit(False)).alias("can_typeset"),
        F.bool_or(F.col("status") == "failed").alias("can_retry"),
    )


TERMINAL = ("succeeded", "failed", "cancelled")


def latest_operation(events: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The current state of each operation: the last terminal state if there is one, else the last state."""
    order = F.struct(F.col("status").isin(*TERMINAL).alias("terminal"), at, seq)
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.count("*").alias("n_events"))


def monotone_progress(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Progress as shown: never less than before within a job."""
    from pyspark.sql.window import Window

    return events.withColumn("shown", F.max("progress").over(Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def live_status(seen: DataFrame, planned: DataFrame) -> DataFrame:
    """Items by status; planned ones not yet seen are queued."""
    s = planned.join(seen, "item", "left")
    return s.groupBy(F.coalesce("status", F.lit("queued")).alias("status")).agg(F.count("*").alias("n"))
