"""Operator 8: exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by successive stretches of their normalised bytes. A digit is a
stretch of WIDTHS[k] bytes, so each round deals with a geometrically longer part; what
lies behind is dealt with in stretches of STRETCH bytes, for as many rounds as the
longest texts that are still alike need. Within a round, (group so far, digit) is shuffled by
value and compared by value: no digest decides equality. Digits are shuffled by value once
in a round; rows then find their digit's label by a print of 64 bits, in rounds in which
no two different digits of a group have the same one, and by value in others. A group that is a single
document, or whose digit is shorter than its width (all its texts have ended), is
settled and leaves; only the others go on. Sizes are summed before the shuffle, and a
group's label meets its rows in a join whose large partitions adaptive execution
splits, so one group may hold any share of all rows.

Defined results: null text counts as empty; a null id sorts after all others; of rows
with the same text and id one is kept; texts of any length are compared whole; an empty
table gives an empty result; other columns of the input are ignored by `exact_groups`
and pass through `without_copies`, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scratch import bucketed, forget, kept_only, numbered, without_rows, written

#: Bytes of the digits of the first rounds, and of every later one.
WIDTHS = (48, 464, 3584, 28672)
STRETCH = 1 << 18


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one blank; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digits(raw: Column) -> dict[str, Column]:
    """The columns that hold the digits of the first rounds, and all bytes behind them."""
    out, at = {}, 1
    for k, width in enumerate(WIDTHS):
        out[f"d{k}"] = F.substring(raw, at, width)
        at += width
    return out | {"rest": F.substring(raw, at, 2**31 - 1 - at)}


def print_of(digit: Column) -> Column:
    """64 bits of a digit. Digits with different prints differ; equal prints decide nothing."""
    return F.xxhash64(digit)


def of_live(live: DataFrame, pool: DataFrame, digit: Column) -> DataFrame:
    """The live rows (row, doc_id, sha, grp) with `digit` of their row in `pool`, which may be the same table."""
    if live is pool:
        return live.select("row", "doc_id", "sha", "grp", digit.alias("digit"))
    return live.join(pool.select("row", digit.alias("digit")), "row")


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row for each row of `df`: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) and row.

    `row` names a column that numbers the rows of `df`; without one, `df` should be a stored table, whose rows are told
    apart by their place in it. The first digits of all rows are written to the shared folder, and the further ones, as
    Parquet columns, of the rows that the first round doesn't settle; each round reads its own column only, which meets
    its rows by number.
    """
    text_col = normalised(F.col(f"`{text}`"))
    place = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    plain = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_col.alias("t"), place.alias("row"))
    placed = plain.select("doc_id", "row", F.unhex(F.sha2("t", 256)).alias("sha"), *(c.alias(n) for n, c in digits(F.col("t").cast("binary")).items()))
    base = written(placed.select("row", "doc_id", "sha", "d0"), "first-digits")
    live = pool = base.withColumn("grp", F.lit(-1).cast("long"))
    pool._lectern_path, digit, settled = base._lectern_path, F.col("d0"), []
    for k in count():
        # Digits meet by value here, and only here.
        met = of_live(live, pool, digit)
        sizes = met.groupBy("grp", "digit").agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"),
        )
        # Cut off from their aggregate: the join's two sides are then plain shuffles, whose large partitions can be split.
        ended = F.length("digit") < (WIDTHS[k] if k < len(WIDTHS) else STRETCH)
        sizes = sizes.select("grp", print_of(F.col("digit")).alias("print"), "n", "first", ended.alias("ended"), F.when(F.col("n") > 1, F.col("digit")).alias("digit"))
        sizes = written(sizes, "sizes")
        # Where the digits of a group have prints of their own, a row finds its digit's label by the print; else by value.
        clash = not sizes.groupBy("grp", "print").count().where("count > 1").isEmpty()
        rows, key = (met, "digit") if clash else (of_live(live, pool, print_of(digit)).withColumnRenamed("digit", "print"), "print")
        shared = sizes.where("n > 1").select(F.col("grp").alias("s_grp"), F.col(key).alias("s_key"), "n", "first", "ended")
        alone = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        joined = rows.join(shared, (F.col("grp") == F.col("s_grp")) & (F.col(key) == F.col("s_key")), "left")
        labelled = joined.select("row", "doc_id", "sha", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("first", alone).alias("first"), (F.col("n").isNull() | F.col("ended")).alias("done"))
        labelled = written(labelled, "labelled")
        forget(sizes)
        settled.append(labelled.where("done"))
        rest = labelled.where(~F.col("done"))
        if rest.isEmpty():
            break
        live = rest.select("row", "doc_id", "sha", F.col("first.row").alias("grp"))
        if k == 0:
            forget(base)
            # In buckets by row: a round's live rows are shuffled to their digits, which stay where they are. The digests are
            # compared as a column, as a condition would join the join's keys; dealt by row alone, a bucket is one file.
            again = placed.drop("doc_id", "d0").withColumnRenamed("sha", "seen")
            found = live.select("row", "sha").join(again, "row").withColumn("same", F.col("sha") == F.col("seen"))
            pool = bucketed(found.drop("sha", "seen").repartition("row"), "live-digits", "row")
            if pool.where("same").count() != live.count():
                raise ValueError("rows have changed their places: give a stored table")
        after = k + 1 - len(WIDTHS)
        digit = F.col(f"d{k + 1}") if after < 0 else F.substring("rest", 1 + after * STRETCH, STRETCH)
    forget(pool)
    return reduce(DataFrame.unionByName, settled).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    )


def without_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay when of equal texts one does."""
    stored, row = numbered(df, "numbered")
    dropped = kept_only("dropped", lambda: exact_groups(stored, doc_id, text, row).where("not kept").select("row"))
    return without_rows(stored, row, dropped)


ORACLE_GROUPS = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
