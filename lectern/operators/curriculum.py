"""Units, standards and their sections from the numbered lines of curriculum documents.

What a line belongs to is state that earlier lines have set: the unit, the section within it, the entry within that. Each
is the last value that some line has set, so a document is cut into ranges of lines; within a range the last value is a
window, and what a range hands on is one row for it. A long document is many windows, none of them whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.mining import is_running_head
from lectern.scratch import written

#: Lines of a document in one window.
RANGE = 10_000
#: Numbers that a unit may have.
MOST_UNITS = 40

# What begins a unit, its sections, a standard, a bullet, and what ends the standards.
UNIT = r"^\s*\(([0-9]{1,2})\)\s*(\S.*\S|\S)\s*$"
SECTIONS = {"inquiry": r"^\s*<\s*탐구\s*활동\s*>", "explain": r"^\s*\(가\)\s*성취기준\s*해설", "consider": r"^\s*\(나\)\s*성취기준\s*적용"}
BULLET = r"^\s*[•·⋅]\s*(.*)$"
END = r"^\s*3\.\s*교수"


def parse_unit_head(line: Column) -> Column:
    """`(3) name` as number and name, or null."""
    n = F.regexp_extract(line, UNIT, 1)
    return F.when(n != "", F.struct(n.cast("int").alias("unit_no"), F.regexp_extract(line, UNIT, 2).alias("name")))


def section_of(line: Column) -> Column:
    """inquiry, explain or consider where a line begins that section, or null."""
    return F.coalesce(*(F.when(line.rlike(mark), name) for name, mark in SECTIONS.items()))


def global_unit_no(standards: DataFrame, subjects: DataFrame) -> DataFrame:
    """`global_no` for rows (subject, unit_no): the base of their subject (subject, base) and their own number; null where the subject isn't known."""
    return standards.join(subjects.select("subject", "base"), "subject", "left").withColumn("global_no", F.col("base") + F.col("unit_no")).drop("base")


def carried(lines: DataFrame, doc: str, line_no: str, values: dict[str, Column], size: int = RANGE) -> DataFrame:
    """`lines` with, for each name in `values`, the last of its values up to and with the line that isn't null.

    Lines of a document are looked at in ranges of `size` numbers; what a range begins with comes from the ranges before it.
    """
    at = lines.withColumns({f"own {k}": c for k, c in values.items()}).withColumn("line range", F.floor(F.col(line_no) / size))
    last = {k: F.max_by(F.col(f"own {k}"), F.when(F.col(f"own {k}").isNotNull(), F.col(line_no))) for k in values}
    ends = at.groupBy(doc, "line range").agg(*(c.alias(f"end {k}") for k, c in last.items()))
    before = Window.partitionBy(doc).orderBy("line range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(doc, "line range", *(F.last(f"end {k}", ignorenulls=True).over(before).alias(f"from {k}") for k in values))
    within = Window.partitionBy(doc, "line range").orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(ends, [doc, "line range"]).withColumns({k: F.coalesce(F.last(f"own {k}", ignorenulls=True).over(within), F.col(f"from {k}")) for k in values})
    return out.drop("line range", *(f"{p} {k}" for p in ("own", "from") for k in values))


def entries(lines: DataFrame, prefix: str, heads: str = r"^$a") -> DataFrame:
    """(doc_id, line_no, unit_no, section, code, text): standards (section `std`) and bullets of sections, from lines (doc_id, line_no, line); and unit heads (section `unit`).

    A unit's head counts where its number comes up first; a standard's code sets the unit too. Unit, section and code
    lines and bullets end what is open; other lines go on with it: a line that ends with a blank ends a word. Lines
    behind `3. 교수` don't count; blank lines, page numbers and running heads are passed over.
    """
    code = rf"^\s*\[{prefix}([0-9]{{2}})-([0-9]{{2}})\]\s*(.*)$"
    plain = lines.where(F.col("line").isNotNull())
    ends = plain.where(F.col("line").rlike(END)).groupBy("doc_id").agg(F.min("line_no").alias("last_line"))
    plain = plain.join(ends, "doc_id", "left").where(F.col("last_line").isNull() | (F.col("line_no") < F.col("last_line"))).drop("last_line")
    head, of = parse_unit_head(F.col("line")), F.regexp_extract("line", code, 1)
    kind = F.when(head.isNotNull(), "unit").when(section_of(F.col("line")).isNotNull(), section_of(F.col("line"))).when(of != "", "std").when(F.col("line").rlike(BULLET), "bullet")
    marked = plain.where(~is_running_head(F.col("line"), heads)).withColumn("kind", kind)
    marked = marked.withColumn("number", F.when(F.col("kind") == "unit", head.unit_no).when(F.col("kind") == "std", of.cast("int")))
    marked = written(marked.withColumn("name", F.when(F.col("kind") == "unit", head["name"])), "curriculum-lines")
    first = marked.where("number IS NOT NULL").groupBy("doc_id", "number").agg(F.min("line_no").alias("first_line"))
    known = marked.join(first, ["doc_id", "number"], "left")
    begins = (F.col("kind") == "unit") & (F.col("line_no") == F.col("first_line")) & F.col("number").between(1, MOST_UNITS)
    is_section = F.col("kind").isin(*SECTIONS)
    state = carried(known, "doc_id", "line_no", {
        "unit_no": F.when(begins | (F.col("kind") == "std"), F.col("number")),
        "section": F.when(begins, "none").when(is_section | (F.col("kind") == "std"), F.col("kind")),
        "open": F.when(F.col("kind").isNotNull(), F.struct("line_no", "kind")),
    })
    body = F.when(F.col("kind") == "std", F.regexp_extract("line", code, 3)).when(F.col("kind") == "bullet", F.regexp_extract("line", BULLET, 1))
    chunk = F.coalesce(body, F.concat(F.trim("line"), F.when(F.col("line").rlike(r"\s$"), " ").otherwise("")))
    taken = (F.col("open.kind") == "std") | (F.col("open.kind") == "bullet") & F.col("section").isin(*SECTIONS) & F.col("unit_no").isNotNull()
    texts = state.where(taken).groupBy("doc_id", F.col("open.line_no").alias("line_no")).agg(
        F.first("unit_no").alias("unit_no"), F.first("section").alias("section"),
        F.max(F.when(F.col("kind") == "std", F.concat(F.lit(f"[{prefix}"), of, F.lit("-"), F.regexp_extract("line", code, 2), F.lit("]")))).alias("code"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(state["line_no"].alias("n"), chunk.alias("c")))), lambda x: x.c), "").alias("text"),
    )
    texts = texts.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where((F.col("section") == "std") | (F.col("text") != ""))
    heads_ = known.where(begins).select("doc_id", "line_no", F.col("number").alias("unit_no"), F.lit("unit").alias("section"), F.lit(None).cast("string").alias("code"), F.col("name").alias("text"))
    return texts.unionByName(heads_)


def unit_report(found: DataFrame) -> DataFrame:
    """For each unit of each document its name, standards, letters in these, and bullets of each section, from `entries`."""
    count = lambda s: F.count_if(F.col("section") == s)
    name = F.coalesce(F.max(F.when(F.col("section") == "unit", F.col("text"))), F.concat(F.lit("("), F.col("unit_no").cast("string"), F.lit(")")))
    letters = F.coalesce(F.sum(F.when(F.col("section") == "std", F.length("text"))), F.lit(0)).cast("long")
    return found.groupBy("doc_id", "unit_no").agg(name.alias("name"), count("std").alias("standards"), letters.alias("letters"), *(count(s).alias(s) for s in SECTIONS))
