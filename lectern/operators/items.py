"""Items of documents: choices, references, contracts of structure, placement of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import blank
from lectern.functions.windows import gap_islands
from lectern.operators.quality import check

# Marks of choices and claims, priorities of document types.
CHOICE_MARKS = "①②③④⑤"
CLAIM_MARKS = "ㄱㄴㄷ"
TYPE_RANK = ("기출", "교과서", "교육과정")
SMALL_WIDTH, SMALL_PAIR, SMALL_SCALE = 168.0, 92.53, 0.70


def auto_references(hits: DataFrame, limit: int = 3, terms: int = 10, per_search: int = 5) -> DataFrame:
    """For each context the first `limit` distinct pages of its searches.

    hits: context_id, term_idx, doc_type, hit_rank, document_id, page_no. Searches are taken by term, then by the type's
    priority, then by rank; lessons (negative ids) and other types don't count.
    """
    rank = F.array_position(F.array(*map(F.lit, TYPE_RANK)), F.col("doc_type"))
    own = hits.where((F.col("term_idx") < terms) & (F.col("hit_rank") <= per_search) & (F.col("document_id") > 0)).withColumn("type_rank", rank).where("type_rank > 0")
    first = own.groupBy("context_id", "document_id", "page_no").agg(F.min(F.struct("term_idx", "type_rank", "hit_rank")).alias("at"))
    order = Window.partitionBy("context_id").orderBy("at", "document_id", "page_no")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("context_id", "place", "document_id", "page_no")


def reference_bundle(refs: DataFrame, pages: DataFrame, units: DataFrame, examples: DataFrame, size: int = 6000, most: int = 3) -> DataFrame:
    """Each reference (ref_id, document_id, page_no, code, frame_id) with its page's text, its unit and some examples of its frame."""
    order = Window.partitionBy("frame_id").orderBy("example_id")
    few = examples.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    nested = few.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x.text).alias("examples"))
    page = pages.select("document_id", "page_no", F.substring("body", 1, size).alias("page_text"))
    return refs.join(page, ["document_id", "page_no"], "left").join(units.select("code", "unit_name", F.col("text").alias("standard_text")), "code", "left").join(nested, "frame_id", "left")


def select_candidates(groups: DataFrame, wanted: DataFrame | None = None, group: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, unknown): candidates (group, item_id) of a group and among the wanted ids, a prefix of `most`; wanted ids that there aren't."""
    found = groups if group is None else groups.where(F.col("group") == group)
    unknown = groups.select("item_id").limit(0)
    if wanted is not None:
        unknown = wanted.select("item_id").distinct().join(groups, "item_id", "left_anti")
        found = found.join(wanted.select("item_id").distinct(), "item_id", "left_semi")
    found = found.orderBy("group", "item_id")
    return (found if most is None else found.limit(most)), unknown


def choice_texts(words: DataFrame, page: list[str], tol: float = 12.0) -> DataFrame:
    """The text of each choice: words behind its mark in the row of marks that is nearest; nothing unless each mark occurs once.

    words: word_id, text, x0, y0. Rows of marks are runs of their heights.
    """
    no = F.instr(F.lit(CHOICE_MARKS), F.col("text"))
    marked = words.where((F.length("text") == 1) & (no > 0)).withColumn("no", no)
    whole = marked.groupBy(*page).agg(F.count("*").alias("n"), F.count_distinct("no").alias("d")).where(f"n = {len(CHOICE_MARKS)} and d = {len(CHOICE_MARKS)}").select(*page)
    rows = gap_islands(marked.join(whole, page, "left_semi"), page, "y0", ["no"], tol)
    marks = rows.withColumn("row_y", F.avg("y0").over(Window.partitionBy(*page, "island"))).select(*page, "no", F.col("x0").alias("mx"), "row_y")
    plain = words.where(~((F.length("text") == 1) & (no > 0))).join(marks, page)
    near = plain.where("mx <= x0").groupBy(*page, "word_id").agg(F.min(F.struct(F.abs(F.col("y0") - F.col("row_y")).alias("d"), (-F.col("mx")).alias("m"), "no")).alias("b"), F.first("text").alias("text"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "word_id", "text"))), lambda w: w.text), " ")
    return near.groupBy(*page, F.col("b.no").alias("no")).agg(F.regexp_replace(text, r"\s*,\s*", ", ").alias("choice"))


def structure_contract(items: DataFrame) -> DataFrame:
    """Items whose parsed structure is broken.

    items: item_id, number, parsed_number, stem, ask, asks, choice_ords (array), claims (array).
    """
    stem = F.trim(F.coalesce("stem", F.lit("")))
    return check(items, ["item_id"], [
        ("number_mismatch", "error", ~F.col("number").eqNullSafe(F.col("parsed_number"))),
        ("stem_missing", "error", stem == ""),
        ("stem_fragment", "error", (stem != "") & (F.length(stem) <= 4) & stem.rlike("(은|는|이|가|을|를|의|에)$")),
        ("choices", "error", F.coalesce(F.col("choice_ords").cast("array<int>") != F.sequence(F.lit(1), F.lit(5)), F.lit(True))),
        ("claims", "error", ~F.coalesce(F.size("claims"), F.lit(0)).isin(0, -1, 3)),
        ("asks", "error", F.coalesce("asks", F.lit(0)) != 1),
    ])


def generated_contract(items: DataFrame) -> DataFrame:
    """Items of a generated document that lack something.

    items: item_id, number, text, needs_claims, fifth_choice.
    """
    t = F.coalesce("text", F.lit(""))
    marks = F.array(*map(F.lit, CHOICE_MARKS))
    claims = F.array(*(F.lit(m + ".") for m in CLAIM_MARKS))
    leaders = F.regexp_extract_all(t, F.lit(r"(?m)^\s*([0-9]{1,2})\.\s"), 1)
    return check(items, ["item_id"], [
        ("choice_marks", "error", F.exists(marks, lambda m: ~F.contains(t, m))),
        ("claim_box", "error", F.col("needs_claims") & ~F.contains(t, F.lit("<보기>"))),
        ("claims", "error", F.col("needs_claims") & F.exists(claims, lambda m: ~F.contains(t, m))),
        ("fifth_choice", "error", ~blank(F.col("fifth_choice")) & ~F.contains(F.regexp_replace(t, r"\s+", ""), F.regexp_replace("fifth_choice", r"\s+", ""))),
        ("other_leader", "error", F.exists(leaders, lambda n: n.cast("int") != F.col("number"))),
    ])


def figure_placement(figures: DataFrame) -> DataFrame:
    """Where an item's figures stand: beside the stem, after the ask, between, or before.

    figures: item_id, x0, y0, x1, y1 and the stem's and ask's boxes as s_* and a_*.
    """
    per = figures.groupBy("item_id").agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")), *(F.first(c).alias(c) for c in ("s_x0", "s_y0", "s_x1", "s_y1", "a_y0", "a_y1")))
    beside = ((F.col("x0") >= F.col("s_x1")) | (F.col("x1") <= F.col("s_x0"))) & (F.least("y1", "s_y1") > F.greatest("y0", "s_y0"))
    where = F.when(beside, "side_by_side").when(F.col("y0") >= F.col("a_y1"), "after_ask").when((F.col("y0") >= F.col("s_y1")) & (F.col("y1") <= F.col("a_y0")), "between").otherwise("before")
    return per.select("item_id", where.alias("placement"))


def layout_class(panels: DataFrame) -> DataFrame:
    """One of six layouts for each item's panels (item_id, width, arrangement, scale).

    A panel is small up to SMALL_WIDTH; a horizontal pair is small if both together are at most SMALL_PAIR wide and would
    be shown at SMALL_SCALE at least, else it is promoted to large.
    """
    per = panels.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("width").alias("total"), F.max("width").alias("widest"), F.min("arrangement").alias("arrangement"), F.min("scale").alias("scale"))
    small_pair = (F.col("arrangement") == "horizontal") & (F.col("total") <= SMALL_PAIR) & (F.col("scale") >= SMALL_SCALE)
    kind = (
        F.when(F.col("n") == 1, F.when(F.col("widest") <= SMALL_WIDTH, "one_small").otherwise("one_large"))
        .when(F.col("n") == 2, F.when(small_pair, "two_small").otherwise("two_large"))
        .when(F.col("n") == 3, "three")
        .otherwise("many")
    )
    return per.select("item_id", "n", kind.alias("layout"))


def caption_for_panel(panels: DataFrame, labels: DataFrame, below: float = 28.0, above: float = 2.0) -> DataFrame:
    """For each panel the label in the band under it, or over it or to its left; nothing for an item of which a panel has none of its own.

    panels: item_id, panel_id, x0, y0, x1, y1; labels: item_id, label_id, lx, ly (centre).
    """
    both = panels.join(labels, "item_id")
    under = F.col("lx").between(F.col("x0"), F.col("x1")) & F.col("ly").between(F.col("y1") - above, F.col("y1") + below)
    over = F.col("lx").between(F.col("x0"), F.col("x1")) & F.col("ly").between(F.col("y0") - below, F.col("y0") + above)
    left = F.col("ly").between(F.col("y0"), F.col("y1")) & F.col("lx").between(F.col("x0") - below, F.col("x0") + above)
    band = F.when(under, 0).when(over | left, 1)
    off = F.abs(F.col("lx") - (F.col("x0") + F.col("x1")) / 2)
    near = both.withColumn("band", band).where("band is not null")
    best = near.groupBy("item_id", "panel_id").agg(F.min(F.struct("band", off.alias("d"), "label_id")).alias("b"))
    own = best.withColumn("users", F.count("*").over(Window.partitionBy("item_id", F.col("b.label_id"))))
    need = panels.groupBy("item_id").agg(F.count("*").alias("need"))
    whole = own.where("users = 1").groupBy("item_id").agg(F.count("*").alias("have")).join(need, "item_id").where("have = need").select("item_id")
    return own.join(whole, "item_id", "left_semi").select("item_id", "panel_id", F.col("b.label_id").alias("label_id"))


def generated_marks(words: DataFrame, tol: float = 40.0, top: float = 40.0, bottom: float = 1150.0) -> DataFrame:
    """Item numbers of a generated document: `1.` or `1` and `.` in one block, off the margins, aligned with another one of the document.

    words: doc_id, page_no, block, word_no, text, x0, y0.
    """
    w = Window.partitionBy("doc_id", "page_no", "block").orderBy("word_no")
    follow = F.lead("text").over(w)
    first = F.row_number().over(w) == 1
    t = words.withColumn("next", follow).withColumn("first", first)
    number = F.when(F.col("text").rlike(r"^[0-9]{1,2}\.$"), F.regexp_extract("text", "^([0-9]+)", 1)).when(F.col("text").rlike(r"^[0-9]{1,2}$") & (F.col("next") == "."), F.col("text"))
    m = t.where("first").withColumn("number", number.cast("int")).where(F.col("number").isNotNull() & F.col("y0").between(top, bottom)).select("doc_id", "page_no", "number", "x0", "y0")
    # Of places in the order of x, one that has another near enough has its neighbour near enough.
    places = m.select("doc_id", "page_no", "x0", "y0").distinct()
    near = Window.partitionBy("doc_id").orderBy("x0", "page_no", "y0")
    apart = F.least(F.col("x0") - F.lag("x0").over(near), F.lead("x0").over(near) - F.col("x0"))
    aligned = places.withColumn("apart", apart).where(F.col("apart") <= tol).drop("apart")
    return m.join(aligned, ["doc_id", "page_no", "x0", "y0"]).select("doc_id", "page_no", "number", "x0", "y0").distinct()


def continuation_text(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """The text of each item, which goes on over columns and pages until the next mark.

    lines: doc_id, page_no, col, y, text; marks: doc_id, page_no, col, y, number. Both stand in one ordered run of a document.
    """
    a = lines.select("doc_id", "page_no", "col", "y", F.lit(1).alias("k"), F.lit(None).cast("int").alias("number"), "text")
    b = marks.select("doc_id", "page_no", "col", "y", F.lit(0).alias("k"), F.col("number").cast("int").alias("number"), F.lit(None).cast("string").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("page_no", "col", "y", "k")
    both = a.unionByName(b).withColumn("item", F.last("number", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(w))
    own = both.where("k = 1 and item is not null")
    return own.groupBy("doc_id", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text), "\n").alias("text"))


def segment_textbook_items(words: DataFrame, tol: float = 30.0, least_height: float = 15.0, least_width: float = 10.0) -> DataFrame:
    """Item numbers of textbook pages: large number words, two on a page at least, near their column, before the answer section.

    words: doc_id, page_no, text, x0, y0, x1, y1, is_answer_head.
    """
    ends = words.where("is_answer_head").groupBy("doc_id").agg(F.min("page_no").alias("answers"))
    n = words.join(ends, "doc_id", "left").where(F.col("answers").isNull() | (F.col("page_no") < F.col("answers")))
    n = n.where(F.col("text").rlike("^[0-9]{1,2}$") & (F.col("y1") - F.col("y0") >= least_height) & (F.col("x1") - F.col("x0") >= least_width))
    n = n.withColumn("on_page", F.count("*").over(Window.partitionBy("doc_id", "page_no"))).where("on_page >= 2")
    isl = gap_islands(n, ["doc_id", "page_no"], "x0", ["y0"], tol, "col").withColumn("left", F.min("x0").over(Window.partitionBy("doc_id", "page_no", "col")))
    return isl.where(F.col("x0") - F.col("left") <= tol / 2).select("doc_id", "page_no", "col", F.col("text").cast("int").alias("number"), "x0", "y0")


def source_id(text: Column) -> Column:
    """The source id that a text holds, or null."""
    found = F.regexp_extract(text, r"\[(26023-[0-9]{4})\]", 1)
    return F.when(found != "", found)
