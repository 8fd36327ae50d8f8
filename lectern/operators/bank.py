"""Item-bank queries: filters, joins, counts, reports and changes given as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.text import blank, circled, num_text
from lectern.scratch import bucketed, forget, written

# Ordered enumerations of the item bank.
STATUS_RANK = {"초안": 0, "검토중": 1, "완성": 2}
DIFFICULTY_RANK = {"하": 0, "중": 1, "상": 2}
BEHAVIORS = ("지식·이해", "과정·기능", "가치·태도")
ORIGINS = ("직접", "AI초안", "기출변형", "기출복원")
UNSPECIFIED = "미지정"


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), list(ranks.items())[1:], F.when(value == next(iter(ranks)), next(iter(ranks.values())))).otherwise(-1)


def like_any(cols: list[Column], needle: str) -> Column:
    """Some column holds the needle, whatever its case; wildcards in it are plain characters."""
    plain = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, (F.coalesce(c.cast("string").ilike(f"%{plain}%"), F.lit(False)) for c in cols))


def search_any(df: DataFrame, needle: str, cols: list[str]) -> DataFrame:
    return df.where(like_any([F.col(c) for c in cols], needle))


def filter_propositions(df: DataFrame, standard: str | None = None, unit: int | None = None, needle: str | None = None) -> DataFrame:
    """Propositions by standard, unit and text, newest first."""
    if standard is not None:
        df = df.where(F.col("standard_code") == standard)
    if unit is not None:
        df = df.where(F.col("unit_no") == unit)
    if needle:
        df = df.where(like_any([F.col("text")], needle))
    return df.orderBy(F.desc("id"))


def list_standards(standards: DataFrame, units: DataFrame, unit: int | None = None, needle: str | None = None) -> DataFrame:
    if unit is not None:
        standards = standards.where(F.col("unit_no") == unit)
    if needle:
        standards = standards.where(like_any([F.col("code"), F.col("text")], needle))
    return standards.join(units.select("unit_no", F.col("name").alias("unit_name")), "unit_no", "left").orderBy("unit_no", "seq")


def tree_filter(units: DataFrame, standards: DataFrame, needle: str) -> DataFrame:
    """Units whose name matches with all their standards, others with the standards that match; units left with none go."""
    n = F.lit(needle.lower())
    hit = F.contains(F.lower("name"), n)
    own = F.contains(F.lower("code"), n) | F.contains(F.lower("text"), n)
    both = standards.join(units.select("unit_no", "name"), "unit_no").where(hit | own)
    return both.groupBy("unit_no", "name").agg(F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("standards"))


def scope_filter(rows: DataFrame, codes: DataFrame, code: str = "standard_code", without_code: bool = True, empty_is_all: bool = True) -> DataFrame:
    """Rows within the scope's codes (column code); rows without a code pass if `without_code`; an empty scope is everything."""
    if empty_is_all and codes.isEmpty():
        return rows
    inside = rows.join(codes.select(F.col("code").alias(code)).distinct(), code, "left_semi")
    return inside.unionByName(rows.where(blank(F.col(code)))) if without_code else inside


def hidden_by_scope(rows: DataFrame, codes: DataFrame, code: str = "standard_code") -> DataFrame:
    """How many rows the scope removes."""
    return rows.where(~blank(F.col(code))).join(codes.select(F.col("code").alias(code)).distinct(), code, "left_anti").agg(F.count("*").alias("hidden"))


def effective_points(points: Column, default: Column, mode: str = "report") -> Column:
    """A set's own points or the question's: `report` rounds each to one decimal, `dashboard` doesn't, `check` takes 0 for unset."""
    if mode == "check":
        return F.when((points.isNotNull()) & (points != 0), points).otherwise(F.coalesce(default, F.lit(0.0)))
    value = F.coalesce(points, default, F.lit(0.0))
    return F.bround(value, 1) if mode == "report" else value


def auto_title(cols: list[Column], fallback: Column, lead_ins: list[str], size: int = 28) -> Column:
    """The first text that is left when lead-ins are stripped, cut to size."""
    def usable(c: Column) -> Column:
        t = reduce(lambda x, p: F.regexp_replace(x, p, ""), lead_ins, F.trim(F.coalesce(c, F.lit(""))))
        return F.when(F.trim(t) != "", F.substring(F.trim(t), 1, size))

    return F.coalesce(*(usable(c) for c in cols), fallback)


def figure_name(short_code: Column, ord_col: Column, needs: Column) -> Column:
    """`code_07` where a code is set and a figure needed."""
    return F.when(needs & ~blank(short_code), F.format_string("%s_%02d", short_code, ord_col))


def reject_object_literal(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Violations: fields that hold the text of a script object."""
    bad = F.filter(F.array(*(F.when(F.lower(F.trim(c)) == "[object object]", F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    return df.select(key, F.explode(bad).alias("field"))


def unwrap_text_envelope(df: DataFrame, col: str, meta: str) -> DataFrame:
    """`{"text": ..}` objects in a text column become their text, without one the empty text, and so does `[object Object]`; `changed` says where.

    An object's frame_id goes to the JSON object in `meta`, under the column's name and with the sources of its style
    (style_sources, else sources, else none); what else is there stays, and what isn't an object is replaced.
    """
    c = F.col(col)
    map_type = "map<string,variant>"
    inner = F.when(F.trim(c).startswith("{"), F.from_json(c, map_type))
    wrapped = F.coalesce(F.map_contains_key(inner, "text") | F.map_contains_key(inner, "frame_id"), F.lit(False))
    broken = F.coalesce(F.lower(F.trim(c)) == "[object object]", F.lit(False))
    text = lambda name: F.nullif(F.get_json_object(c, f"$.{name}"), F.lit(""))
    filled = lambda name: F.nullif(text(name), F.lit("[]"))
    frame = text("frame_id")
    sources = F.try_parse_json(F.coalesce(filled("style_sources"), filled("sources"), F.lit("[]")))
    entry = F.to_variant_object(F.struct(frame.alias("frame_id"), sources.alias("sources")))
    held = F.coalesce(F.when(F.trim(F.col(meta)).startswith("{"), F.from_json(meta, map_type)), F.create_map().cast(map_type))
    merged = F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != col), F.create_map(F.lit(col), entry)))
    return df.withColumns({"changed": wrapped | broken, meta: F.when(wrapped & frame.isNotNull(), merged).otherwise(F.col(meta)), col: F.when(wrapped, F.coalesce(F.get_json_object(c, "$.text"), F.lit(""))).when(broken, "").otherwise(c)})


def set_items(items: DataFrame, questions: DataFrame, choices: DataFrame) -> DataFrame:
    """Items with their question and choices in order; empty slots vanish. Choices are grouped once for all questions."""
    nested = choices.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", "choice_id", "text", "is_answer", "proposition_id"))).alias("choices"))
    q = questions.select(F.col("id").alias("question_id"), *[c for c in questions.columns if c not in ("id", "ord", "points")])
    return items.join(q, "question_id").join(nested, "question_id", "left")


def blueprint_slots(items: DataFrame, questions: DataFrame) -> DataFrame:
    """All slots, also empty ones, with their question's title."""
    return items.join(questions.select(F.col("id").alias("question_id"), "title", "qtype", "difficulty"), "question_id", "left")


def pickable_questions(questions: DataFrame, items: DataFrame, set_id: int) -> DataFrame:
    used = items.where((F.col("set_id") == set_id) & F.col("question_id").isNotNull()).select(F.col("question_id").alias("id"))
    return questions.join(used, "id", "left_anti")


def questions_with_choices(questions: DataFrame, choices: DataFrame) -> DataFrame:
    """Questions with the number of their choices and the text of those in order."""
    c = choices.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("n_choices"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "choice_id", "text"))), lambda x: x.text), "|").alias("choice_texts"))
    return questions.join(c, "id", "left").withColumn("n_choices", F.coalesce("n_choices", F.lit(0)))


def proposition_detail(props: DataFrame, units: DataFrame, standards: DataFrame, variants: DataFrame, evidence: DataFrame) -> DataFrame:
    """Propositions with unit and standard, and nested variants and evidence."""
    v = variants.groupBy("proposition_id").agg(F.array_sort(F.collect_list("variant_id")).alias("variants"))
    e = evidence.groupBy("proposition_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence"))
    p = props.withColumnRenamed("id", "proposition_id").join(units.select("unit_no", F.col("name").alias("unit_name")), "unit_no", "left")
    if standards is not None:
        p = p.join(standards.select(F.col("code").alias("standard_code"), F.col("text").alias("standard_text")), "standard_code", "left")
    return p.join(v, "proposition_id", "left").join(e, "proposition_id", "left")


def child_counts(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """For each parent the number of rows in each child table that has its key; 0 where there are none."""
    for name, child in children.items():
        parent = parent.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent


def set_dashboard(items: DataFrame) -> DataFrame:
    """For each set (items with question columns): points, difficulties, standards, count, target and gap."""
    pts = effective_points(F.col("points"), F.col("default_points"), "dashboard")
    known = F.col("difficulty").isin(*DIFFICULTY_RANK)
    out = items.groupBy("set_id").agg(
        F.bround(F.sum(pts), 1).alias("total_points"),
        *(F.count_if(F.col("difficulty") == d).alias(n) for d, n in (("상", "n_high"), ("중", "n_middle"), ("하", "n_low"))),
        F.count_if(~known).alias("n_other"),
        F.array_join(F.sort_array(F.collect_set(F.when(~blank(F.col("standard_code")), F.col("standard_code")))), ",").alias("standards"),
        F.count("*").alias("n_items"), F.max("target").alias("target"),
    )
    return out.withColumn("gap", F.bround(F.col("target") - F.col("total_points"), 1))


def status_cards(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(F.coalesce(status, F.lit("초안")).alias("status")).agg(F.count("*").alias("n"))


def spec_summary(items: DataFrame) -> DataFrame:
    """For each set the distributions of difficulty, behavior and origin, with what is none of the known values apart."""
    d = F.when(blank(F.col("difficulty")), "중").otherwise(F.col("difficulty"))
    b, o = F.coalesce("behavior", F.lit("")), F.trim(F.coalesce("origin", F.lit("")))
    return items.groupBy("set_id").agg(
        F.count("*").alias("n_items"),
        *(F.count_if(d == v).alias(f"difficulty_{i}") for i, v in enumerate(("상", "중", "하"))),
        *(F.count_if(b == v).alias(f"behavior_{i}") for i, v in enumerate(BEHAVIORS)), F.count_if(~b.isin(*BEHAVIORS)).alias("behavior_none"),
        *(F.count_if(o == v).alias(f"origin_{i}") for i, v in enumerate(ORIGINS)), F.count_if(~o.isin(*ORIGINS)).alias("origin_none"),
        F.sum(effective_points(F.col("points"), F.col("default_points"))).alias("total_points"),
    )


def planned_totals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("set_id").agg(F.count("*").alias("slots"), F.count_if(F.col("question_id").isNull()).alias("empty_slots"), F.count_if("needs_figure").alias("pending_figures"), F.sum(F.coalesce("points", F.lit(0.0))).alias("planned_points"))


def answer_position_counts(choices: DataFrame, items: DataFrame) -> DataFrame:
    """For each set the number of questions whose one answer stands at each place."""
    one = choices.where("is_answer").groupBy("question_id").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n = 1")
    return items.select("set_id", "question_id").join(one, "question_id").groupBy("set_id", "ord").agg(F.count("*").alias("n"))


#: Propositions in a row that travels, items of a set that one task takes at a time, and rows of the join that a slice has for each item.
CHUNK, TOGETHER, EACH = 256, 1000, 4
#: Rows of the join that are always one slice.
LEAST = 20_000_000


def several(kinds: list[T.StructField]):
    """For `mapInArrow`, over rows (set_id, part, question_id, propositions) in the order of set and part: what more than one question of a set has.

    What is held is a batch and the rows of one set's part.
    """
    names = ["set_id", "proposition_id", "n", "questions"]

    def found(rows: pa.Table) -> pa.RecordBatch:
        sizes = pc.list_value_length(rows["propositions"]).to_numpy().astype(np.int64)
        values = pa.chunked_array([c.flatten() for c in rows["propositions"].chunks]).combine_chunks()
        coded = values.dictionary_encode()
        row = np.repeat(np.arange(len(sizes)), sizes)
        key = starts(rows).cumsum()[row] * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
        order = np.argsort(key)
        cuts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(order)])
        n = np.diff(np.append(cuts, len(order)))
        first, n = cuts[n > 1], n[n > 1]
        taken = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        questions = pa.ListArray.from_arrays(offsets, rows["question_id"].combine_chunks().take(pa.array(row[taken])))
        return pa.RecordBatch.from_arrays([rows["set_id"].combine_chunks().take(pa.array(row[order[first]])), values.take(pa.array(order[first])), pa.array(n.astype(np.int64)), questions], names=names)

    def starts(rows: pa.Table) -> np.ndarray:
        """Where another set or part begins."""
        sets = rows["set_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        parts = rows["part"].to_numpy()
        return np.append(True, (np.diff(sets) != 0) | (np.diff(parts) != 0))[: len(sets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last row that is held tells whether the batch begins with another set.
            tail = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            begins = np.flatnonzero(starts(pa.Table.from_batches([*tail, batch])))
            begins = begins[begins > 0] - 1 if tail else begins[1:]
            if len(begins):
                yield found(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]))
                held, batch = [], batch.slice(begins[-1])
            held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held))

    s, q, p = (k.dataType for k in kinds)
    return run, T.StructType([T.StructField("set_id", s), T.StructField("proposition_id", p), T.StructField("n", T.LongType()), T.StructField("questions", T.ArrayType(q))])


def duplicate_usage(items: DataFrame, uses: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Propositions (uses: question_id, proposition_id) that more than one question of a set has, each question counted once.

    A question's propositions travel to its sets as arrays, for one slice of the sets after the other: as many slices as
    make each about as large as the items, and what a slice has shuffled is deleted with its end. Sets of over TOGETHER
    items are split by proposition. `then` is applied to the result of each slice, which has its sets whole.
    """
    own = uses.where("proposition_id is not null").select("question_id", "proposition_id").repartition("question_id").distinct()
    lists = own.groupBy("question_id").agg(F.collect_list("proposition_id").alias("all"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CHUNK).cast("int")), lambda i: F.slice("all", i * CHUNK + 1, CHUNK))
    lists = bucketed(lists.select("question_id", F.explode(chunks).alias("propositions")), "propositions", "question_id")
    wanted = items.select("set_id", "question_id")
    sizes = lists.groupBy("question_id").agg(F.sum(F.size("propositions")).alias("size"))
    rows, all_rows = wanted.groupBy("question_id").agg(F.count("*").alias("n")).join(sizes, "question_id", "left").agg(F.sum("n"), F.sum(F.col("n") * F.coalesce("size", F.lit(0)))).first()
    slices = max(1, -(-(all_rows or 0) // max(EACH * (rows or 0), LEAST)))
    large = written(wanted.groupBy("set_id").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).where("parts > 1"), "large-sets")
    part = lambda x: F.pmod(F.xxhash64(x), F.col("parts"))
    run, schema = several([items.schema["set_id"], items.schema["question_id"], uses.schema["proposition_id"]])

    def of(i: int) -> DataFrame:
        some = wanted.where(F.pmod(F.xxhash64("set_id"), F.lit(slices)) == i).repartition("question_id").distinct()
        met = some.join(lists, "question_id").join(large, "set_id", "left")
        parts = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform("propositions", part)))
        split = met.withColumn("part", F.explode(parts)).withColumn("propositions", F.when(F.col("parts").isNull(), F.col("propositions")).otherwise(F.filter("propositions", lambda x: part(x) == F.col("part"))))
        ordered = split.select("set_id", "part", "question_id", "propositions").repartition("set_id", "part").sortWithinPartitions("set_id", "part")
        return ordered.mapInArrow(run, schema).withColumn("questions", F.array_join(F.array_sort("questions"), ","))

    made = [written(then(of(i)), "duplicates") for i in range(slices)]
    forget(lists, large)
    return reduce(DataFrame.unionByName, made)


def standards_tree(units: DataFrame, standards: DataFrame) -> DataFrame:
    nested = standards.groupBy("unit_no").agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("standards"))
    return units.join(nested, "unit_no", "left").orderBy("unit_no")


def subject_counts(subjects: DataFrame, units: DataFrame, standards: DataFrame) -> DataFrame:
    return child_counts(subjects, "subject_id", {"n_units": units, "n_standards": standards})


def sort_questions(df: DataFrame, key: str = "created", direction: str = "desc") -> DataFrame:
    """Questions by one of ten keys, ties by id in the same direction; an unknown key is `created`."""
    keys = {
        "created": F.coalesce("created_at", F.lit("")), "updated": F.coalesce("updated_at", "created_at", F.lit("")),
        "status": rank_of(F.col("status"), STATUS_RANK), "difficulty": rank_of(F.col("difficulty"), DIFFICULTY_RANK),
        "review": F.coalesce("error_count", F.lit(0)) * 100 + F.coalesce("warn_count", F.lit(0)), "usage": F.coalesce("usage_count", F.lit(0)),
        "standard": F.coalesce("standard_code", F.lit("")), "qtype": F.coalesce("qtype", F.lit("")), "origin": F.coalesce("origin", F.lit("")), "points": F.coalesce("default_points", F.lit(0.0)),
    }
    col = keys.get(key, keys["created"])
    return df.orderBy(col.asc(), F.col("id").asc()) if direction.lower() == "asc" else df.orderBy(col.desc(), F.col("id").desc())


def answer_text(saved: Column, ords: Column) -> Column:
    """The saved answer, or the places of the marked choices."""
    return F.when(~blank(saved), F.trim(saved)).otherwise(F.coalesce(circled(ords), F.lit("")))


def answer_key(items: DataFrame) -> DataFrame:
    """Rows of an answer key: number, question, answer, points, qtype, difficulty (items as from `set_items`)."""
    w = Window.partitionBy("set_id").orderBy("ord", "item_id")
    ords = F.transform(F.filter("choices", lambda c: c.is_answer), lambda c: c.ord)
    return items.select(
        "set_id", F.row_number().over(w).alias("no"), "question_id", answer_text(F.col("answer"), ords).alias("answer"),
        num_text(effective_points(F.col("points"), F.col("default_points"))).alias("points"), "qtype", "difficulty",
    )


def spec_table(items: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of the two-way specification table: number, unit, standard, behavior, difficulty, points, qtype, origin."""
    w = Window.partitionBy("set_id").orderBy("ord", "item_id")
    numbered = items.withColumn("no", F.row_number().over(w)).join(units.select(F.col("code").alias("standard_code"), "unit_name"), "standard_code", "left")
    return numbered.select("set_id", "no", F.coalesce("unit_name", F.lit("")).alias("unit_name"), "standard_code", F.coalesce("behavior", F.lit("")).alias("behavior"), "difficulty", num_text(effective_points(F.col("points"), F.col("default_points"))).alias("points"), "qtype", F.coalesce("origin", F.lit("")).alias("origin"))


def permutation_check(current: DataFrame, requested: DataFrame) -> DataFrame:
    """Ids (set_id, id) whose number of occurrences differs between the two lists; none if one is a permutation of the other."""
    a = current.groupBy("set_id", "id").agg(F.count("*").alias("have"))
    b = requested.groupBy("set_id", "id").agg(F.count("*").alias("asked"))
    both = a.join(b, ["set_id", "id"], "full_outer").select("set_id", "id", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("asked", F.lit(0)).alias("asked"))
    return both.where((F.col("have") != F.col("asked")) | (F.col("asked") > 1))


def reorder(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Items with ord from their place in the list (set_id, ids) of their set."""
    placed = lists.select("set_id", F.posexplode("ids").alias("at", "id"))
    return items.drop("ord").join(placed.select("set_id", "id", (F.col("at") + 1).alias("ord")), ["set_id", "id"])


def duplicate_missing(selected: DataFrame, detected: DataFrame) -> DataFrame:
    """Issues of selected numbers: detected more than once, or not at all."""
    n = detected.groupBy("number").agg(F.count("*").alias("n"))
    found = selected.distinct().join(n, "number", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.where("n <> 1").select("number", F.when(F.col("n") == 0, "missing").otherwise("duplicate").alias("kind"), "n")


def expected_exact_set(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Names that only one side has."""
    return expected.exceptAll(observed).select("name", F.lit("missing").alias("issue")).unionByName(observed.exceptAll(expected).select("name", F.lit("unexpected").alias("issue")))


def ordered_distinct(df: DataFrame, part: list[str], value: str, order: str) -> DataFrame:
    """Distinct values in the order of their first place."""
    return df.groupBy(*part, value).agg(F.min(order).alias("first_at"))


def row_diff(expected: DataFrame, observed: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Keys whose fields differ, or that one side lacks."""
    a = expected.select(*key, F.struct(*cols).alias("a"))
    b = observed.select(*key, F.struct(*cols).alias("b"))
    both = a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def merge_failures(base: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    return base.unionByName(extra).dropDuplicates(key).orderBy(*key)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace all current ones of the same key."""
    return current.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def seed_merge(target: DataFrame, seed: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Update on equal keys (also to null), insert new ones, delete none."""
    s = seed.select(*key, *(F.col(c).alias(f"__{c}") for c in cols), F.lit(True).alias("__seeded"))
    return target.join(s, key, "full_outer").select(*key, *(F.when(F.col("__seeded"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in cols))


def exam_ref_upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Insert unless the key exists (nulls are equal); an existing row gets a note that isn't blank."""
    a, b = current.alias("a"), incoming.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key))
    there = lambda k: F.when(F.col("a.__in"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k)
    both = a.withColumn("__in", F.lit(True)).alias("a").join(b, on, "full_outer")
    return both.select(*(there(k) for k in key), F.coalesce(F.nullif(F.trim(F.col("b.note")), F.lit("")), F.col("a.note"), F.lit("")).alias("note"))


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Parents and children without those of the deleted keys."""
    keys = gone.select(key).distinct()
    return {"parent": parents.join(keys, key, "left_anti")} | {n: c.join(keys, key, "left_anti") for n, c in children.items()}


def change_status(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """A confirmed row whose text changed goes back to drafting, with the changed fields as flags."""
    a = after.select(key, *(F.col(c).alias(f"__{c}") for c in cols))
    both = before.join(a, key)
    flags = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    out = both.withColumn("flags", flags)
    return out.select(key, F.when((F.size("flags") > 0) & (F.col("status") == "완성"), "초안").otherwise(F.col("status")).alias("status"), F.array_join("flags", ",").alias("flags"))


def apply_proposals(drafts: DataFrame, proposals: DataFrame, allowed: dict[str, Column], key: str = "draft_id") -> DataFrame:
    """Drafts with, for each allowed field, the value of its last valid proposal (columns key, seq, field, value).

    `allowed` says for each field when a proposed value (column value) is valid; other proposals are skipped.
    """
    ok = reduce(lambda a, b: a | b, ((F.col("field") == f) & cond for f, cond in allowed.items()))
    last = proposals.where(F.coalesce(ok, F.lit(False))).groupBy(key).pivot("field", list(allowed)).agg(F.max_by("value", "seq"))
    named = last.select(key, *(F.col(f"`{f}`").alias(f"__{f}") for f in allowed))
    joined = drafts.join(named, key, "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}").cast(drafts.schema[c].dataType), F.col(c)).alias(c) if c in allowed else F.col(c) for c in drafts.columns))


def attach_to_slot(slots: DataFrame, requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Requests (set_id, ord, question_id) with what became of them: only an empty slot takes an existing question."""
    r = requests.join(slots.select("set_id", "ord", F.col("question_id").alias("taken"), F.lit(True).alias("slot")), ["set_id", "ord"], "left")
    r = r.join(questions.select(F.col("id").alias("question_id"), F.lit(True).alias("known")), "question_id", "left")
    return r.select("set_id", "ord", "question_id", F.when(F.col("slot").isNull(), "no_slot").when(F.col("taken").isNotNull(), "slot_taken").when(F.col("known").isNull(), "no_question").otherwise("accepted").alias("outcome"))


def group_concat_text(children: DataFrame, key: str, order: str, text: str) -> DataFrame:
    return children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("texts"))


def to_tsv(df: DataFrame) -> DataFrame:
    """One column `line`: cells with tabs and line ends made blanks, tabs between."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ") for c in df.columns]
    return df.select(F.concat_ws("\t", *cells).alias("line"))
