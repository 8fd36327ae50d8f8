"""Rules for drafts: evidence of claims and choices, attested frames, formulas, and what becomes of issues.

A draft is one row: id, qtype, passage, ask, explanation, style_meta (JSON), claims and
choices (arrays of structs). An issue is (code, level, field, place): `place` counts claims
or choices from 1, null where the whole draft is meant. All issues of a row are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.formulas import formula_lint
from lectern.functions.text import blank
from lectern.operators.mining import ask_frame, intro_frame
from lectern.operators.quality import COMBINED, ESSAY, FORBIDDEN

CLAIM = "array<struct<text:string,evidence:string,explanation:string,proposition_id:bigint,variant_id:bigint>>"
CHOICE = "array<struct<text:string,is_answer:boolean,proposition_id:bigint,variant_id:bigint,custom_evidence:string,combo:string>>"
NONE = "array<struct<code:string,level:string,field:string,place:int>>"


def issue(code: str, field: str, level: str = "error", at: Column | None = None) -> Column:
    place = F.lit(None) if at is None else at
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(field).alias("field"), place.cast("int").alias("place"))


def when(bad: Column, *found: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(*found)).otherwise(F.array().cast(NONE))


def each(rows: Column, bad, code: str, field: str) -> Column:
    """An issue for each element of `rows` for which `bad` holds."""
    found = F.transform(rows, lambda x, i: F.when(F.coalesce(bad(x), F.lit(False)), issue(code, field, at=i + 1)))
    return F.filter(found, lambda x: x.isNotNull())


def unsupported(x: Column) -> Column:
    """A choice without proposition, variant, text of its own or combination."""
    return x.proposition_id.isNull() & x.variant_id.isNull() & blank(x.custom_evidence) & blank(x.combo)


def reconstruction(style_meta: Column) -> Column:
    """Whether a draft restores a known item, which exempts it from rules of style; malformed metadata don't."""
    flag = F.get_json_object(style_meta, "$.reconstruction.enabled")
    return F.coalesce(~flag.isin("", "false", "0", "null"), F.lit(False))


def evidence_issues() -> Column:
    """What the item check finds: ask, answers, evidence of choices, evidence and explanation of claims."""
    qtype, claims, choices = F.coalesce("qtype", F.lit("")), F.coalesce("claims", F.array().cast(CLAIM)), F.coalesce("choices", F.array().cast(CHOICE))
    answers = F.size(F.filter(choices, lambda x: F.coalesce(x.is_answer, F.lit(False))))
    closed, combined = qtype != ESSAY, qtype == COMBINED
    nothing = F.array().cast(NONE)
    return F.concat(
        when(blank(F.col("ask")), issue("no_ask", "ask")),
        when(closed & (answers == 0), issue("no_answer", "choices")),
        when(closed & (answers > 1), issue("multi_answer", "choices", "warn")),
        F.when(closed, each(choices, unsupported, "choice_no_evidence", "choices")).otherwise(nothing),
        F.when(combined, each(claims, lambda x: x.proposition_id.isNull() & x.variant_id.isNull() & blank(x.evidence), "bogi_no_evidence", "claims")).otherwise(nothing),
        F.when(combined, each(claims, lambda x: blank(x.explanation), "bogi_no_explanation", "claims")).otherwise(nothing),
    )


def formula_issues(field: str, allowed: list[str]) -> Column:
    """An issue for each message about the formulas of a field."""
    return F.transform(formula_lint(F.coalesce(field, F.lit("")), allowed), lambda _: issue("formula_invalid", field))


def style_issues(allowed: list[str], wrapped: bool = False) -> Column:
    """What the rules of style find; restored items are exempt from all but the ask's and the formulas'. Frames of `wrapped` texts may go over line ends."""
    qtype, claims, choices = F.coalesce("qtype", F.lit("정답형")), F.coalesce("claims", F.array().cast(CLAIM)), F.coalesce("choices", F.array().cast(CHOICE))
    passage, ask = F.coalesce("passage", F.lit("")), F.coalesce("ask", F.lit(""))
    free, combined, some = ~reconstruction(F.col("style_meta")), qtype == COMBINED, F.size(claims) > 0
    mentions = F.contains(F.replace(ask, F.lit("〈보기〉"), F.lit("<보기>")), F.lit("<보기>"))
    wording = F.concat_ws("\n", passage, ask, F.transform(claims, lambda x: F.coalesce(x.text, F.lit(""))))
    cited = F.when(combined, each(claims, lambda x: blank(x.evidence), "evidence_missing", "claims")).otherwise(
        each(choices, lambda x: x.proposition_id.isNull() & x.variant_id.isNull() & blank(x.custom_evidence), "evidence_missing", "choices")
    )
    ends = each(claims, lambda x: (F.coalesce(x.text, F.lit("")) != "") & ~x.text.endswith("다."), "choice_ending", "claims")
    nothing = F.array().cast(NONE)
    formulas = [formula_issues(c, allowed) for c in ("passage", "ask", "explanation")]
    return F.concat(
        when(blank(F.col("ask")), issue("no_ask", "ask")),
        when(free & ~blank(passage) & intro_frame(passage, wrapped).isNull(), issue("style_frame_unattested", "passage")),
        when(free & (qtype != ESSAY) & ~blank(ask) & ask_frame(ask, qtype, wrapped).isNull(), issue("style_frame_unattested", "ask")),
        *(when(free & F.contains(wording, F.lit(p)), issue("style_forbidden_phrase", "")) for p in FORBIDDEN),
        when(free & combined & some & ~mentions, issue("bogi_reference_missing", "ask")),
        when(free & ~some & mentions, issue("bogi_reference_orphan", "ask")),
        F.when(free & combined, ends).otherwise(nothing),
        F.when(free, cited).otherwise(nothing),
        *formulas,
    )


def cited_ids(evidence: Column) -> Column:
    """The ids that evidence cites, as `reference_id=3` or `[ref:3`, without leading zeros."""
    # How evidence names a reference.
    found = F.regexp_extract_all(F.coalesce(evidence, F.lit("")), F.lit(r"(?:reference_id\s*=|\[ref:)([0-9]+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))


def reference_issues(attached: Column) -> Column:
    """Claims, or without claims' evidence choices, that cite no reference, or one that isn't among the `attached` ids."""
    claims, choices = F.coalesce("claims", F.array().cast(CLAIM)), F.coalesce("choices", F.array().cast(CHOICE))
    known = F.transform(F.coalesce(attached, F.array().cast("array<bigint>")), lambda x: x.cast("string"))

    def of(rows: Column, evidence: str, field: str) -> Column:
        found = F.transform(rows, lambda x, i: F.struct((i + 1).alias("at"), cited_ids(x[evidence]).alias("ids")))
        missing = F.transform(F.filter(found, lambda x: F.size(x.ids) == 0), lambda x: issue("evidence_reference_id_missing", field, at=x["at"]))
        unknown = F.filter(found, lambda x: F.size(F.array_except(x.ids, known)) > 0)
        return F.concat(missing, F.transform(unknown, lambda x: issue("evidence_reference_unknown", field, at=x["at"])))

    return F.when(F.coalesce(F.col("qtype") == COMBINED, F.lit(False)), of(claims, "evidence", "claims")).otherwise(of(choices, "custom_evidence", "choices"))


def draft_check(drafts: DataFrame, allowed: list[str], key: str = "id", attached: str | None = None, wrapped: bool = False) -> DataFrame:
    """All issues of drafts, one row each; style issues whose code the item check has raised already are left out. One pass, no join.

    With `attached`, a column with the ids of a draft's references, evidence must cite these. Texts that are `wrapped`
    may have frames that go over line ends.
    """
    cited = F.array().cast(NONE) if attached is None else reference_issues(F.col(attached))
    two = drafts.select(key, evidence_issues().alias("first"), style_issues(allowed, wrapped).alias("then"), cited.alias("cited"))
    codes = F.transform("first", lambda x: x.code)
    found = F.concat("first", F.filter("then", lambda x: ~F.array_contains(codes, x.code)), "cited")
    return two.select(key, F.explode(found).alias("x")).select(key, "x.*")


def numbered_items(items: DataFrame) -> DataFrame:
    """Items with `number`, their place in the set from 1."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy("set_id").orderBy("ord", "item_id")))


def propagated(items: DataFrame, issues: DataFrame) -> DataFrame:
    """The issues (id, code, level) of each set's questions, with the item's number in the set."""
    return numbered_items(items).select("set_id", "number", F.col("question_id").alias("id")).join(issues, "id").select("set_id", "number", "id", "code", "level")


def flagged_numbers(items: DataFrame, first: int = 10) -> DataFrame:
    """For each set, which items are unreviewed drafts (all their numbers) and which have no origin (the first ones): numbers joined by commas."""
    n = numbered_items(items)
    draft = (F.trim(F.coalesce("origin", F.lit(""))) == "AI초안") & (F.coalesce("status", F.lit("")) != "완성")
    lists = n.groupBy("set_id").agg(
        F.array_sort(F.collect_list(F.when(draft, F.col("number")))).alias("drafts"), F.array_sort(F.collect_list(F.when(blank(F.col("origin")), F.col("number")))).alias("blank")
    )
    joined = lambda c: F.array_join(c.cast("array<string>"), ", ")
    return lists.select(
        "set_id", F.size("drafts").alias("n_drafts"), joined(F.col("drafts")).alias("drafts"), F.size("blank").alias("n_blank"),
        F.concat(joined(F.slice("blank", 1, first)), F.when(F.size("blank") > first, " 외").otherwise("")).alias("blank"),
    )


def choice_text(combo: Column, text: Column) -> Column:
    """A combination, given as a JSON array or joined by commas, as `ㄱ, ㄷ`; else the text; else `-`."""
    listed = F.from_json(combo, "array<string>")
    parts = F.filter(F.transform(F.split(combo, ","), lambda x: F.trim(x)), lambda x: x != "")
    marks = F.when(blank(combo), F.array().cast("array<string>")).when(F.trim(combo).startswith("["), F.coalesce(listed, parts)).otherwise(parts)
    return F.when(F.size(marks) > 0, F.array_join(marks, ", ")).when(F.coalesce(text, F.lit("")) != "", text).otherwise("-")


def split_stem_claims(text: Column) -> Column:
    """qtype, ask, points (3 if not given) and the three claims behind the box's mark: text up to the question mark and what stands before the box."""
    score = F.regexp_extract(text, r"\[(\d+)점\]", 1)
    plain = F.trim(F.regexp_replace(text, r"\s*\[\d+점\]\s*", " "))
    box = r"<`?보\s*기`?>"
    body = rf"(?s)^([^?]*)\?(?:(.*?))({box}\s*ㄱ\.\s*(.*?)\s+ㄴ\.\s*(.*?)\s+ㄷ\.\s*(.*?)\s*)$"
    inside = rf"(?s)^([^?]*{box}[^?]*)\?\s*ㄱ\.\s*(.*?)\s+ㄴ\.\s*(.*?)\s+ㄷ\.\s*(.*?)\s*$"
    parts = lambda pattern, places: F.array(*(F.regexp_extract(plain, pattern, k) for k in places))
    head = F.concat(F.trim(F.regexp_extract(plain, r"(?s)^([^?]*)\?", 1)), F.lit("?"))
    suffix = F.trim(F.regexp_extract(plain, body, 2))
    claims = F.when(plain.rlike(body), parts(body, (4, 5, 6))).when(plain.rlike(inside), parts(inside, (2, 3, 4)))
    ask = F.when(claims.isNull(), plain).otherwise(F.concat(head, F.when(suffix != "", F.concat(F.lit(" "), suffix)).otherwise("")))
    return F.struct(
        F.when(claims.isNull(), "정답형").otherwise("합답형").alias("qtype"), ask.alias("ask"),
        F.when(score == "", 3).otherwise(score.cast("int")).alias("points"), F.coalesce(claims, F.array().cast("array<string>")).alias("claims"),
    )


def warnings_of(items: DataFrame, job: str = "job_id") -> DataFrame:
    """For each job one text for each item (number, ord, unplaced: array) with materials that have no place, in order."""
    some = items.where(F.size("unplaced") > 0)
    told = F.concat(F.coalesce("number", "ord").cast("string"), F.lit("번 문항에 미배치 자료가 "), F.size("unplaced").cast("string"), F.lit("개 있습니다."))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", told.alias("t")))), lambda x: x.t)
    return some.groupBy(job).agg(texts.alias("warnings"))


def compatible_types(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests (domain, type_id, ...) with `known` (the type is in some domain), `compatible` (in the one asked for) and the label of the first domain that has it.

    `catalog` is nested: domain, label and types, an array of type ids.
    """
    flat = catalog.select("domain", "label", F.explode("types").alias("type_id"))
    known = flat.groupBy("type_id").agg(F.min(F.struct("domain", "label")).alias("home"))
    own = flat.select("domain", "type_id", F.lit(True).alias("own")).distinct()
    met = requests.join(known, "type_id", "left").join(own, ["domain", "type_id"], "left")
    return met.select(*requests.columns, F.col("home").isNotNull().alias("known"), F.coalesce("own", F.lit(False)).alias("compatible"), F.col("home.label").alias("label"))
