"""Data-quality rules. A rule is (code, level, condition); all rules of a row are one array, exploded once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.formulas import formula_lint
from lectern.functions.text import blank
from lectern.operators.bank import ORIGINS, duplicate_usage, effective_points

# Enumerations and words of the rules.
QTYPES = ("정답형", "합답형", "서술형")
ESSAY, COMBINED = "서술형", "합답형"
DIFFICULTIES = ("상", "중", "하")
NEGATIVE = "않은|아닌|틀린|옳지 않|적절하지 않"
LONG_ANSWER = 1.4
THREE_CAPTIONS = ("(가)|(나)|(다)", "A|B|C")
CLAIM_BOX, CLAIM_LETTERS, FIFTH = "<보기>", "ㄱㄴㄷ", "⑤"
WHOLE_PICTURE = "\\수능원문1대사진\\"
#: Private use, control characters but tab and line feed, and the upper half of Latin-1 but for ° ± · ×.
UNSAFE = r"[\x00-\x08\x0b-\x1f\x7f-\xaf\xb2-\xb6\xb8-\xd6\xd8-\xff]|[" + chr(0xE000) + "-" + chr(0xF8FF) + "]"
FORBIDDEN = (
    "이에 대한 설명으로 옳은 것만을 고른 것은?", "알맞은 답을 고르시오.", "모두 선택하시오.", "찾아보자.", "무엇일까요?",
    "확인해 보세요.", "위 그림을 참고하여", "주어진 정보를 바탕으로", "다음 질문에 답하시오.",
)


def check(df: DataFrame, key: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """key, code and level of every rule that a row breaks: one pass, no join."""
    issues = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, bad in rules))
    return df.select(*key, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("x")).select(*key, "x.code", "x.level")


def summarize(issues: DataFrame, key: list[str]) -> DataFrame:
    return issues.groupBy(*key).agg(F.count_if(F.col("level") == "error").alias("error_count"), F.count_if(F.col("level") == "warn").alias("warn_count")).withColumn("ok", F.col("error_count") == 0)


def longest_answer(choices: Column) -> Column:
    """Of three texts or more, the one answer's is the longest and 1.4 times the mean of the others."""
    sized = F.filter(F.transform(choices, lambda c: F.struct(F.length(F.trim(F.coalesce(c.text, F.lit("")))).alias("n"), c.is_answer.alias("a"))), lambda x: x.n > 0)
    answers, others = F.filter(sized, lambda x: x.a), F.filter(sized, lambda x: ~x.a)
    mean = F.aggregate(others, F.lit(0.0), lambda a, x: a + x.n) / F.size(others)
    size = F.try_element_at(answers, F.lit(1)).n
    return (F.size(sized) >= 3) & (F.size(answers) == 1) & (size == F.array_max(F.transform(sized, lambda x: x.n))) & (size >= mean * LONG_ANSWER)


def question_rules() -> list[tuple[str, str, Column]]:
    """Rules for a question row with nested choices (array of text, is_answer, proposition_id)."""
    c = F.col
    qtype = F.coalesce("qtype", F.lit(""))
    essay = qtype == ESSAY
    known = qtype.isin(*QTYPES)
    choices = F.coalesce("choices", F.array().cast("array<struct<text:string,is_answer:boolean,proposition_id:bigint>>"))
    answers = F.size(F.filter(choices, lambda x: x.is_answer))
    negative = F.coalesce("ask", F.lit("")).rlike(NEGATIVE)
    return [
        ("no_ask", "error", blank(c("ask"))),
        ("bad_qtype", "error", ~known),
        ("no_model_answer", "error", essay & blank(c("answer"))),
        ("too_few_choices", "error", ~essay & (F.size(choices) < 2)),
        ("no_answer", "error", ~essay & (answers == 0)),
        ("multi_answer", "warn", ~essay & (answers > 1)),
        ("choice_no_evidence", "error", ~essay & F.exists(choices, lambda x: x.proposition_id.isNull() & (F.trim(F.coalesce(x.text, F.lit(""))) == ""))),
        ("no_origin", "warn", blank(c("origin"))),
        ("bad_origin", "warn", ~blank(c("origin")) & ~F.trim("origin").isin(*ORIGINS)),
        ("bad_difficulty", "warn", ~F.coalesce("difficulty", F.lit("")).isin(*DIFFICULTIES)),
        ("bad_points", "warn", F.coalesce("default_points", F.lit(0.0)) <= 0),
        ("no_standard", "warn", blank(c("standard_code"))),
        ("negative_unmarked", "warn", negative & ~F.coalesce("is_negative", F.lit(False))),
        ("negative_mismatch", "warn", ~negative & F.coalesce("is_negative", F.lit(False))),
        ("answer_longest", "warn", (qtype != COMBINED) & longest_answer(choices)),
    ]


def style_rules(text: Column, claims: Column, mentions: Column) -> list[tuple[str, str, Column]]:
    """Rules of wording: forbidden phrases, claims against their mention, claim endings."""
    some = F.size(claims) > 0
    return [
        *((f"style_forbidden_phrase_{i}", "error", F.contains(text, F.lit(p))) for i, p in enumerate(FORBIDDEN)),
        ("bogi_reference_missing", "error", some & ~mentions),
        ("bogi_reference_orphan", "error", ~some & mentions),
        ("choice_ending", "error", F.exists(claims, lambda x: ~F.trim(x).endswith("다."))),
    ]


def cited_references(text: Column, attached: Column) -> Column:
    """Reference ids that a text cites and that aren't attached."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"\[ref:([A-Za-z0-9_-]+)\]"), 1), attached)


def completion_gate(questions: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Rows that may not be complete: status 완성 with errors."""
    return questions.where(F.col("status") == "완성").join(summary.where("error_count > 0"), key, "left_semi")


def set_rules(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Issues of sets (set_id, target): empty, points that miss the target, few standards, unreviewed drafts, blank origins.

    `items` are all items with their question's columns; one aggregate over them serves all rules.
    """
    pts = effective_points(F.col("points"), F.col("default_points"), "check")
    stats = items.groupBy("set_id").agg(
        F.count("*").alias("n"), F.sum(pts).alias("sum_points"),
        F.count_distinct(F.when(~blank(F.col("standard_code")), F.col("standard_code"))).alias("standards"),
        F.count_if((F.col("origin") == "AI초안") & (F.col("status") != "완성")).alias("drafts"),
        F.count_if(blank(F.col("origin"))).alias("no_origin"),
    )
    s = sets.join(stats, "set_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return check(s, ["set_id"], [
        ("empty_set", "error", F.col("n") == 0),
        ("points_mismatch", "warn", (F.col("n") > 0) & (F.abs(F.col("sum_points") - F.coalesce("target", F.lit(100.0))) > 0.01)),
        ("low_coverage", "warn", (F.col("n") > 0) & (F.col("standards") < F.col("n") / 2)),
        ("ai_draft_unreviewed", "error", F.col("drafts") > 0),
        ("set_no_origin", "warn", F.col("no_origin") > 0),
    ])


def answer_spread(items: DataFrame, choices: DataFrame) -> DataFrame:
    """answer_bias and answer_unused of sets: of five items or more, with as many single answers as the most choices of one.

    detail is the position and its share, the first seen of those that are alike, or the positions that no answer has.
    """
    per_q = choices.groupBy("question_id").agg(F.count("*").alias("n_choices"), F.count_if("is_answer").alias("answers"), F.min(F.when(F.col("is_answer"), F.col("ord"))).alias("ord_answer"))
    joined = items.select("set_id", "question_id", F.col("ord").alias("item_ord"), "item_id").join(per_q, "question_id", "left")
    one = F.coalesce(F.col("answers") == 1, F.lit(False))
    # A set's positions are few, so its counts of each are one small array.
    each = joined.groupBy("set_id", F.when(one, F.col("ord_answer")).alias("place")).agg(F.count("*").alias("k"), F.count_if(one).alias("single"), F.max("n_choices").alias("widest"), F.min(F.struct("item_ord", "item_id")).alias("first_at"))
    base = each.groupBy("set_id").agg(
        F.sum("k").alias("n"), F.sum("single").alias("total"), F.coalesce(F.max("widest"), F.lit(0)).alias("most"), F.collect_set("place").alias("used"),
        F.max(F.when(F.col("place").isNotNull(), F.col("k"))).alias("top"), F.min(F.when(F.col("place").isNotNull(), F.struct(-F.col("k"), "first_at", "place"))).alias("lead"),
    ).where("n >= 5 and total > 0 and most >= 2 and total >= most")
    unused = F.array_except(F.sequence(F.lit(1), F.col("most").cast("int")), F.col("used").cast("array<int>"))
    issues = F.array(
        F.when(F.col("top") / F.col("total") > 0.4, F.struct(F.lit("answer_bias").alias("code"), F.format_string("%d: %d/%d", "lead.place", "top", "total").alias("detail"))),
        F.when(F.size(unused) > 0, F.struct(F.lit("answer_unused").alias("code"), F.array_join(unused, " ").alias("detail"))),
    )
    return base.select("set_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("x")).select("set_id", "x.code", F.lit("warn").alias("level"), "x.detail")


def text_lint(text: Column, markup: Column | None = None, choices: Column | None = None, pictures: Column | None = None) -> Column:
    """The first thing wrong with an editable text, or null.

    `markup` is what the text is set with, `choices` and `pictures` are the numbers of its choices of either kind; rules
    whose column isn't given are left out, and a null counts as blank or 0.
    """
    whole = text if markup is None else F.concat_ws("\n", text, markup)
    none = F.lit(False)
    number = lambda n: F.lit(0) if n is None else F.coalesce(n, F.lit(0))
    return (
        F.when(none if markup is None else F.coalesce(markup, F.lit("")).startswith(WHOLE_PICTURE), "picture of the whole item")
        .when(blank(text), "empty text")
        .when(none if choices is None else (number(choices) != 5) & (number(pictures) != 5), "not five choices")
        .when(whole.rlike(r"\[26023-[0-9]{4}\]"), "source id")
        .when(whole.rlike(r";[0-9]+[!@#$%^&*()];"), "fraction code")
        .when(F.contains(whole, F.lit("`")), "backtick")
        .when(whole.rlike(UNSAFE), "private or control character")
        .when(F.size(formula_lint(text)) > 0, F.concat(F.lit("formula: "), F.try_element_at(formula_lint(text), F.lit(1))))
        .when(whole.rlike(r"[!?.#$%&*]{3,}"), "repeated punctuation")
        .when(whole.rlike(r"[0-9]{7,}"), "digit run")
        .when(F.contains(whole, F.lit("@")), "at sign")
    )


def contains_private_use(df: DataFrame) -> Column:
    """Some text column of the row holds a private-use character."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return F.exists(F.array(*(F.coalesce(F.col(n), F.lit("")) for n in names)), lambda x: x.rlike(f"[{chr(0xE000)}-{chr(0xF8FF)}]"))


def invariant_violations(items: DataFrame) -> DataFrame:
    """(set, question) and (set, ord) that occur more than once."""
    a = items.where("question_id is not null").groupBy("set_id", F.col("question_id").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("set_id", F.lit("question").alias("kind"), "value", "n")
    b = items.groupBy("set_id", F.col("ord").cast("long").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("set_id", F.lit("ord").alias("kind"), "value", "n")
    return a.unionByName(b)


def unique_outcomes(prepared: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """Items that are prepared and failed, or either twice."""
    return prepared.select(*key).unionByName(failed.select(*key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def wrong_owner(assets: DataFrame, owner: str, item: str) -> DataFrame:
    return assets.where(~F.col(owner).eqNullSafe(F.col(item)))


def hash_gate(files: DataFrame, recorded: DataFrame, key: str, content: str) -> DataFrame:
    """For each recorded file whether its content's digest is still the recorded one."""
    now = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("observed"))
    return recorded.join(now, key, "left").withColumn("ok", F.coalesce(F.col("observed") == F.col("recorded"), F.lit(False)))


def severity_policy(issues: DataFrame, diagnostic: list[str]) -> DataFrame:
    return issues.withColumn("severity", F.when(F.col("code").isin(*diagnostic), "diagnostic").otherwise("blocking"))


def panel_contract(panels: DataFrame) -> DataFrame:
    """Items whose panels break the contract: item_id, code, level.

    panels: item_id, owner_id, idx, asset_count, arrangement, x0, y0, x1, y1, width_px, height_px, caption, caption_y0,
    recorded and observed digest. Of an item with three panels the captions must be one of the known rows, stand below
    their pictures, and no two pictures overlap. An item's panels are one aggregate, of which only the first three
    places are kept, so that none is collected. What is null where a rule needs it breaks the rule.
    """
    c = F.col
    wide, high = c("x1") - c("x0"), c("y1") - c("y0")
    ratio = F.try_divide(F.try_divide("width_px", "height_px"), F.try_divide(wide, high))
    sure = lambda x: F.bool_and(F.coalesce(x, F.lit(False)))
    panel = F.struct("x0", "y0", "x1", "y1", F.trim(F.coalesce("caption", F.lit(""))).alias("caption"), "caption_y0")
    per = panels.groupBy("item_id").agg(
        F.count("*").alias("n"), F.count_distinct("idx").alias("indices"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.count_distinct("arrangement").alias("kinds"),
        F.min("asset_count").alias("least"), F.max("asset_count").alias("most"), F.count("asset_count").alias("stated"), sure(c("owner_id") == c("item_id")).alias("own"),
        sure((wide > 0) & (high > 0)).alias("positive"), sure(F.abs(ratio - 1) <= 0.05).alias("shaped"), sure(c("recorded") == c("observed")).alias("unchanged"),
        *(F.any_value(F.when(c("idx") == k, panel), True).alias(f"p{k}") for k in (1, 2, 3)),
    )
    p = [c(f"p{k}") for k in (1, 2, 3)]
    meet = lambda a, b, low, high: reduce(Column.__and__, [x[high] > y[low] for x in (a, b) for y in (a, b)])
    overlap = lambda a, b: meet(a, b, "x0", "x1") & meet(a, b, "y0", "y1")
    three, captions = c("n") == 3, F.concat_ws("|", *(x.caption for x in p))
    return check(per, ["item_id"], [
        ("panel_index", "error", (c("low") != 1) | (c("high") != c("n")) | (c("indices") != c("n"))),
        ("panel_assets", "error", (c("stated") != c("n")) | (c("least") != c("n")) | (c("most") != c("n"))),
        ("panel_owner", "error", ~c("own")), ("panel_arrangement", "error", c("kinds") != 1), ("panel_box", "error", ~c("positive")), ("panel_ratio", "error", ~c("shaped")),
        ("panel_digest", "error", ~c("unchanged")), ("panel_captions", "error", three & ~captions.isin(*THREE_CAPTIONS)),
        ("panel_caption_place", "error", three & ~F.coalesce((p[0].y1 <= p[0].caption_y0) & (p[1].y1 <= p[1].caption_y0) & (p[2].y1 <= p[2].caption_y0), F.lit(False))),
        ("panel_overlap", "error", three & (overlap(p[0], p[1]) | overlap(p[0], p[2]) | overlap(p[1], p[2]))),
    ])


def graphical_choice_contract(choices: DataFrame) -> DataFrame:
    """Items without exactly the five choices 1 to 5, with a choice of another item, one that is under review or one that was changed.

    choices: item_id, owner_id, ord, needs_review, reason, recorded and observed digest; detail has the distinct reasons of a
    review in their order. Nulls in owner_id, digests and ord break the rule.
    """
    c = F.col
    per = choices.groupBy("item_id").agg(
        F.count("*").alias("n"), F.count_distinct("ord").alias("places"), F.min("ord").alias("low"), F.max("ord").alias("high"), F.bool_or("needs_review").alias("review"),
        F.bool_and(F.coalesce(c("owner_id") == c("item_id"), F.lit(False))).alias("own"), F.bool_and(F.coalesce(c("recorded") == c("observed"), F.lit(False))).alias("unchanged"),
        F.collect_set(F.when(c("needs_review") & ~blank(c("reason")), c("reason"))).alias("reasons"),
    )
    ordered = (c("n") == 5) & (c("places") == 5) & (c("low") == 1) & (c("high") == 5)
    found = check(per, ["item_id", "reasons"], [
        ("choice_count", "error", c("n") != 5), ("choice_order", "error", ~F.coalesce(ordered, F.lit(False))), ("choice_owner", "error", ~c("own")),
        ("choice_review", "error", c("review")), ("choice_digest", "error", ~c("unchanged")),
    ])
    return found.select("item_id", "code", "level", F.when(c("code") == "choice_review", F.array_join(F.array_sort("reasons"), "; ")).otherwise("").alias("detail"))


def slot_count_match(slots: DataFrame, assets: DataFrame) -> DataFrame:
    """Template slots and assets (item_id, kind, idx) that have no counterpart."""
    return slots.select("item_id", "kind", "idx", F.lit(True).alias("slot")).join(assets.select("item_id", "kind", "idx", F.lit(True).alias("asset")), ["item_id", "kind", "idx"], "full_outer").where("slot is null or asset is null").select("item_id", "kind", "idx", F.when(F.col("slot").isNull(), "asset without slot").otherwise("slot without asset").alias("issue"))


def block_contract(blocks: DataFrame, required: list[str], box: bool = False, claims: bool = False, fifth: bool = False) -> DataFrame:
    """Documents whose blocks (doc_id, kind, text, page_no, expected_pages) lack something: pictures but no text, no text, required texts, pages.

    On demand also a table with the box of claims (`box`; with `claims` it must hold all three), the claims, and the fifth
    choice, in whatever block. A document without an expected number of pages may have any.
    """
    c, has = F.col, lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    letters = [F.contains(text, F.lit(x)) for x in CLAIM_LETTERS]
    boxed = (c("kind") == "table") & F.contains(F.regexp_replace(text, r"\s+", ""), F.lit(CLAIM_BOX))
    per = blocks.groupBy("doc_id").agg(
        has(c("kind") == "image").alias("images"), has((c("kind") == "text") & ~blank(text)).alias("texts"), has((boxed & letters[0] & letters[1] & letters[2]) if claims else boxed).alias("boxed"),
        *(has(x).alias(f"l{i}") for i, x in enumerate(letters)), has(F.contains(text, F.lit(FIFTH))).alias("fifth"), F.count_distinct("page_no").alias("pages"), F.max("expected_pages").alias("expected"),
        *(has(F.contains(text, F.lit(r))).alias(f"r{i}") for i, r in enumerate(required)),
    )
    return check(per, ["doc_id"], [
        ("images_only", "error", c("images") & ~c("texts")), ("no_text", "error", ~c("texts")), ("page_count", "error", c("pages") != c("expected")),
        *([("no_box", "error", ~c("boxed"))] if box else []), *([("claims_missing", "error", ~(c("l0") & c("l1") & c("l2")))] if claims else []),
        *([("fifth_choice", "error", ~c("fifth"))] if fifth else []), *((f"required_{i}", "error", ~c(f"r{i}")) for i in range(len(required))),
    ])


def set_duplicates(items: DataFrame, uses: DataFrame, first: int = 4) -> DataFrame:
    """The first groups of questions of a set that share a proposition."""
    w = Window.partitionBy("set_id").orderBy("proposition_id")
    return duplicate_usage(items, uses, lambda df: df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).drop("k"))
