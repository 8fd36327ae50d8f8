"""Column functions over texts. All are built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), 1)


def query_terms(query: str) -> list[str]:
    """The terms of a query: everything but letters and digits separates them."""
    import re

    return [t for t in re.split(r"[\W_]+", query) if t]


def squeezed(text: Column) -> Column:
    """Lower case without white space, for substring matches across line breaks."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def occurrences(text: Column, phrase: Column) -> Column:
    """How often `phrase` occurs in `text`, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def first_match(rules: list[tuple[str, Column]], other: str | None) -> Column:
    """The label of the first rule that holds."""
    chain = reduce(lambda c, r: F.when(r[1], F.lit(r[0])) if c is None else c.when(r[1], F.lit(r[0])), rules, None)
    return chain.otherwise(F.lit(other))


def num_text(points: Column) -> Column:
    """`3.0` as `3`, `2.5` as it is."""
    return F.when(points == F.floor(points), points.cast("long").cast("string")).otherwise(points.cast("string"))


def circled(ords: Column) -> Column:
    """Answer positions in order, as circled digits from 1 to 5 and plain numbers beyond."""
    marks = F.array(*map(F.lit, "①②③④⑤"))
    return F.array_join(F.transform(F.array_sort(ords), lambda n: F.when(n.between(1, 5), F.try_element_at(marks, n.cast("int"))).otherwise(n.cast("string"))), " ")


def strip_number(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[0-9]{1,2}\s*\.\s*", "")


def strip_score(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s*[\[(]\s*[0-9]+(\.[0-9]+)?점\s*[\])]\s*$", "")


def compact(text: Column) -> Column:
    """No white space, one kind of angle bracket, no backticks around the claim box's name."""
    t = F.regexp_replace(text, r"\s+", "")
    t = F.translate(t, "〈〉＜＞", "<><>")
    return F.replace(t, F.lit("`<보기>`"), F.lit("<보기>"))


def split_choices(text: Column) -> Column:
    """The choices behind the marks ① to ⑤, blanks dropped."""
    parts = F.slice(F.split(text, "[①②③④⑤]"), 2, 2**31 - 2)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def item_digest(*cols: Column) -> Column:
    """SHA-256 of the columns as a JSON array."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cols))), 256)


def selection_fingerprint(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def namespace_id(manifest: Column, code: Column, selection: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", manifest, code, selection), 256), 1, 20)
