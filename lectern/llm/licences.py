"""Operator 2: licence scans by canonical digest lookup.

Texts are brought to a canonical form: lower case, copyright statements dropped,
punctuation and runs of white space turned into single blanks, equivalent spellings made
one. The SHA-256 of the canonical text is looked up among the digests of known licences
by a hash join, for the entire text and for each of its lines as a text of its own (a
notice such as "Released under the MIT License." is a licence text of one line). A line
is looked up only if its canonical form is as long as a known one. DataFrame functions
only.

A copyright statement is the word or sign with a sign, year, placeholder or "by" behind
it, and up to STATEMENT_WORDS words as far as the end of its paragraph or one of the
words that open a licence's body; without such an end nothing is dropped. So the form
doesn't depend on where lines are wrapped.

Known licences are the texts in the folder `licence_texts`, with and without their
titles, and the short NOTICES; callers can give a table of their own.

Defined results: a null or empty text matches nothing; a text that consists of copyright
statements alone canonicalises to nothing and matches nothing; several known licences
with the same canonical text give the one that sorts first; repeated rows repeat their
results; texts of any length are read whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.scratch import written

FOLDER = Path(__file__).parent / "licence_texts"

# Equivalent spellings as parts of words, each with what it becomes.
SPELLINGS = (
    ("licenc", "licens"),
    ("merchantib", "merchantab"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("initialis", "initializ"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("fulfill", "fulfil"),
    ("programme", "program"),
    ("catalogue", "catalog"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

# Equivalent spellings of several words, looked for within lines or joined lines.
PHRASES = (
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("all rights reserved ", ""),
)

# Words that open a licence's body behind a copyright statement.
OPENERS = (
    "permission is", "permission to", "redistribution and", "redistributions of", "this software", "this program", "this library",
    "this file", "this source", "this is free", "this work", "this license", "this document", "licensed under", "released under",
    "distributed under", "everyone is", "anyone is", "all rights reserved", "the software", "version 2", "preamble",
)

# Titles that licences go by, besides the one in their text and none.
TITLES = {
    "MIT": ("The MIT License", "The MIT License (MIT)"),
    "MIT-0": (),
    "ISC": ("The ISC License", "ISC License (ISC)"),
    "0BSD": (),
    "BSD-2-Clause": ("The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("The BSD 3-Clause License", "New BSD License"),
    "Zlib": ("The zlib/libpng License",),
}

# Short notices by which a text says its licence.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)

#: Most words of a copyright statement behind its first.
STATEMENT_WORDS = 40
_OPENING = "|".join(OPENERS).replace(" ", r"\s+")
_BEGIN = r"(?:copyright\s*(?:\(c\)|©|\d{4}|[<\[{]|by\s)|©|\(c\)\s*(?:copyright|\d{4}|[<\[{]|(?:[^\s\x01]+\s+){1,6}?\d{4}\b))"
STATEMENT = rf"{_BEGIN}[^\s\x01]*(?:\s+[^\s\x01]+){{0,{STATEMENT_WORDS}}}?(?=\s*(?:\x01|\z)|\s+(?:{_OPENING})\b)"
HOLDER = r"neither the names? of (?:\S+ ){1,16}?nor the names of"


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def plain(text: Column) -> Column:
    """Letters and digits in lower case, without copyright statements, with single blanks or line ends between."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\n[ \t]*\n\s*", "\n\u0001\n")  # ends of paragraphs
    t = F.regexp_replace(t, STATEMENT, "")
    return replaced(F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " "), SPELLINGS)


def joined(text: Column) -> Column:
    """The canonical form of a whole text, from its plain one."""
    t = F.concat(F.regexp_replace(text, r" ?\n[ \n]*", " "), F.lit(" "))
    return F.trim(F.regexp_replace(replaced(t, PHRASES), HOLDER, "neither the name of the copyright holder nor the names of"))


def lines_of(text: Column) -> Column:
    """The canonical forms of a text's lines, from its plain one."""
    return F.transform(F.split(text, "\n"), lambda x: F.trim(replaced(F.concat(F.trim(x), F.lit(" ")), PHRASES)))


def canonical(text: Column) -> Column:
    """The canonical form: letters and digits in lower case with single blanks between."""
    return joined(plain(text))


def known_texts(folder: Path = FOLDER) -> list[tuple[str, str]]:
    """(licence, body) of the texts in a folder, named by licence (`-notice` apart), and of the short notices."""
    found = []
    for path in sorted(folder.glob("*.txt")):
        licence, body = path.stem.removesuffix("-notice"), path.read_text()
        found.append((licence, body))
        if path.stem in TITLES:
            rest = body.split("\n\n", 1)[1]
            found += [(licence, f"{title}\n\n{rest}") for title in ("", *TITLES[path.stem])]
    return [*found, *NOTICES]


def known_licences(spark: SparkSession, folder: Path = FOLDER) -> DataFrame:
    """(licence, body) of the known texts."""
    return spark.createDataFrame(known_texts(folder), "licence string, body string")


def digests(known: DataFrame) -> DataFrame:
    """One row for each canonical text: digest, licence and length."""
    forms = known.select("licence", plain(F.col("body")).alias("body")).select("licence", joined(F.col("body")).alias("t")).where("t <> ''")
    return forms.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("t")).alias("length"))


def scan(df: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, canonical_sha256, licence (of the entire text) and line_licences.

    `line_licences` holds the distinct licences of lines that are licence texts of their own, sorted and joined by
    commas; empty if there are none. Texts are read once; what is stored are digests. Whether the known digests are
    broadcast is left to their size as stored.
    """
    by_digest = written(digests(known), "licence-digests")
    lengths = [r.length for r in by_digest.select("length").distinct().collect()]  # no more than there are known licences
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), plain(F.col(f"`{text}`")).alias("t"))
    rows = rows.select("doc_id", "row", joined(F.col("t")).alias("whole"), F.filter(lines_of(F.col("t")), lambda x: F.length(x).isin(lengths)).alias("lines"))
    digest = lambda x: F.unhex(F.sha2(x, 256))
    rows = written(rows.select("doc_id", "row", F.when(F.col("whole") != "", digest("whole")).alias("whole"), F.transform("lines", digest).alias("lines")), "canonical")
    names = by_digest.select(F.unhex("digest").alias("digest"), "licence")
    lines = rows.where(F.size("lines") > 0).select("row", F.explode(F.array_distinct("lines")).alias("digest"))
    found = lines.join(names.withColumnRenamed("licence", "of_line"), "digest").groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("of_line")), ",").alias("line_licences"))
    found = written(found, "licence-lines")  # its size then decides how it is joined, and the join can split large partitions
    whole = rows.select("doc_id", "row", "whole").join(names.withColumnRenamed("digest", "whole"), "whole", "left")
    return whole.join(found, "row", "left").select(
        "doc_id", F.lower(F.hex("whole")).alias("canonical_sha256"), "licence", F.coalesce("line_licences", F.lit("")).alias("line_licences")
    )


#: The canonical form in DuckDB's functions, written apart from the one above: what ends a statement is put back.
SQL_FORM = r"""
regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(coalesce(t, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '\n[ \t]*\n\s*', chr(10) || chr(1) || chr(10), 'g'),
  '(copyright\s*(\(c\)|©|[0-9]{4}|<|\[|\{|by\s)|©|\(c\)\s*(copyright|[0-9]{4}|<|\[|\{|([^\s\x01]+\s+){1,6}?[0-9]{4}\b))[^\s\x01]*(\s+[^\s\x01]+){0,40}?(\s*\x01|\s*\z|\s+(OPENERS)\b)', '\6', 'g'),
  '[^\pL\pN\n]+', ' ', 'g')
"""


def oracle_scan() -> str:
    """DuckDB SQL for the scan of documents against the known texts."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    body = SQL_FORM.strip().replace("OPENERS", "|".join(f"({x})" for x in OPENERS).replace(" ", "[ \\n\\x01\\t]+"))
    spelt = lambda t, pairs: reduce(lambda x, p: f"replace({x}, {quoted(p[0])}, {quoted(p[1])})", pairs, t)
    form = lambda column: spelt(body.replace("coalesce(t, '')", f"coalesce({column}, '')"), SPELLINGS)
    one_line = spelt(r"(regexp_replace(t, ' ?\n[ \n]*', ' ', 'g') || ' ')", PHRASES)
    whole = f"trim(regexp_replace({one_line}, 'neither the names? of ([^ ]+ ){{1,16}}?nor the names of', 'neither the name of the copyright holder nor the names of', 'g'))"
    line = f"trim({spelt("(trim(u.line) || ' ')", PHRASES)})"
    return f"""
WITH known(licence, body) AS (VALUES {values}),
k AS (SELECT sha256(w) AS digest, min(licence) AS licence FROM (SELECT licence, {whole} AS w FROM (SELECT licence, {form('body')} AS t FROM known)) WHERE w <> '' GROUP BY 1),
texts AS (SELECT text, {form('text')} AS t FROM (SELECT DISTINCT text FROM documents)),
w AS (SELECT text, {whole} AS w FROM texts),
l AS (SELECT DISTINCT text, {line} AS t FROM texts, unnest(string_split(t, chr(10))) AS u(line)),
f AS (SELECT text, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences FROM l JOIN k ON sha256(l.t) = k.digest WHERE l.t <> '' GROUP BY text)
SELECT d.doc_id, CASE WHEN w.w <> '' THEN sha256(w.w) END AS canonical_sha256, k.licence, coalesce(f.line_licences, '') AS line_licences
FROM documents d JOIN w ON d.text IS NOT DISTINCT FROM w.text LEFT JOIN k ON sha256(w.w) = k.digest AND w.w <> '' LEFT JOIN f ON d.text = f.text
"""
