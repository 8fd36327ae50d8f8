"""Formula marks: quantities that become formulas, and what is wrong with formulas."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.formulas import ALLOWED, formula_lint, normalize_quantities

REWRITTEN = [
    (None, None), ("", ""), ("말", "말"),
    ("a 3/4 b [[formula: 1/2 ]] 5 / 6m", r"a [[formula:\frac{3}{4}]] b [[formula:1/2]] [[formula:\frac{5}{6}m]]"),
    ("[[formula:a\nb]]7/8", "[[formula:a\nb]]" + r"[[formula:\frac{7}{8}]]"),
    ("a3/4 x_3/4 ]3/4", "a3/4 x_3/4 ]3/4"),
    ("20m 1.5kg 2V, 3x_1 x2y", "[[formula:20m]] 1.5kg [[formula:2V]], 3x_1 x2y"),
    ("질량이 m인 물체의 속력 v_0, 힘F가 시간은 t^2이다", "질량이 [[formula:m]]인 물체의 속력 [[formula:v_0]], 힘F가 시간은 [[formula:t^2]]이다"),
    ("x는? ax는? 3/4k는?", r"[[formula:x]]는? ax는? [[formula:\frac{3}{4}k]]는?"),
    ("[[formula:3/4", r"[[formula:[[formula:\frac{3}{4}]]"),
    ("[[formula: ]]2m", "[[formula:]][[formula:2m]]"),
]


@pytest.mark.parametrize("text,want", REWRITTEN)
def test_rewritten(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(normalize_quantities(F.col("t"))).first()[0] == want


def one_by_one(text):
    """The rules of `normalize_quantities`, with formulas held as private-use characters."""
    kept = []

    def hold(source):
        kept.append(source.strip())
        return chr(0xE000 + len(kept) - 1)

    t = re.sub(r"(?s)\[\[formula:(.+?)\]\]", lambda m: hold(m[1]), text)
    t = re.sub(r"(?<![A-Za-z0-9_\]])(\d+)\s*/\s*(\d+)([A-Za-z]?)", lambda m: hold(f"\\frac{{{m[1]}}}{{{m[2]}}}{m[3]}"), t)
    t = re.sub(r"(?<![A-Za-z0-9_\]])\d+(\.\d+)?[A-Za-z](?![A-Za-z0-9_])", lambda m: hold(m[0]), t)
    t = re.sub(r"((?:질량|힘)(?:이|가|은|는)?\s*)([A-Za-z](?:_[A-Za-z0-9]+|\^[A-Za-z0-9]+)?)(?=인|이다|[,.?)])", lambda m: m[1] + hold(m[2]), t)
    t = re.sub(r"(?<![A-Za-z0-9_])[A-Za-z](?=는\?)", lambda m: hold(m[0]), t)
    return re.sub(f"[{chr(0xE000)}-{chr(0xF8FF)}]", lambda m: f"[[formula:{kept[ord(m[0]) - 0xE000]}]]", t)


def test_like_rules_one_by_one(spark):
    r = random.Random(7)
    bits = ["1", "23", "/", " ", ".", "x", "m", "_", "^2", "[[formula:", "]]", "]", "질량이", "힘", "인", "이다", "는?", ",", "\n"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_quantities(F.col("t")).alias("u")).collect()
    assert all(x.u == one_by_one(x.t) for x in got), next((x.t, x.u, one_by_one(x.t)) for x in got if x.u != one_by_one(x.t))
    assert sum("formula" in x.u and "formula" not in x.t for x in got) > 100


def test_long_texts(spark):
    n = 20_000
    got = spark.createDataFrame([("3/4 " * n,)], "t string").select(normalize_quantities(F.col("t")).alias("u")).first().u
    assert got == r"[[formula:\frac{3}{4}]] " * n


LINTED = [
    ("", []), ("[[formula:\\frac{a}{b}]]", []), ("[[formula:a", ["unclosed"]), ("[[formula:]]", ["unclosed"]), ("[[formula: ]]", ["empty"]),
    ("[[formula:}{]]", ["brace order", "braces"]), ("[[formula:{a]]", ["braces"]), ("[[formula:x₂α]]", ["script", "greek"]), ("[[formula:\\foo\\bar\\Qux]]", ["command", "command"]),
    ("\\frac x₂ \\fraction", ["command outside", "script outside"]), ("\\fraction", []), ("[[formula:{]] [[formula:{]]", ["braces", "braces"]),
]


@pytest.mark.parametrize("text,want", LINTED)
def test_linted(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(formula_lint(F.col("t"), ALLOWED)).first()[0] == want
