"""Formula marks in texts: `[[formula:source]]`, what is wrong with them, and quantities that become formulas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = r"(?s)\[\[formula:(.+?)\]\]"
# Commands of formulas, those that give text away as a formula, and how quantities are written.
ALLOWED = (
    "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "pi", "rho", "sigma", "phi", "omega", "Delta", "Gamma", "Theta", "Lambda", "Phi", "Sigma", "Omega",
    "times", "cdot", "div", "pm", "leq", "geq", "neq", "approx", "to", "infty", "perp", "parallel", "ell",
    "bar", "frac", "sqrt", "vec", "sin", "cos", "tan", "log", "ln", "exp", "lim", "leftarrow", "rightarrow", "leftrightarrow",
)
TELLING = "frac|sqrt|vec|theta|lambda|mu|pi|Delta|alpha|beta|gamma|omega|times"
SCRIPT, GREEK = "[₀-₉⁰-⁹]", "[α-ωΑ-Ω]"
FRACTION = r"(?U)(?<![A-Za-z0-9_\]])(\d+)\s*/\s*(\d+)([A-Za-z]?)"
ATTACHED = r"(?U)(?<![A-Za-z0-9_\]])\d+(?:\.\d+)?[A-Za-z](?![A-Za-z0-9_])"
MEASURES = "질량|높이|속력|속도|가속도|힘|전류|전압|저항|에너지|거리|시간"
CONTEXT = r"(?U)((?:" + MEASURES + r")(?:이|가|은|는)?\s*)([A-Za-z](?:_[A-Za-z0-9]+|\^[A-Za-z0-9]+)?)(?=인|이고|이며|이다|일|[,.?)])"
CONTEXT_WHOLE = r"(?U)^((?:" + MEASURES + r")(?:이|가|은|는)?\s*)(.*)$"
ASKED = r"(?<![A-Za-z0-9_])[A-Za-z](?=는\?)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def formula_spans(text: Column) -> Column:
    """What stands in formula marks, which may go over line ends; at least one character."""
    return F.regexp_extract_all(text, F.lit(MARK), 1)


def held(text: Column, pattern: str, before: Callable[[Column], Column], source: Callable[[Column], Column]) -> Column:
    """`text` cut at what the pattern finds: plain text, a formula, plain text and so on, plain text at both ends.

    `before` is the part of a find that stays plain text, `source` the formula that it becomes.
    """
    finds = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(F.split(text, pattern), finds, lambda plain, find: F.when(find.isNull(), F.array(plain)).otherwise(F.array(F.concat(plain, before(find)), source(find))))
    return F.flatten(pairs)


def normalize_quantities(text: Column) -> Column:
    """`3/4`, `3/4m`, `20m`, symbols behind the name of a measure and symbols that are asked for, as formulas.

    Formulas that are there already stay, without white space at their ends; what one rule has made a formula no later
    rule sees. Null stays null.
    """
    nothing = lambda _: F.lit("")
    rules = (
        (FRACTION, nothing, lambda x: F.regexp_replace(x, FRACTION, r"\\frac{$1}{$2}$3")),
        (ATTACHED, nothing, lambda x: x),
        (CONTEXT, lambda x: F.regexp_extract(x, CONTEXT_WHOLE, 1), lambda x: F.regexp_extract(x, CONTEXT_WHOLE, 2)),
        (ASKED, nothing, lambda x: x),
    )
    parts = held(text, MARK, nothing, lambda x: stripped(F.regexp_extract(x, MARK, 1)))
    # Plain text is at even places, and each piece of it is replaced by an odd number of pieces, so it stays there.
    apply = lambda ps, rule: F.flatten(F.transform(ps, lambda p, i: F.when(i % 2 == 0, held(p, *rule)).otherwise(F.array(p))))
    done = reduce(apply, rules, parts)
    return F.array_join(F.transform(done, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.concat(F.lit("[[formula:"), p, F.lit("]]")))), "")


def source_issues(source: Column, allowed: list[str]) -> Column:
    """Messages about one formula: nothing in it, braces closed before they are opened or left open, scripts and Greek letters as characters, unknown commands."""
    depth = F.aggregate(F.split(source, ""), F.lit(0), lambda a, ch: F.when(a < 0, a).when(ch == "{", a + 1).when(ch == "}", a - 1).otherwise(a))
    unknown = F.filter(F.regexp_extract_all(source, F.lit(r"\\([A-Za-z]+)"), 1), lambda c: ~c.isin(*allowed))
    found = F.array(F.when(depth < 0, "brace order"), F.when(depth != 0, "braces"), F.when(source.rlike(SCRIPT), "script"), F.when(source.rlike(GREEK), "greek"))
    return F.when(stripped(source) == "", F.array(F.lit("empty"))).otherwise(F.concat(F.filter(found, lambda x: x.isNotNull()), F.transform(unknown, lambda _: F.lit("command"))))


def formula_lint(text: Column, allowed: list[str] | tuple[str, ...] = ALLOWED) -> Column:
    """Messages about a text's formulas, in order: marks that aren't closed, commands and scripts outside of marks, then each formula's own."""
    spans, outside = formula_spans(text), F.regexp_replace(text, MARK, "")
    opened = (F.length(text) - F.length(F.replace(text, F.lit("[[formula:"), F.lit("")))) / len("[[formula:")
    first = F.array(F.when(opened != F.size(spans), "unclosed"), F.when(outside.rlike(rf"(?U)\\(?:{TELLING})\b"), "command outside"), F.when(outside.rlike(SCRIPT), "script outside"))
    return F.concat(F.filter(first, lambda x: x.isNotNull()), F.flatten(F.transform(spans, lambda s: source_issues(s, list(allowed)))))
