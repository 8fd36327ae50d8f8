"""Curriculum lines against a line-by-line reading, in ranges of any size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import curriculum

LINES = "doc_id int, line_no int, line string"


def read(lines):
    """(unit_no, section, code, text) of one document, one line after the other."""
    out, seen, unit, section, entry = [], set(), None, None, None

    def close():
        nonlocal entry
        if entry:
            text = re.sub(r"\s+", " ", entry[3]).strip()
            if entry[1] == "std" or text and entry[0] is not None:
                out.append((*entry[:3], text))
        entry = None

    for line in lines:
        if line is None or not line.strip() or re.fullmatch(r"[0-9]{1,4}", line.strip()):
            continue
        if re.match(curriculum.END, line):
            break
        head, code, bullet = re.match(r"^\s*\((\d{1,2})\)\s*(\S.*\S|\S)\s*$", line), re.match(r"^\s*\[9과(\d\d)-(\d\d)\]\s*(.*)$", line), re.match(curriculum.BULLET, line)
        mark = next((k for k, v in curriculum.SECTIONS.items() if re.match(v, line)), None)
        if head:
            close()
            n = int(head[1])
            if 1 <= n <= 40 and n not in seen:
                unit, section = n, "none"
                out.append((n, "unit", None, head[2]))
            seen.add(n)
        elif mark:
            close()
            section = mark
        elif code:
            close()
            unit, section = int(code[1]), "std"
            seen.add(unit)
            entry = [unit, "std", f"[9과{code[1]}-{code[2]}]", code[3]]
        elif bullet:
            close()
            if section in curriculum.SECTIONS:
                entry = [unit, section, None, bullet[1]]
        elif entry:
            entry[3] += line.strip() + (" " if line != line.rstrip() else "")
    close()
    return out


def some_lines(seed, n):
    rng = random.Random(seed)
    kinds = ["({}) unit name", " ({})x ", "<탐구 활동>", "(가) 성취기준 해설", "(나) 성취기준 적용 시 고려 사항", "[9과{:02}-0{}] a text ", "• bullet {}", "· ", "word{} ", "wo", "", "12", None, "(55) other"]
    return [k and k.format(rng.randrange(9), rng.randrange(9)) for k in (rng.choice(kinds) for _ in range(n))]


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_like_one_line_after_the_other(spark, monkeypatch, size):
    monkeypatch.setattr(curriculum.carried, "__defaults__", (size,))
    docs = {d: some_lines(d, 120) for d in range(4)} | {4: ["[9과01-01] x", "3. 교수⋅학습", "(2) late"], 5: [], 6: ["• alone", "text"]}
    rows = [(d, i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    random.Random(1).shuffle(rows)
    got = curriculum.entries(spark.createDataFrame(rows, LINES), "9과").collect()
    for d, lines in docs.items():
        own = sorted(str((r.unit_no, r.section, r.code, r.text)) for r in got if r.doc_id == d)
        assert own == sorted(map(str, read(lines)))
    assert len(got) > 60


def test_report_and_global_numbers(spark):
    rows = enumerate(["(2) light", "[9과02-01] a", "b ", "<탐구 활동>", "• one", "• two", "(나) 성취기준 적용", "• three", "[9과07-02] c"])
    found = curriculum.entries(spark.createDataFrame([(1, i, line) for i, line in rows], LINES), "9과")
    assert sorted(map(tuple, curriculum.unit_report(found).collect())) == [(1, 2, "light", 1, 2, 2, 0, 1), (1, 7, "(7)", 1, 1, 0, 0, 0)]
    known = curriculum.global_unit_no(spark.createDataFrame([("a", 3), ("b", 4)], "subject string, unit_no int"), spark.createDataFrame([("a", 500)], "subject string, base int"))
    assert sorted(map(tuple, known.collect())) == [("a", 3, 503), ("b", 4, None)]


def test_heads_and_sections(spark):
    d = spark.createDataFrame([("(3) name ",), ("(x) name",), ("< 탐구 활동 > x",), ("(가) 성취기준 해설",)], "t string")
    got = d.select(curriculum.parse_unit_head(F.col("t")).alias("h"), curriculum.section_of(F.col("t")).alias("s")).collect()
    assert [(tuple(r.h) if r.h else None, r.s) for r in got] == [((3, "name"), None), (None, None), (None, "inquiry"), (None, "explain")]
