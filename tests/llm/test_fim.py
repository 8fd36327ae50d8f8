"""Blocks that change places, against slices of the text and against SQL."""

import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import fim, queries_text
from tests.llm.helpers import ROWS, docs, empty, stored


def by_slices(text, h):
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, n, "plain", None, None
    p, m, s = text[:i], text[i:j], text[j:]
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", n, "spm", i, j - i
    return f"<P>{p}<S>{s}<M>{m}", n, "psm", i, j - i


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="<PSM>a", max_size=12), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_like_slices_and_back(text, h):
    raw = text.encode()
    out, n, form, prefix, middle = fim.transform(raw, h)
    assert (out.decode(), n, form, prefix, middle) == by_slices(text, h)
    assert fim.restore(out, form) == raw


def test_long_blocks_are_reversed_in_steps(monkeypatch):
    monkeypatch.setattr(fim, "STEP", 3)
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(40)
        a, b, c = sorted(rng.randrange(n + 1) for _ in range(3))
        data = bytes(rng.randrange(256) for _ in range(n))
        out = bytearray(data)
        fim.rotate(out, a, b, c)
        assert bytes(out) == data[:a] + data[b:c] + data[a:b] + data[c:]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_like_brute_force_and_sql(spark, tmp_path):
    rows = [*ROWS, *((i, t, None, None, None) for i, t in enumerate(["<P>", "a<S>b", "<<M>", "<", "é😀漢字" * 9, "<S", ">P<"] * 20, 100))]
    stored(spark, tmp_path, docs(spark, rows))
    got = sorted(map(str, map(tuple, queries_text.op12_fim(spark, str(tmp_path)).collect())))
    want = []
    for i, text, *_ in rows:
        text = text or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        out, *rest = by_slices(text, [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)])
        want.append(str((i, *rest, sha(out), sha(text))))
    assert got == sorted(want)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, c.sql(fim.ORACLE_FIM).fetchall())) == got


def test_clashing_names_bad_bytes_and_nothing(spark):
    d = docs(spark).selectExpr("*", "1 AS output", "2 AS FORM", "3 AS restored")
    out = fim.fill_in_middle(d)
    assert out.columns == [*d.columns, "output_", "n", "form_", "prefix_chars", "middle_chars"]
    back = fim.restored(out, output="output_", form="form_")
    assert back.columns == [*out.columns, "restored_"]
    assert all((r.text or "") == r.restored_ and (r.output, r.FORM, r.restored) == (1, 2, 3) for r in back.collect())
    assert fim.restored(fim.fill_in_middle(empty(spark))).count() == 0
    bad = b"\xff\x80a\xc3"
    made = [fim.transform(bad, [a, b, 0, d]) for a in range(4) for b in range(4) for d in (0, 50)]
    assert all(m[1] == 3 and fim.restore(m[0], m[2]) == bad for m in made)
