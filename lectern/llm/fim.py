"""Operator 12: fill-in-the-middle by rotating blocks in place.

A text's UTF-8 bytes stand in a bytearray. A scan over the starts of its code points
finds the two cuts; the sentinels go in before prefix, middle and suffix; then two
neighbouring blocks change places by three reversals (each block by itself, then both
together), piece by piece inside the same bytes: middle and suffix for the order
prefix-suffix-middle, prefix with middle and suffix for suffix-prefix-middle. Restoring
finds the sentinels, makes the opposite rotation and takes the sentinels out.

Cuts and forms come from the SHA-256 of `1:` and the row's id, so that they don't depend
on partitions or order and a lost task gives the same again.

Defined results: a null text counts as empty and stays plain; a text with a sentinel in
it stays plain; a null id hashes as an empty one; rows with equal ids have equal draws,
whatever their texts; texts of any length are cut whole; an empty table gives an empty
result; kept columns stay as they are, and results whose names they have get underscores
behind theirs. Bytes that aren't UTF-8 are kept; each that doesn't continue a code point
counts as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow_io import append_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of 100 texts, those that are transformed; of 100 of these, those whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of each end that change places at a time when a block is reversed.
STEP = 1 << 16


def draws(doc_id: Column) -> Column:
    """Four unsigned 32-bit numbers of a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def reverse(block: np.ndarray, a: int, b: int) -> None:
    """Reverse bytes a to b where they are."""
    while b - a > 1:
        n = min(STEP, (b - a) // 2)
        head = block[a : a + n][::-1].copy()
        block[a : a + n] = block[b - n : b][::-1]
        block[b - n : b] = head
        a, b = a + n, b - n


def rotate(data: bytearray, a: int, b: int, c: int) -> None:
    """Let the blocks a to b and b to c change places."""
    block = np.frombuffer(data, np.uint8)
    for x, y in ((a, b), (b, c), (a, c)):
        reverse(block, x, y)


def starts_of(data: bytes) -> np.ndarray | range:
    """Where each code point begins."""
    if data.isascii():
        return range(len(data))
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def transform(text: bytes | None, h: list[int]) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, code points, form, and code points of prefix and middle (None where plain)."""
    text = text or b""
    starts = starts_of(text)
    n = len(starts)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= TRANSFORMED:
        return text, n, "plain", None, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = (int(starts[k]) if k < n else len(text) for k in (first, second))
    data = bytearray(text)
    data[j:j] = SUFFIX
    data[i:i] = MIDDLE
    data[0:0] = PREFIX
    i, j = i + len(PREFIX), j + len(PREFIX) + len(MIDDLE)
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    rotate(data, 0 if form == "spm" else i, j, len(data))
    return bytes(data), n, form, first, second - first


def restore(output: bytes | None, form: str | None) -> bytes:
    """The text that `transform` was given, but for null."""
    if form not in ("psm", "spm"):
        return output or b""
    data = bytearray(output)
    if form == "psm":
        i, j = data.index(SUFFIX), data.index(MIDDLE)
        rotate(data, i, j, len(data))
    else:
        i = data.index(PREFIX)
        rotate(data, 0, i, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = data.index(mark)
        del data[at : at + len(mark)]
    return bytes(data)


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all), then `output`, `n`, `form`, `prefix_chars` and `middle_chars` of each text. No shuffle."""
    added = [("output", T.BinaryType()), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    kept = df.columns if keep is None else keep
    both = df.select(*(F.col(f"`{c}`") for c in kept), F.struct(F.col(f"`{text}`").cast("binary").alias("text"), draws(F.col(f"`{doc_id}`")).alias("h")).alias("drawn text"))

    def work(rows: pa.Array) -> list[pa.Array]:
        made = [transform(r["text"], r["h"]) for r in rows.to_pylist()]
        outs = list(zip(*made)) or [()] * len(added)
        return [pa.array(o, k) for o, k in zip(outs, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]

    out = append_columns(both, "drawn text", kept, T.StructType([T.StructField(*x) for x in added]), lambda: work)
    name = out.columns[len(kept)]
    return out.withColumn(name, F.col(f"`{name}`").cast("string"))


def restored(df: DataFrame, output: str = "output", form: str = "form", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all) and `restored`, the texts that outputs and forms came from."""
    kept = df.columns if keep is None else keep
    both = df.select(*(F.col(f"`{c}`") for c in kept), F.struct(F.col(f"`{output}`").cast("binary").alias("o"), F.col(f"`{form}`").alias("f")).alias("formed text"))

    def work(rows: pa.Array) -> list[pa.Array]:
        return [pa.array([restore(r["o"], r["f"]) for r in rows.to_pylist()], pa.binary())]

    out = append_columns(both, "formed text", kept, T.StructType([T.StructField("restored", T.BinaryType())]), lambda: work)
    name = out.columns[-1]
    return out.withColumn(name, F.col(f"`{name}`").cast("string"))


ORACLE_FIM = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {TRANSFORMED} THEN 'plain'
      WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
    ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""
