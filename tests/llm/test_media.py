import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import gif, warc
from tests.llm.helpers import ROWS, docs, empty, stored


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 30))
def test_lzw_round_trip(data, times):
    data = (data or b"a") * times
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes() == data


def test_lzw_table_fills_and_clears():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes() == data


def test_deferred_clear():
    """A stream that goes on with a full table: literals of twelve bits for ever."""
    n = 9000
    codes = [256, *([7, 9] * (n // 2)), 257]
    places = [0, *range(n), n]
    width = gif.widths(8)[np.minimum(places, gif.CODES)]
    bits = "".join(format(c, f"0{w}b")[::-1] for c, w in zip(codes, width))
    data = np.packbits([int(b) for b in bits], bitorder="little").tobytes()
    assert gif.lzw_decode(data, 8, n).tolist() == [7, 9] * (n // 2)


def small_gif(frames, size=(4, 4), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), interlace=False):
    """frames: (left, top, width, height, samples, disposal, transparent, local palette)."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(v for c in palette for v in c)]
    for left, top, w, h, samples, disposal, clear, local in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 5, clear or 0, 0))
        flags = (0x81 if local else 0) | (0x40 if interlace else 0)
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (bytes(v for c in local for v in c) if local else b""))
        out.append(b"\x02" + gif.sub_blocks(gif.lzw_encode(bytes(samples), 2)))
    return b"".join([*out, b"\x3b"])


RED, GREEN, BLUE = 3 * 16, 3 * 4, 3


def test_disposal_transparency_and_palettes():
    full, dot = [1] * 16, [2]
    local = ((0, 0, 255),) * 4
    got = gif.frames_of(small_gif([
        (0, 0, 4, 4, full, 1, None, None),
        (1, 1, 1, 1, dot, 3, None, None),  # then back to what was before
        (0, 0, 2, 1, [3, 2], 2, 3, None),  # the first sample is transparent; then cleared
        (3, 3, 1, 1, [0], 1, None, local),
    ]))
    hist = [{k: v for k, v in enumerate(f["histogram"]) if v} for f in got]
    assert hist[0] == {RED: 16}
    assert hist[1] == {RED: 15, GREEN: 1}
    assert hist[2] == {RED: 15, GREEN: 1}
    assert hist[3] == {RED: 13, 0: 2, BLUE: 1}
    assert [f["delay_ms"] for f in got] == [50] * 4


def test_interlace():
    samples = [r % 4 for r in gif.interlaced(9) for _ in range(4)]
    got = gif.frames_of(small_gif([(0, 0, 4, 9, samples, 0, None, None)], size=(4, 9), interlace=True))
    assert got[0]["samples"] == bytes(r % 4 for r in range(9) for _ in range(4))


def test_gif_of_texts(spark):
    d = docs(spark)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in gif.media_digests(d).collect()), key=str)
    want = []
    for r in ROWS:
        raw = (r[1] or "").encode()
        full = gif.padded(raw)
        want.append((r[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(want, key=str)
    assert gif.media_digests(empty(spark)).count() == 0


def test_broken_gifs_have_no_frames(spark):
    whole = gif.gif_of(b"abc")
    d = spark.createDataFrame([(bytearray(x),) for x in (b"", b"nonsense", whole[:-200], whole)] + [(None,)], "media binary")
    got = [r.frames for r in gif.decode_gif(d).collect()]
    assert [x is None for x in got] == [True, True, True, False, True]


PAGES = [(1, "http://a.example/x?y=1", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "http://c.example/a b\r\nX: y", ""), (5, "https://[bad", "ü WARC/1.1\r\n\r\n"), (1, "http://a.example/x?y=1", "<p>one</p>"), (None, "http://n.example", "alone"), (7, "http://l.example", "long " * 50_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = stored(spark, tmp_path, spark.createDataFrame(PAGES, "page_id long, url string, html string"), "pages")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_back(pages).collect()), key=str)
    want = [(1, 10, "response", None), (1, 10, "revisit", 1), (2, 10, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, len("ü WARC/1.1\r\n\r\n".encode()), "response", None), (7, 250_000, "response", None), (None, 5, "response", None)]
    assert got == sorted(want, key=str)


def test_digest_is_base32_sha1(spark):
    import base64

    from pyspark.sql import functions as F

    for text in ("", "abc", "ü" * 999):
        got = spark.range(1).select(warc.base32_sha1(F.lit(text).cast("binary"))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_archives_are_whole_gzip_members(spark, tmp_path):
    import gzip

    pages = stored(spark, tmp_path, spark.createDataFrame(PAGES, "page_id long, url string, html string"), "pages")
    warc.write_warc(pages, f"{tmp_path}/w", captures_a_file=2)
    files = sorted((tmp_path / "w").glob("part-*"))
    records = [h for f in files for h, _ in warc.parse(f.read_bytes())]
    assert all(f.read_bytes()[:2] == b"\x1f\x8b" for f in files)
    assert len(records) == 3 * len(PAGES) and len(files) >= 4
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in files) == len(records)
    assert len({h["warc-record-id"][0] for h in records}) == len(records)


def test_captures_are_nested(spark, tmp_path):
    pages = stored(spark, tmp_path, spark.createDataFrame(PAGES, "page_id long, url string, html string"), "pages")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()
    assert len(got) == len(PAGES) and all(len(r.requests) == len(r.metadata) == 1 for r in got)
    assert {bytes(r.response.payload).decode() for r in got if r.record_type == "response"} == {p[2] or "" for p in PAGES}
    assert next(r for r in got if r.target_uri and "c.example" in r.target_uri).target_uri == "http://c.example/a%20b%0D%0AX:%20y"


def test_no_pages(spark, tmp_path):
    pages = stored(spark, tmp_path, spark.createDataFrame([], "page_id long, url string, html string"), "pages")
    assert warc.read_back(pages).count() == 0


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 96 * 96, 96 * 96 + 1])
def test_padding_and_frames(size):
    data = bytes(i % 251 for i in range(size))
    frames = gif.frames_of(gif.gif_of(data))
    assert b"".join(f["samples"] for f in frames) == gif.padded(data)


def test_records_of_sixteen_megabytes_leave_no_padding(tmp_path):
    import gzip

    big = warc.record([("WARC-Type", "response")], b"\1" * (1 << 24)) + b"\0"
    content = big + warc.record([("WARC-Type", "request")], b"x") + b"\0"
    assert [h["warc-type"] for h, _ in warc.parse(content)] == [["response"], ["request"]]
    at = 0
    while at < len(content):  # members and nothing between
        member = zlib.decompressobj(31)
        member.decompress(content[at:])
        assert member.eof
        at = len(content) - len(member.unused_data)
    assert len(gzip.decompress(content)) > 1 << 24


def test_reading_is_linear():
    import time

    one = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<a>")], b"x" * 500) + b"\0"
    took = []
    for n in (10_000, 100_000):
        began = time.perf_counter()
        assert sum(1 for _ in warc.parse(one * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1


def test_cut_off_archives_are_an_error():
    whole = warc.record([("WARC-Type", "request")], b"x" * 500) + b"\0"
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-20]))


def archive(*records):
    """An archive that isn't compressed, of (headers, block)."""
    out = []
    for headers, block in records:
        lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
        out.append(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n")
    return b"".join(out)


def test_ties_in_both_directions_and_to_several_captures(spark, tmp_path):
    tie, rid = "WARC-Concurrent-To", "WARC-Record-ID"
    content = archive(
        ([("WARC-Type", "warcinfo"), (rid, "<w>")], b"software: x"),
        ([("WARC-Type", "response"), (rid, "<a>"), (tie, "<q>"), (tie, "<m>")], b"HTTP/1.1 200 OK\r\n\r\none"),
        ([("WARC-Type", "request"), (rid, "<q>")], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "response"), (rid, "<b>")], b"HTTP/1.1 200 OK\r\n\r\ntwo"),
        ([("WARC-Type", "metadata"), (rid, "<m>"), (tie, "<a>"), (tie, "<b>")], b"k: v"),
        ([("WARC-Type", "request"), (rid, "<r>"), (tie, "<gone>")], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "request"), (rid, "<s>")], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "request"), (rid, "<t>")], b"GET / HTTP/1.1\r\n\r\n"),
    )
    (tmp_path / "x.warc").write_bytes(content)
    records = stored(spark, tmp_path, warc.read_warc(spark, f"{tmp_path}/x.warc"), "records")
    got = sorted((str(r.capture_id), r.record_type, [q.record_id for q in r.requests], [m.record_id for m in r.metadata]) for r in warc.assemble(records).collect())
    assert got == sorted([("<a>", "response", ["<q>"], ["<m>"]), ("<b>", "response", [], ["<m>"]), ("<gone>", None, ["<r>"], []), ("None", None, ["<s>"], []), ("None", None, ["<t>"], [])], key=str)


def test_feature_against_brute_force(spark):
    d = docs(spark).selectExpr("*", "1 AS media", "2 AS frames", "3 AS samples")
    for r in gif.media_digests(d).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id and len((x[1] or "").encode()) == r.n_bytes)
        data, size = gif.padded((text or "").encode()), gif.WIDTH * gif.WIDTH
        bins = [0] * 64
        shown = bytearray(min(size, len(data)))
        frames = [data[i : i + size] for i in range(0, len(data), size)]
        for frame in frames:
            shown[: len(frame)] = frame  # frames lie over what was there
            for v in shown:
                bins[(v >> 6) * 21] += 1
        assert r.feature == f"{len(frames)};{','.join(map(str, bins))}"
        assert r.media_bytes == len(gif.gif_of(data)) and r.media_sha256 == hashlib.sha256(gif.gif_of(data)).hexdigest()
