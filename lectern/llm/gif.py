"""Operator 4: GIF media columns.

`encode_gif` stores bytes as the 8-bit samples of an animated GIF: a grey palette, rows
of WIDTH samples, frames of up to WIDTH rows, LZW-coded. `decode_gif` reads any GIF87a
or GIF89a: it decodes the LZW code streams, applies global and local palettes, interlace,
transparency and disposal, and gives timed frames, each with its samples and the colour
histogram of the picture shown.

Decoding works on whole arrays. The width of each code follows from its place since the
last clear code, so codes are cut out at once. Table entry i is the output of code i and
one byte more, so it is a stretch of the output itself; each output byte therefore
points to an earlier one, and pointers are doubled until all end at literals.

Defined results: a null payload counts as empty and is padded like any other; bytes that
aren't a whole GIF give null frames; a GIF without pictures gives no frames; repeated
rows repeat their results; texts of any length are stored whole, in as many frames as
they need; an empty table gives an empty result; other columns pass through, and results
whose names they have get underscores behind theirs.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow_io import append_columns

#: Payloads are padded to a multiple of UNIT bytes, which are whole rows of WIDTH samples.
UNIT, WIDTH, PAD = 576, 96, 255
DELAY = 10
BINS = 64
CODES = 4096
FRAME = T.StructType([
    T.StructField("delay_ms", T.IntegerType()), T.StructField("disposal", T.IntegerType()),
    T.StructField("left", T.IntegerType()), T.StructField("top", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.IntegerType())),
])


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples of `bits` bits: clear codes at the start and whenever the table is full."""
    clear = 1 << bits
    codes, places = [clear], [0]
    table: dict[int, int] = {}
    prefix, j = data[0], 0
    find = table.get
    room = CODES - clear - 2
    for c in memoryview(data)[1:]:
        key = prefix << 8 | c
        code = find(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        places.append(j)
        if j < room:
            table[key] = clear + 2 + j
            j += 1
        else:
            codes.append(clear)
            places.append(j + 1)
            table.clear()
            j = 0
        prefix = c
    codes += [prefix, clear + 1]
    places += [j, j + 1]
    width = widths(bits)[np.minimum(np.array(places), CODES)]
    value = np.array(codes, np.uint16)
    shifts = np.arange(12, dtype=np.uint16)
    each = ((value[:, None] >> shifts) & 1).astype(np.uint8)
    return np.packbits(each[shifts < width[:, None]], bitorder="little").tobytes()


@lru_cache(maxsize=16)
def widths(bits: int) -> np.ndarray:
    """The width of the code at each place since the last clear code; the place after the table is full stands for all later ones."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(CODES + 1) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)


@lru_cache(maxsize=16)
def offsets(bits: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(widths(bits))])


def cut_codes(padded: np.ndarray, at: int, bits: int, first: int, n: int) -> np.ndarray:
    """`n` codes from bit `at` on, of which the first has place `first` since the last clear code."""
    place = np.minimum(np.arange(first, first + n), CODES)
    width = widths(bits)[place]
    start = at + np.concatenate([[0], np.cumsum(width)[:-1]])
    byte = start >> 3
    raw = padded[byte].astype(np.uint32) | padded[byte + 1].astype(np.uint32) << 8 | padded[byte + 2].astype(np.uint32) << 16
    return (raw >> (start & 7).astype(np.uint32)).astype(np.int64) & ((1 << width) - 1)


def expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    n = len(codes)
    back = codes - clear - 2
    refers = back >= 0
    here = np.arange(n)
    if (codes[~refers] >= clear).any() or (refers & (back >= here)).any():
        raise ValueError("a code outside the table")
    to = np.where(refers, back, here)
    hops = refers.astype(np.int64)
    while (hops[to] > 0).any():
        hops, to = hops + hops[to], to[to]
    lengths = hops + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    of = np.repeat(here, lengths)
    source = np.arange(ends[-1]) + np.where(refers, starts[np.where(refers, back, 0)] - starts, 0)[of]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return codes[of[source]].astype(np.uint8)


def lzw_decode(data: bytes, bits: int, samples: int) -> np.ndarray:
    """The first `samples` samples of a code stream."""
    clear = 1 << bits
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    total = 8 * len(data)
    at, got, parts = 0, 0, []
    while got < samples:
        codes: list[np.ndarray] = []
        first, ended = 0, False
        while not ended:
            left = total - at
            n = int(np.searchsorted(offsets(bits)[first:] - offsets(bits)[first], left, side="right") - 1) if first < CODES else left // 12
            n = min(n, CODES)
            if n <= 0:
                ended, stop = True, True
                break
            found = cut_codes(padded, at, bits, first, n)
            marks = np.nonzero((found == clear) | (found == clear + 1))[0]
            take = int(marks[0]) if len(marks) else n
            codes.append(found[:take])
            used = take + bool(len(marks))
            at += int(widths(bits)[np.minimum(np.arange(first, first + used), CODES)].sum())
            first += used
            if len(marks):
                ended, stop = True, int(found[take]) == clear + 1
        joined = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        if len(joined):
            parts.append(expand(joined, clear))
            got += len(parts[-1])
        if stop:
            break
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if len(out) < samples:
        raise ValueError("too few samples")
    return out[:samples]


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def padded(payload: bytes) -> bytes:
    return payload + bytes([PAD]) * (max(1, -(-len(payload) // UNIT)) * UNIT - len(payload))


GREYS = bytes(v for i in range(256) for v in (i, i, i))


def gif_of(payload: bytes) -> bytes:
    """An animated GIF that holds the padded payload's bytes as its samples, row by row and frame by frame."""
    data = padded(payload)
    rows = len(data) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, WIDTH), 0xF7, 0, 0), GREYS]
    for top in range(0, rows, WIDTH):
        height = min(WIDTH, rows - top)
        part = data[top * WIDTH : (top + height) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, height, 0) + b"\x08" + sub_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def interlaced(height: int) -> np.ndarray:
    """The row of the picture at which each stored row of an interlaced one goes."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames_of(media: bytes) -> list[dict]:
    """The frames of a GIF, in order."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13
    palette = lambda n: np.frombuffer(media, np.uint8, 3 * n, at).reshape(-1, 3)
    common = None
    if packed & 0x80:
        common = palette(2 << (packed & 7))
        at += common.size
    shown = np.zeros((height, width, 3), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    frames = []
    while True:
        kind = media[at]
        if kind == 0x3B:
            return frames
        if kind == 0x21:
            label, at = media[at + 1], at + 2
            if label == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", media, at + 1)
                disposal, clear_index = flags >> 2 & 7, index if flags & 1 else None
            while media[at]:
                at += 1 + media[at]
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        colours = common
        if packed & 0x80:
            colours = palette(2 << (packed & 7))
            at += colours.size
        bits, at, stream = media[at], at + 1, []
        while media[at]:
            stream.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        at += 1
        samples = lzw_decode(b"".join(stream), bits, w * h)
        plane = samples.reshape(h, w)
        if packed & 0x40:
            plane = np.empty_like(plane)
            plane[interlaced(h)] = samples.reshape(h, w)
        before = shown.copy() if disposal == 3 else None
        area = shown[top : top + h, left : left + w]
        seen = plane[: area.shape[0], : area.shape[1]]
        mapped = colours[np.minimum(seen, len(colours) - 1)]
        area[...] = mapped if clear_index is None else np.where((seen == clear_index)[..., None], area, mapped)
        bins = (shown[..., 0] >> 6) * 16 + (shown[..., 1] >> 6) * 4 + (shown[..., 2] >> 6)
        frames.append({
            "delay_ms": 10 * delay, "disposal": disposal, "left": left, "top": top, "width": w, "height": h,
            "samples": plane.tobytes(), "histogram": np.bincount(bins.ravel(), minlength=BINS).tolist(),
        })
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            shown = before
        delay, disposal, clear_index = 0, 0, None


def whole_frames(media: bytes | None) -> list[dict] | None:
    """The frames of a GIF; null for what isn't a whole one."""
    try:
        return None if media is None else frames_of(media)
    except (ValueError, IndexError, TypeError, struct.error):
        return None


def encode_gif(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all) and `media`, the GIF of the bytes in column `payload`."""
    added = T.StructType([T.StructField("media", T.BinaryType())])
    return append_columns(df, payload, keep, added, lambda: lambda x: [pa.array([gif_of(p or b"") for p in x.to_pylist()], pa.binary())])


def decode_gif(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all) and `frames`, an array of timed frames with samples and colour histogram."""
    added = T.StructType([T.StructField("frames", T.ArrayType(FRAME))])
    kind = pa.list_(pa.struct([
        *((n, pa.int32()) for n in ("delay_ms", "disposal", "left", "top", "width", "height")), ("samples", pa.binary()), ("histogram", pa.list_(pa.int32())),
    ]))

    return append_columns(df, media, keep, added, lambda: lambda x: [pa.array([whole_frames(m) for m in x.to_pylist()], kind)])


def read_samples(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all), `frames_n`, `samples` (all frames' together) and `histogram` (the sum of theirs); null as for `decode_gif`."""
    added = T.StructType([T.StructField("frames_n", T.IntegerType()), T.StructField("samples", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.IntegerType()))])

    def work(x: pa.Array) -> list[pa.Array]:
        found = [whole_frames(m) for m in x.to_pylist()]
        sums = [None if f is None else np.sum([[0] * BINS, *(g["histogram"] for g in f)], axis=0).tolist() for f in found]
        return [
            pa.array([None if f is None else len(f) for f in found], pa.int32()),
            pa.array([None if f is None else b"".join(g["samples"] for g in f) for f in found], pa.binary()),
            pa.array(sums, pa.list_(pa.int32())),
        ]

    return append_columns(df, media, keep, added, lambda: work)


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as GIFs and read back: sizes, digests and a feature of the frames' colour histograms."""
    raw = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("payload"))
    raw = raw.withColumn("n_bytes", F.length("payload").cast("long"))
    back = read_samples(encode_gif(raw, "payload", keep=["doc_id", "n_bytes"]))
    return back.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("frames_n").cast("string"), F.array_join("histogram", ",")).alias("feature"),
    )
