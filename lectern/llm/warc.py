"""Operator 3: WARC archives, written and read back as one nested row for each capture.

Each page becomes a request, a response (or a revisit of the response with the same
payload) and a metadata record, tied by WARC-Concurrent-To. A record is a gzip member
of its own. Files are written, and committed, by Spark's text writer with a zero byte as
line end: a member's last byte is the highest of its size's four, zero below 16 MB, and
is left to the writer; a larger record is followed by an empty member, whose last byte is
zero again, so files are gzip members and nothing else.

Reading inflates one member after the other in slices of SLICE bytes, so work and memory
grow with the records, not with the square of the archive; archives that aren't
compressed are read as well. Spark hands over an archive as one row, at most 2 GB (the
format recommends 1 GB); `captures_a_file` bounds those written here.

Captures are assembled by joining responses and revisits with the records tied to them
through concurrent-to identifiers, whichever of the two names the other; the header may
be repeated, and a record tied to several captures is in each.

Defined results: a null payload counts as empty; a null url leaves out the target URI;
blanks and control characters in a url are percent-encoded; rows with the same page id
and payload as a response are revisits of it, but for the first; a null page id sorts
after others and reads back as null; records tied to no response or revisit are given in
a row with a null record_type for each identifier they name, or of their own with a null
capture_id; records of other types than these four are no part of a capture; payloads of
any length are kept whole; an empty table gives no archive and no rows; other columns
are ignored, whatever their names. `pages` should be a stored table: rows are told apart
by their place in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.scratch import forget, new_path, written

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES_A_FILE = 1000
#: Bytes of an archive that are inflated at a time.
SLICE = 1 << 14
RECORDS = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "payload_digest string, http_head string, fields string, payload_bytes long, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits at a time are four digits to the base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), digits, letters)


def captures(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """Pages with what their records need; `first` is the row whose response others with its payload revisit.

    Only payloads that occur more than once are in the table that the join adds.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("o")).where("n > 1").select("key", F.col("o.row").alias("first"))
    shared = written(shared, "shared-payloads")  # cut off from its aggregate, so that the join can split large partitions
    return rows.join(shared, "key", "left").withColumn("first", F.coalesce("first", "row")).withColumn("digest", base32_sha1(F.col("payload")))


def record_id(key: bytes, row: int, role: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(key + f'|{row}|{role}'.encode()).digest()[:16])}>"


def zipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member, with an empty one behind it if it is large, without the zero byte at the end."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    member = zipped(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n")
    return (member if member[-1] == 0 else member + zipped(b""))[:-1]


def records_of(page_id: int | None, url: str | None, payload: bytes, row: int, key: bytes, first: int, digest: str) -> list[bytes]:
    uri = None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))
    role = "response" if first == row else "revisit"
    own = record_id(key, row, role)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    parts = urlsplit(uri) if uri and re.match(r"https?://[^\[\]]*$", uri) else None
    path = f"{parts.path or '/'}{'?' + parts.query if parts.query else ''}" if parts else "/"
    ask = f"GET {path} HTTP/1.1\r\nHost: {parts.netloc if parts else ''}\r\n\r\n".encode()
    main = [("WARC-Type", role), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if role == "revisit":
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(key, first, "response"))]
    main.append(("Content-Type", "application/http;msgtype=response"))
    side = lambda kind, mime: [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, row, kind)), *common, ("WARC-Concurrent-To", own), ("Content-Type", mime)]
    return [
        record(side("request", "application/http;msgtype=request"), ask),
        record(main, head + payload if role == "response" else head),
        record(side("metadata", "application/warc-fields"), f"page-id: {'' if page_id is None else page_id}\r\n".encode()),
    ]


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", captures_a_file: int = CAPTURES_A_FILE) -> None:
    """Write the archives of `pages` below `path`."""

    def build(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at in range(0, batch.num_rows, 256):
                out = [r for row in zip(*(c[at : at + 256] for c in columns)) for r in records_of(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = captures(pages, page_id, url, payload).select("page_id", "url", "payload", "row", "key", "first", "digest")
    members = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", 3 * captures_a_file).text(path)


def members(content: bytes) -> Iterator[bytes]:
    """What the gzip members of an archive inflate to, one by one; an archive that isn't compressed as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            part = view[at : at + SLICE]
            if not len(part):
                raise ValueError("an archive that ends within a record")
            parts.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        yield b"".join(parts)
        while at < len(view) and view[at] == 0:  # padding, which gzip readers skip
            at += 1


def parse(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """The records of one archive: (values of each header by lower-case name, block)."""
    for data in members(content):
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers: dict[str, list[str]] = {}
            for line in lines[1:]:
                name, _, value = line.partition(":")
                headers.setdefault(name.strip().lower(), []).append(value.strip())
            size = int(headers["content-length"][0])
            yield headers, data[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def fields_of(headers: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    """A record's columns, in the order of RECORDS."""
    one = lambda name: headers.get(name, [None])[0]
    kind = one("warc-type")
    head, body, fields, size, digest = None, None, None, None, None
    if kind in ("response", "revisit", "request"):
        top, _, body = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8", "replace")
    if kind == "response":
        size = len(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    elif kind == "revisit":
        body = None
        digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    ties = headers.get("warc-concurrent-to", [])
    return (one("warc-record-id"), kind, ties, one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), digest, head, fields, size, body if payloads else None)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives below `path`; without `payloads` their bytes are left out, not their sizes and digests."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = (fields_of(h, block, payloads) for h, block in parse(content.as_py()))
                while held := list(islice(records, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(build, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, record_type, target_uri, response, requests and metadata.

    `records` should be a stored table, since it is read for each direction of the ties. Requests and metadata that name
    a capture are sent to it as they are; those that a capture names meet its identifier first. All then meet in one
    shuffle. A capture's records are few by the format.
    """
    main = F.col("type").isin("response", "revisit")
    side = F.struct("record_id", "type", "http_head", "fields")
    response = F.struct("type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "http_head", "payload")
    of_main = records.where(main).select(F.col("record_id").alias("capture_id"), response.alias("response"), F.when(~main, side).alias("side"))
    sides = records.where(F.col("type").isin("request", "metadata"))
    ties = records.where(main & (F.size("concurrent_to") > 0)).select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id"))
    met = sides.join(ties.distinct(), "record_id", "left")
    to = F.array_distinct(F.array_compact(F.concat("concurrent_to", F.array("capture_id"))))
    of_side = met.select(F.explode_outer(to).alias("capture_id"), F.when(F.lit(False), response).alias("response"), side.alias("side"))
    of_side = of_side.withColumn("alone", F.when(F.col("capture_id").isNull(), F.col("side.record_id")))
    collect = lambda kind, *cols: F.transform(
        F.filter("sides", lambda s: s.type == kind), lambda s: F.struct(s.record_id.alias("record_id"), *(s[c].alias(c) for c in cols))
    )
    return (
        of_main.withColumn("alone", F.lit(None).cast("string")).unionByName(of_side)
        .groupBy("capture_id", "alone")
        .agg(F.first("response", ignorenulls=True).alias("response"), F.collect_set("side").alias("sides"))
        .select(
            "capture_id", F.col("response.type").alias("record_type"), F.col("response.target_uri").alias("target_uri"), "response",
            collect("request", "http_head").alias("requests"), collect("metadata", "fields").alias("metadata"),
        )
    )


def read_back(pages: DataFrame) -> DataFrame:
    """Archive `pages` in the shared folder, read the archives back and resolve revisits: one row for each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    page_id = F.expr("nullif(regexp_extract(metadata[0].fields, 'page-id: ([-0-9]*)', 1), '')").cast("long")
    records = written(read_warc(spark, path, payloads=False), "records")  # narrow; the archives are then read once
    found = assemble(records).select(
        "capture_id", page_id.alias("page_id"), "record_type", "target_uri", F.col("response.refers_to").alias("refers"),
        F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("payload_digest"),
    )
    found = written(found, "captures")
    forget(records)
    responses = found.where("record_type = 'response'")
    origin = responses.select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("of_response"))
    revisits = found.where("record_type <> 'response'").drop("bytes").join(origin, "refers", "left").withColumnRenamed("of_response", "bytes")
    out = ["page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(revisits.select(*out))
