"""WARC archives: writing with segmented records, reading with reassembly (operator 9).

Writing.  A page is a ``response`` record whose block is an HTTP response with
a chunked body.  Of pages with equal payloads of at least ``REVISIT_BYTES``
bytes, the one with the largest page_id is the response and the others are
``revisit`` records without a body.  A block over ``SEGMENT_BYTES`` is cut into
a first segment and ``continuation`` records, which name the first record's id
and their number; the last gives the total length.  The archives are gzip files
of about ``ARCHIVE_BYTES``, written by Spark's text writer (records are cut
between characters, so each is valid UTF-8).

Reading.  Each archive is parsed by content lengths.  Whole records are decoded
at once; segments are grouped by the origin's id, ordered by number, checked
against the total length, joined, and then freed of the chunk framing.  Only
segments are shuffled, and a group is one page's payload.

Defined results: a null or empty html is an empty payload; repeated rows of one
page_id are one record each, alike; a null page_id is written as a record
without a page, and refers to or is referred to by nothing with a page_id;
control characters in a url become blanks; further columns are ignored.  A
record that is incomplete or whose digest doesn't fit has valid = false.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, ship_package

REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 1000, 8192, 4096, 32 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]+")


def cuts(data: bytes, size: int):
    """Pieces of at most ``size`` bytes (at least one character) that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:     # size is less than one character
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError, if the framing is broken or cut off."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[line + 2 + size: line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[line + 2: line + 2 + size])
        at = line + 4 + size


def _record(kind: str, record_id: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"   # the writer ends the line


def records(page_id, url, payload: bytes, digest: str, refers_to=None):
    """The records of one page, as bytes without the last line end."""
    name = f"urn:page:{'none' if page_id is None else page_id}:{digest}"
    common = [("WARC-Target-URI", _CONTROL.sub(" ", url) if url else None), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", name, [*common, ("WARC-Profile", _PROFILE),
                                        ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")], head)
        return
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(payload))
    parts = list(cuts(block, SEGMENT_BYTES))
    if len(parts) == 1:
        yield _record("response", name, common, block)
        return
    yield _record("response", name, [*common, ("WARC-Segment-Number", 1)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"{name}:{i}", [
            ("WARC-Segment-Number", i), ("WARC-Segment-Origin-ID", f"<{name}>"),
            ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part)


def _write(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                out += [r.decode() for r in records(page, url, html.encode(), digest, refers)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Write a record per row of ``pages`` to gzip archives under ``path``."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sizes = materialize(rows.select("id", F.octet_length("html").cast("long").alias("bytes"),
                                    F.sha1(F.col("html").cast("binary")).alias("digest")), "payloads")
    # the response of each payload; combined before the shuffle, so a payload of a third of all pages is few rows
    origin = (sizes.where(f"bytes >= {REVISIT_BYTES}").groupBy("digest")
              .agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    revisit = sizes.join(origin, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    # dealt once, into as many partitions as archives, in the way that the join needs
    n = max(1, -(-total // ARCHIVE_BYTES))
    (rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).repartition(n, "id", "digest")
     .join(revisit.repartition(n, "id", "digest").hint("shuffle_hash"), ["id", "digest"], "left")
     .select("id", "url", "html", "digest", "refers_to")
     .mapInArrow(_write, "value string")
     .write.option("lineSep", "\r\n").option("compression", "gzip").text(path))


def parse(data: bytes):
    """(headers, block) of each record of an archive; ValueError, if it is broken off."""
    at = 0
    while at < len(data):
        if data[at: at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start, length = end + 4, int(headers["Content-Length"])
        if data[start + length: start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is broken off")
        yield headers, data[start: start + length]
        at = start + length + 4


_OUT = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()),
                  ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("valid", pa.bool_()), ("payload", pa.binary()), ("segment", pa.int32()), ("origin", pa.string()),
                  ("total", pa.int64()), ("block", pa.binary())])
_DDL = ("record_id string, record_type string, refers_to_id string, declared string, payload_bytes long, "
        "payload_digest string, valid boolean, payload binary, segment int, origin string, total long, block binary")


def _decoded(block: bytes, declared: str, keep: bool) -> dict:
    """Digest, length and payload of a whole response block."""
    try:
        head, body = block.split(b"\r\n\r\n", 1)
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return {"valid": False}
    digest = hashlib.sha1(payload).hexdigest()
    return {"payload_bytes": len(payload), "payload_digest": digest, "valid": digest == declared,
            "payload": payload if keep else None}


def _reader(keep: bool, segments: bool):
    """The segments of archives, or their whole records, decoded."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for h, block in parse(gzip.decompress(content.as_py())):
                    if segments != ("WARC-Segment-Number" in h):
                        continue
                    row = {"record_id": h["WARC-Record-ID"][1:-1], "record_type": h["WARC-Type"],
                           "declared": h.get("WARC-Payload-Digest", "")[5:]}
                    if segments:
                        row |= {"segment": int(h["WARC-Segment-Number"]), "block": block,
                                "origin": h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])[1:-1],
                                "total": int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None}
                    elif row["record_type"] == "revisit":
                        length = re.search(rb"(?i)content-length: *([0-9]+)", block)
                        row |= {"refers_to_id": h["WARC-Refers-To"][1:-1], "payload_digest": row["declared"],
                                "payload_bytes": int(length[1]) if length else None, "valid": bool(length)}
                    else:
                        row |= _decoded(block, row["declared"], keep)
                    out.append(row)
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)
    return run


def _joiner(keep: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["parts"]
                whole = b"".join(p["block"] for p in parts)
                fits = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and row["total"] == len(whole)
                got = _decoded(whole, row["declared"], keep) if fits else {"valid": False}
                one = {"record_id": row["origin"], "record_type": "response", "declared": row["declared"]} | got
                yield pa.RecordBatch.from_pylist([one] * max(row["copies"], 1), schema=_OUT)
    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, record_type, refers_to_id, payload_bytes, payload_digest, valid, payload of each record.

    ``payloads=False`` checks and measures the payloads without returning them.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    # two passes over the (compressed) archives cost less than a written table of all blocks
    parts = (files.mapInArrow(_reader(payloads, True), _DDL).groupBy("origin")
             .agg(F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
                  F.max(F.when(F.col("segment") == 1, F.col("declared"))).alias("declared"),
                  F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("copies"))
             .select("origin", "parts", "total", "declared", "copies"))
    joined = parts.mapInArrow(_joiner(payloads), _DDL)
    columns = ["record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest", "valid", "payload"]
    return files.mapInArrow(_reader(payloads, False), _DDL).select(*columns).union(joined.select(*columns))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, valid."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    page = r"^urn:page:(-?[0-9]+):"
    return read_archives(spark, path, payloads=False).select(
        F.regexp_extract("record_id", page, 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.regexp_extract("refers_to_id", page, 1).try_cast("long").alias("refers_to"), "valid")
