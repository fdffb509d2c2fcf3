"""WARC archives: writing with revisit records and segments, reading with segment reassembly.

Writing: each row becomes an HTTP response with chunked transfer framing.  Of rows with equal payloads
of at least ``REVISIT_BYTES`` bytes the largest id is written as ``response`` and the others as
``revisit`` records without a body.  A block of over ``SEGMENT_BYTES`` bytes is written as a first
segment and ``continuation`` records that name the first by ``WARC-Segment-Origin-ID``; the last one
gives the total length.  So no record is large, and a file of ``FILE_RECORDS`` records has a size bound
whatever the payloads.  Files are written by Spark (gzip) to any folder that Spark can write.

Reading: records are parsed file by file, grouped by origin (and writer's copy number), ordered by
segment number, joined, checked against the total length, freed of the chunked framing and checked
against the payload digest.  ``status`` is ``ok`` or says what is wrong; nothing is dropped.

Edge cases: a null payload counts as empty; a null url has no target header; a null id is written
without one and read as null, and is smaller than any other id; repeated rows are written and read as
often as they occur, and all rows of the largest id of a group are responses; extra columns are
ignored; an empty table gives an archive without records, and reading it an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.llm.common import python_tasks, stored

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
FILE_RECORDS = 1500  # a file is below 1500 * 17 KB before compression
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PARSED = ("origin string, copy string, segment int, total bigint, type string, uri string, "
           "refers_to string, digest string, block binary")
_READ = ("record_id string, target_uri string, record_type string, refers_to string, segments int, "
         "payload binary, payload_bytes bigint, payload_digest string, status string")


def chunked(payload: bytes) -> bytes:
    parts = [payload[i:i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at:at + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[end + 2:at])
        at += 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _records(rid, url, payload, refers, digest, size, copy: str, date: str) -> Iterator[bytes]:
    name = f"<urn:page:{'' if rid is None else rid}>"
    common = [("WARC-Date", date), ("X-Copy", copy)] + ([] if url is None else [("WARC-Target-URI", _uri(url))])
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", _PROFILE),
                       ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Payload-Digest", sha),
                       ("Content-Type", "application/http;msgtype=response")],
                      (http + f"Content-Length: {size}\r\n\r\n").encode())
        return
    block = (http + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", sha),
             ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= SEGMENT_BYTES:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", "1")], block[:SEGMENT_BYTES])
    for k, at in enumerate(range(SEGMENT_BYTES, len(block), SEGMENT_BYTES), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + SEGMENT_BYTES >= len(block) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), *common,
                       ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *last],
                      block[at:at + SEGMENT_BYTES])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    spark = pages.sparkSession
    python_tasks(spark)
    data = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), data.alias("data"))
    known = rows.where(F.length("data") >= REVISIT_BYTES).groupBy(F.sha2("data", 256).alias("key")).agg(
        F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "keep")
    known = stored(known, "warc-known")
    todo = rows.withColumn("key", F.sha2("data", 256)).join(known, "key", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("id"))
    todo = todo.select("id", "url", F.when(~revisit, F.col("data")).alias("data"),
                       F.when(revisit, F.col("keep")).alias("refers"), F.sha1("data").alias("digest"),
                       F.length("data").cast("bigint").alias("size"), F.monotonically_increasing_id().alias("copy"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for r in batch.to_pylist():
                out += _records(r["id"], r["url"], r["data"], r["refers"], r["digest"], r["size"], str(r["copy"]), date)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = todo.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", _END.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4:at]
        at += 4


def _inflate(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("origin", pa.string()), ("copy", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
                        ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
                        ("block", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in parse_records(_inflate(content.as_py())):
                if h["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                total = h.get("warc-segment-total-length")
                rows.append({"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "copy": h.get("x-copy", ""),
                             "segment": int(h.get("warc-segment-number", 0)), "total": None if total is None else int(total),
                             "type": h["warc-type"], "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
                             "digest": h.get("warc-payload-digest"), "block": block})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _assemble(rows: list[dict]) -> dict:
    """One record of its segments, which come in order."""
    first, status = rows[0], "ok"
    block = b"".join(r["block"] for r in rows)
    numbers = [r["segment"] for r in rows]
    if first["type"] == "continuation" or numbers not in ([0], list(range(1, len(rows) + 1))):
        status = "segment missing"
    elif numbers != [0] and rows[-1]["total"] != len(block):
        status = "length differs"
    head, _, body = block.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    digest = None
    if first["digest"]:
        value = first["digest"].rpartition(":")[2]
        digest = value.lower() if len(value) == 40 else base64.b32decode(value).hex()
    payload = size = None
    if first["type"] == "revisit":
        size = int(fields.get(b"content-length", b"0"))
    elif status == "ok":
        try:
            payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
            size, found = len(payload), hashlib.sha1(payload).hexdigest()
            if digest not in (None, found):
                status = "digest differs"
            digest = found
        except ValueError:
            status = "framing broken"
    return {"record_id": first["origin"], "target_uri": first["uri"], "record_type": first["type"],
            "refers_to": first["refers_to"], "segments": len(rows), "payload": payload, "payload_bytes": size,
            "payload_digest": digest, "status": status}


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.string()), ("segments", pa.int32()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string())])
    group: list[dict] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if group and (row["origin"], row["copy"]) != (group[0]["origin"], group[0]["copy"]):
                out.append(_assemble(group))
                group = []
            group.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if group:
        yield pa.RecordBatch.from_pylist([_assemble(group)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a response or revisit record: ids, payload (null for revisits), full payload's length and digest."""
    python_tasks(spark, 200)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = files.mapInArrow(_parse_files, _PARSED)
    dealt = parsed.repartition("origin", "copy").sortWithinPartitions("origin", "copy", "segment")
    return dealt.mapInArrow(_join_segments, _READ)


def page_number(record_id: str):
    """The id in ``<urn:page:ID>``, null if it has none."""
    return F.regexp_extract(F.col(record_id), r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
