"""WARC archives: a writer that stores each payload once, and a salvage reader.

Each record is a gzip member. Spark's text writer puts the bytes into the shared store (its line separator, a zero byte,
is the last byte of every member under 16 MiB; a longer one is followed by an empty member). The reader checks each member, its
record and its digests. Where a check fails it searches for the next gzip member or version line that holds a valid record,
goes on from there, and logs the bytes between as a quarantined gap."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.storage import stored

CHUNK_BYTES, CHUNKS_A_FILE, LEVEL = 8 << 20, 4, 4
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
EMPTY_MEMBER = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
READ = (
    "kind string, file string, offset long, length long, reason string, record_id string, record_type string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes long, payload binary, inner long, inner_length long"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hex digits are four digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record, or a revisit record of ``refers_to`` that has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(batches):
    held, size = [], 0

    def chunk():
        data = b"".join(held)
        if data[-1]:
            data += EMPTY_MEMBER
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
        for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
            held.append(member(record(page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py())))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes ``pages`` (page_id, url, html) as archives in the folder ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest page_id is the response and the
    others revisit it; repeated rows of that page_id are all responses, as are smaller payloads. A null html is an empty payload, a
    null url gives no target. A null page_id is never the largest: it revisits the group's, or is a response if none has
    an id. The largest id by digest is combined before the shuffle, and the skewed join is left to AQE, which splits a hot
    payload's rows. Other columns aren't read; an empty table gives a folder without records."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("largest"))
    revisit = (F.length("payload") >= min_revisit_bytes) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    joined = rows.join(largest, "digest").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("largest")).alias("refers_to"))
    chunks = joined.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    chunks.write.option("lineSep", "\x00").option("maxRecordsPerFile", CHUNKS_A_FILE).text(path)


# ---------------------------------------------------------------- reading
def _inflate(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """What a gzip member holds, its end, and if it is whole and its checksum right."""
    unpacker, parts, begin = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and at < len(data):
            piece = data[at : at + 16384]
            parts.append(unpacker.decompress(piece))
            at += len(piece)
    except zlib.error:
        return b"".join(parts), begin + 1, False
    return b"".join(parts), max(at - len(unpacker.unused_data), begin + 1), unpacker.eof


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int] | str:
    """The record at a place and its end, or what is wrong with it. Headers are read line by line, so a false version line costs little."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    fields, begin = {}, version.end()
    while (end := data.find(b"\r\n", begin)) != begin:
        if end < 0:
            return "headers don't end"
        name, colon, value = data[begin:end].partition(b":")
        if not colon:
            return "header without colon"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        begin = end + 2
    size = fields.get("content-length", "")
    if not size.isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
        return "required header missing"
    begin, end = begin + 2, begin + 2 + int(size)
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        return "truncated block"
    block = data[begin:end]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{_sha1(block)}":
        return "block digest differs"
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)\ncontent-length: *(\d+)", http)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind == "response" and digest and digest != f"sha1:{_sha1(payload)}":
        return "payload digest differs"
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "target_uri": fields.get("warc-target-uri"), "payload_digest": digest.removeprefix("sha1:") or None,
        "payload_bytes": int(stated[1]) if stated else len(payload), "payload": payload if kind != "revisit" else None, "checked": "warc-block-digest" in fields,
    }, end + 4


def _plain_rows(data: bytes, whole: bool):
    """Rows of the records in plain bytes and the gaps between them. Of bytes whose own check failed, only records with a block digest count."""
    at, gap, why = 0, None, None
    while at < len(data):
        got = parse_record(data, at)
        if not isinstance(got, str) and not whole and not got[0]["checked"]:
            got = "no digest in a member that fails its check"
        if isinstance(got, str):
            gap, why = (at, got) if gap is None else (gap, why)
            later = VERSION.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
            gap = None
        yield {"kind": "record", "offset": at, "length": got[1] - at, **{k: v for k, v in got[0].items() if k != "checked"}}
        at = got[1]
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": why}


def salvage(data: bytes):
    """Rows of a whole archive: records, and the gaps that no valid record covers.

    Offsets and lengths are of the archive; for records and gaps inside a gzip member they are the member's, with ``inner`` and
    ``inner_length`` of its plain bytes if it holds more than one record. After a failed check the search goes on at the
    next place that could start a member or a record, in the archive and within a member alike. Of a damaged member the records
    before the damage are recovered if their block digests are right; its bytes up to the next valid record are a gap all the same."""
    view, at, gap, why = memoryview(data), 0, None, None
    while at < len(data):
        rows, end = [], at
        if data[at : at + 3] == MAGIC:
            plain, end, whole = _inflate(view, at)
            rows = list(_plain_rows(plain, whole))
            recovered = [r for r in rows if r["kind"] == "record"]
            good = whole and (bool(recovered) or not plain)
            single = good and len(rows) == 1
            rows = [r | {"offset": at, "length": end - at if good else 0} | ({} if single else {"inner": r["offset"], "inner_length": r["length"]}) for r in (rows if good else recovered)]
            fault = None if good else "no record in the member" if whole else "member fails its check"
        else:
            got = parse_record(data, at)
            fault = got if isinstance(got, str) else None
            if fault is None:
                end = got[1]
                rows = [{"kind": "record", "offset": at, "length": end - at, **{k: v for k, v in got[0].items() if k != "checked"}}]
        if fault is not None:
            gap, why = (at, fault) if gap is None else (gap, why)
            yield from rows
            later = START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
            gap = None
        yield from rows
        at = end
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": why}


def _read(with_payload: bool):
    names = [x.split()[0] for x in READ.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in READ.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in salvage(content.as_buffer().to_pybytes()):
                    if not with_payload:
                        row.pop("payload", None)
                    rows.append(row | {"file": path.as_py()})
                    size += len(row.get("payload") or b"") + 500
                    if size > CHUNK_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of every archive under ``path``: kind ``record`` with its fields, or ``gap`` with file, offset, length and reason.

    Files may be gzip members of one or more records, plain records, or damaged mixtures of both; an empty file has no rows. A record is
    given only if its framing and digests are right. Each file is read whole by one task, so writers should bound file sizes. A plain
    record within the payload of a damaged plain record can't be told from a record of the archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), READ)


def salvage_archives(spark: SparkSession, path: str, log: str, with_payload: bool = True) -> DataFrame:
    """The records of ``read_archives``; the archives are read once, and the quarantined gaps are written to the JSON table ``log`` (file, offset,
    length, reason, inner, inner_length), which is empty if there are none."""
    read = stored(read_archives(spark, path, with_payload), "warc-read")
    read.where("kind = 'gap'").select("file", "offset", "length", "reason", "inner", "inner_length").coalesce(1).write.json(log)
    return read.where("kind = 'record'")


_ID = "nullif(substring_index({}, ':', -1), 'null')"


def page_records(read: DataFrame) -> DataFrame:
    """The records of pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.expr(_ID.format(c)).cast("long")
    return read.where("kind = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(t) AS n, max(page_id) OVER (PARTITION BY h) AS m, array_to_string(list_transform(range(0, 32), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS digest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to FROM d"""
