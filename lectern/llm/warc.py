"""WARC archives: a writer, and a sequential reader.

One gzip member per record.  The reader takes an archive as a byte stream: it inflates each member incrementally in
64 KB slices, parses the record head, frames the block by its Content-Length and checks the payload digest.

Records of equal payload (of ``revisit_min_bytes`` bytes or more): the one with the largest page_id is the response,
others are revisits that refer to it and carry no payload.

Archives are real ``.warc.gz`` byte streams, written through Spark's own writer (so to any store it can write): each
member is one line of the text writer with NUL as the separator; a member ends in NUL itself unless its record has 16 MB
or more, and then that NUL is left to the separator.  (After larger records one pad byte follows, which readers skip.)

Defined cases: null html is an empty payload; null url is an empty target; a null page_id is written as ``none`` and
never the response of a group that has an id; rows that repeat the largest page_id are all responses; an empty table
gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shared_path, table, utf8

SLICE = 1 << 16
RECORDS_PER_ARCHIVE = 1000
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, valid boolean"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record as one gzip member."""
    digest, name = b32_sha1(payload), "none" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def members(archive):
    """Inflated records of an archive, one gzip member at a time."""
    view, at, size = memoryview(archive), 0, len(archive)
    while at < size:
        if view[at] == 0:  # padding between members
            at += 1
            continue
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < size:
            piece = view[at : at + SLICE]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if not z.eof:
            raise ValueError("truncated gzip member")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC head, HTTP head, payload) of a record, framed by Content-Length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("record framing broken")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _urn(value: str | None):
    name = value[len("<urn:page:") : -1] if value else "none"
    return None if name == "none" else int(name)


def read_archive(archive) -> list[tuple]:
    """Rows of ``_FIELDS``; a response whose payload doesn't match its digest or length is not valid."""
    rows = []
    for data in members(archive):
        f, _, payload = parse(data)
        digest, length, kind = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"]), f["warc-type"]
        valid = kind == "revisit" and not payload or (len(payload) == length and b32_sha1(payload) == digest)
        rows.append((_urn(f["warc-record-id"]), length, digest, kind, _urn(f.get("warc-refers-to")), f.get("warc-target-uri"), valid))
    return rows


def _write(batches):
    for b in batches:
        out = [
            record(p, u, h, None if r is None or r == p else r)
            for p, u, h, r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "response")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([m[:-1] if m[-1] == 0 else m for m in out], pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, revisit_min_bytes: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write every page as a record into ``.warc.gz`` streams under ``path``."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload"))
    key = F.sha2("payload", 256)
    # Counts meet before the shuffle; only groups of two or more are joined back, and a hot payload's join can be split.
    groups = rows.where(F.octet_length("payload") >= revisit_min_bytes).groupBy(key.alias("digest")).agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("digest", "response")
    planned = rows.withColumn("digest", key).join(groups, "digest", "left")
    binary = planned.select("page_id", "url", "payload", "response").mapInArrow(_write, "member binary")
    binary.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", records_per_archive).text(path)


def _read(batches):
    for b in batches:
        for archive in b["content"]:
            rows = read_archive(archive.as_buffer())
            for i in range(0, len(rows), 5000):
                cols = list(zip(*rows[i : i + 5000], strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in _FIELDS.split(", ")])


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of all archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(_read, _FIELDS)


def op2_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
g AS (SELECT *, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to, url, true AS valid
FROM g
"""
