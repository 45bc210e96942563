"""WARC archives of pages: a gzip member a record, revisit records for repeated payloads, a splittable reader.

Writing: payload digests and, for payloads of ``least`` bytes or more, the smallest page id of each
digest come from an aggregate with map-side sums and one join; each task then writes one archive.
Reading: archives are cut into byte ranges; a task looks in its range for the gzip magic, takes a
candidate for a record if its first bytes decode to a WARC version line, and owns every record that
starts inside its range, reading on behind its end for the last one.  Members follow each other, so
after the first record of a range only true starts are met.  Whatever breaks this chain is damage and an
error: a record that does not decode to its end, a gap behind a record, an archive shorter than written.

Null html counts as the empty payload.  A null page id writes a record without one; it never is the
response that others refer to unless all of its payload have none, when all are responses.  Rows that
share the smallest page id of a payload are all responses.  A null url is left out.  Repeated rows
repeat; no rows give no archives and an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, slices, table
from .files import AttemptFile, open_input, remove_folder

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class Archive:
    path: str
    size: int
    n_records: int


def record_kinds(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id as string, url, payload, digest, refers_to as string or null) for every page."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    read = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = read.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = read.join(shared.select("digest", "first"), "digest", "left")
    other = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    return joined.select(F.col("page").cast("string").alias("page"), "url", "payload", "digest", other.alias("refers_to"))


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = f"{RECORD_ID}{quote(page, safe='')}" if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {CONTROL.sub(lambda m: quote(m[0]), url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{quote(refers_to, safe='')}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(pages: DataFrame, folder: str, least: int = 100, date: str = "1970-01-01T00:00:00Z", **columns: str) -> list[Archive]:
    """Writes all pages, an archive a task; returns what was written, an entry a file."""

    def run(batches):
        from pyspark import TaskContext

        file, n = None, 0
        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                file = file or AttemptFile(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.gz")
                file.write(gzip_member(record(*row, date)))
                n += 1
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.path]), pa.array([file.size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "n_records"])

    kinds = record_kinds(pages, least, **columns)
    return [Archive(*r) for r in kinds.mapInArrow(run, "path string, size long, n_records long").collect()]


def members(f, start: int, end: int, chunk: int = 1 << 20, whole: bool = False):
    """Decoded records whose gzip member starts at a byte from start to end - 1 of an open file.

    With whole, the file holds members alone, and anything else raises ValueError.
    """
    f.seek(start)
    data, base, at, due = bytearray(f.read(end - start)), start, 0, whole and start == 0
    if whole and len(data) < end - start:
        raise ValueError(f"the archive ends at {base + len(data)}, before {end}")

    def more() -> bool:
        f.seek(base + len(data))
        new = f.read(chunk)
        data.extend(new)
        return bool(new)

    while True:
        if due:  # a record has to begin right here, or the archive to end
            while len(data) < at + len(GZIP) and more():
                pass
            if len(data) > at and data[at : at + len(GZIP)] != GZIP:
                raise ValueError(f"no record at byte {base + at}")
            if len(data) <= at:
                return
        at = data.find(GZIP, at)
        if at < 0:
            # The magic of a member that starts inside may end outside.
            tail = next((n for n in (2, 1) if len(data) >= n and data[-n:] == GZIP[:n]), 0)
            if not tail or base + len(data) - tail >= end or not more():
                return
            at = len(data) - tail if len(data) < tail else max(0, end - base - tail)
            continue
        own = base + at < end
        if not own and not due:
            return
        inflate, out, head, fed, sound = zlib.decompressobj(31), [], b"", at, True
        while sound and not inflate.eof and (own or len(head) < 7):  # the next range's first record: its front alone
            if fed >= len(data) and not more():
                sound = False
                break
            piece = data[fed : fed + chunk]
            try:
                out.append(inflate.decompress(piece))
            except zlib.error:
                sound = False
                break
            fed += len(piece)
            head += out[-1][: 7 - len(head)]
            sound = VERSION.startswith(head[:7])
        if sound and head == VERSION and not own:
            return
        if sound and head == VERSION:
            yield b"".join(out)
            at, due = fed - len(inflate.unused_data), whole
        elif whole and (due or head == VERSION):
            raise ValueError(f"the record at byte {base + at} is damaged")
        else:
            at += 1


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if fields.get("warc-block-digest") not in (None, f"sha256:{hashlib.sha256(block).hexdigest()}"):
        raise ValueError(f"the block of {fields.get('warc-record-id')} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    return {"fields": fields, "http": inner, "payload": payload}


def _page(uri: str | None) -> str | None:
    inside = (uri or "").strip("<>")
    return unquote(inside.removeprefix(RECORD_ID)) if inside.startswith(RECORD_ID) else None


def read_archives(spark: SparkSession, archives: list[Archive], split_bytes: int = 16 << 20) -> DataFrame:
    """Records of archives: page_id and refers_to as strings, url, record_type, payload_bytes, payload_digest, payload (null for revisits)."""
    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    splits = [(a.path, i, min(a.size, i + split_bytes)) for a in archives for i in range(0, a.size, split_bytes)]
    if not splits:
        return spark.createDataFrame([], schema)
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def row(raw: bytes) -> tuple:
        r = parse(raw)
        f, revisit = r["fields"], r["fields"]["warc-type"] == "revisit"
        digest = f["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(r["payload"]).hexdigest()
        return (_page(f.get("warc-record-id")), f.get("warc-target-uri"), f["warc-type"], int(r["http"]["content-length"]) if revisit else len(r["payload"]), digest, _page(f.get("warc-refers-to")), None if revisit else r["payload"])

    def run(batches):
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open_input(path) as f:
                    rows = []
                    for raw in members(f, start, end, whole=True):
                        rows.append(row(raw))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.sparkContext.parallelize(splits, len(splits)).toDF("path string, start long, end long").mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    read = read_archives(spark, write_archives(table(spark, sf_dir, "pages"), folder))
    out = cut(read.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")))
    remove_folder(folder)
    return out


ORACLES = {
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d"""
}
QUERIES = {"op10_warc": op10_warc}
