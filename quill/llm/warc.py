"""WARC archives: write, normalise monolithic gzip files, index, read back.

* ``write_archives`` builds records with built-in functions and lets Spark's
  text writer compress each file: one gzip stream over the whole file.
* ``normalise`` reads such files (Spark inflates each stream once, in order and
  in constant memory), cuts the stream into records by Content-Length, and
  writes every record as a gzip member of its own.  Between members stands an
  empty member (``GAP``), which readers skip: it is the row separator of
  Spark's writer, so all files go through Spark's commit protocol and may live
  in any store, and a lost executor costs a task attempt and no half file.
* ``index_archives`` walks the members of the normalised files and writes the
  sidecar: file, offset and length of every record with its main headers.
  ``read_record`` fetches one record by its sidecar entry.

Normalised files hold at most ``FILE_RECORDS`` records, which bounds what the
sidecar's reader keeps in memory.

Defined cases: null html is an empty payload; a null url has no
WARC-Target-URI; a null page_id is written as ``null`` and read back as null;
of rows with equal payload and the largest page_id all are responses (repeated
rows); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import materialise, scratch

MIN_REVISIT = 1000
FILE_RECORDS = 5000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An empty gzip member: header, empty final block, zero checksum and size.
GAP = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8
OUT_BATCH = 4 << 20
INDEX_SCHEMA = ("file string, offset long, length long, record_id string, record_type string, target_uri string, "
                "refers_to string, payload_digest string, payload_bytes long, body_digest string, body_bytes long")


# --- writing ------------------------------------------------------------------------------------

def decide_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds payload (binary), n, digest, record_type and refers_to to (page_id, url, html).

    Only digests that occur twice or more take part in the join; they are
    written first, so that their size decides whether they are broadcast.
    """
    p = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    p = p.withColumn("n", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    same = (p.filter(F.col("n") >= min_revisit).groupBy("digest", "n")
            .agg(F.max("page_id").alias("_q_first"), F.count("*").alias("_q_c")).filter("_q_c > 1").drop("_q_c"))
    same = materialise(same, "warc-same")
    p = p.join(same, ["digest", "n"], "left")
    revisit = F.col("_q_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_q_first"))
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("_q_first"))).drop("_q_first")


def _record(page_id, url, payload, n, digest, record_type, refers_to):
    """A whole WARC record without its last line feed, as a binary column."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    uid = lambda c: text("<urn:page:", F.coalesce(c.cast("string"), F.lit("null")), ">")
    body = F.when(record_type == "revisit", F.lit(b"").cast("binary")).otherwise(payload)
    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", n.cast("string"),
                "\r\n\r\n")
    target = F.when(url.isNull(), F.lit("")).otherwise(
        text("WARC-Target-URI: ", F.regexp_replace(url, "[\r\n]", "%0A"), "\r\n"))
    again = F.when(record_type == "revisit", text(
        "WARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: ", uid(refers_to), "\r\n")).otherwise(F.lit(""))
    head = text("WARC/1.1\r\nWARC-Type: ", record_type, "\r\nWARC-Record-ID: ", uid(page_id),
                f"\r\nWARC-Date: {DATE}\r\n", target, "WARC-Payload-Digest: sha1:", digest,
                "\r\nX-Payload-Length: ", n.cast("string"), "\r\n", again,
                "Content-Type: application/http;msgtype=response\r\nContent-Length: ",
                (F.octet_length(http) + F.octet_length(body)).cast("string"), "\r\n\r\n")
    return F.concat(head.cast("binary"), http.cast("binary"), body, F.lit(b"\r\n\r").cast("binary"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One gzip stream a file, a record for every row of (page_id, url, html)."""
    p = decide_types(pages)
    rec = _record(*[F.col(c) for c in ("page_id", "url", "payload", "n", "digest", "record_type", "refers_to")])
    p.select(rec.cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


# --- normaliser ---------------------------------------------------------------------------------

def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def content_length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise ValueError(f"record without Content-Length: {head[:200]!r}")


class RecordCutter:
    """Cuts a stream of lines (without line feeds) into whole records."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0
        self.want = 0

    def feed(self, line: bytes) -> bytes | None:
        if not self.parts and not line.strip():
            return None  # blank lines between records
        self.parts.append(line + b"\n")
        self.size += len(line) + 1
        if not self.want and line == b"\r":
            head = b"".join(self.parts)
            self.want = len(head) + content_length(head) + 4
        if not self.want or self.size < self.want:
            return None
        record = b"".join(self.parts)
        if record[self.want - 4:] != b"\r\n\r\n":
            raise ValueError("record does not end where its Content-Length says")
        self.parts, self.size, self.want = [], 0, 0
        return record

    def end(self) -> None:
        if self.parts:
            raise ValueError("the stream ends inside a record")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter, at, out, size = RecordCutter(), None, [], 0
    for b in batches:
        for line, file in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            if file != at:
                cutter.end()
                at = file
            if (record := cutter.feed(line.as_py())) is not None:
                out.append(member(record))
                size += len(out[-1])
                if size >= OUT_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
    cutter.end()
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def normalise(spark: SparkSession, source: str, target: str, file_records: int = FILE_RECORDS) -> None:
    """Rewrite the gzip streams of ``source`` as files of one member a record in ``target``."""
    lines = spark.read.option("lineSep", "\n").text(source)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    rows = lines.mapInArrow(_rewrite, "value binary").select(F.col("value").cast("string").alias("value"))
    (rows.write.option("lineSep", GAP.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", file_records).text(target))


# --- sidecar index and reading ------------------------------------------------------------------

def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode()] = value.strip().decode()
    return headers, rest[:int(headers["content-length"])]


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the non-empty members."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z = zlib.decompressobj(31)
        record = bytearray()
        pos = at
        while not z.eof:
            if pos >= len(data):
                raise ValueError("the file ends inside a member")
            record += z.decompress(view[pos:pos + (1 << 16)])
            pos += 1 << 16
        end = min(pos, len(data)) - len(z.unused_data)
        if record:
            yield at, end - at, bytes(record)
        at = end


def _unwrap(uid: str | None) -> str | None:
    return None if uid is None else uid.removeprefix("<urn:page:").removesuffix(">")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for offset, length, record in members(content.as_py()):
                h, block = parse_record(record)
                body = block.partition(b"\r\n\r\n")[2]
                rows.append({
                    "file": path, "offset": offset, "length": length, "record_id": _unwrap(h["warc-record-id"]),
                    "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"),
                    "refers_to": _unwrap(h.get("warc-refers-to")),
                    "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    "payload_bytes": int(h.get("x-payload-length", len(body))),
                    "body_digest": hashlib.sha1(body).hexdigest(), "body_bytes": len(body)})
        yield pa.RecordBatch.from_pylist(rows, schema=INDEX_ARROW)


INDEX_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]])
                         for c in INDEX_SCHEMA.split(", ")])


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar of normalised files, as a written table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return materialise(files.mapInArrow(_entries, INDEX_SCHEMA), "warc-index")


def read_record(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at a sidecar entry; only its own member is inflated."""
    return parse_record(zlib.decompress(content[offset:offset + length], 31))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write (page_id, url, html), normalise, index and read back; one row a record.

    ``body_digest`` and ``body_bytes`` are computed from the payload that was
    read; a response whose payload does not have the digest its header states
    fails the job.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    raw, norm = os.path.join(path, "raw"), os.path.join(path, "members")
    write_archives(pages.select("page_id", "url", "html"), raw)
    normalise(spark, raw, norm)
    idx = index_archives(spark, norm)
    is_revisit = F.col("record_type") == "revisit"
    wrong = ~is_revisit & ((F.col("body_digest") != F.col("payload_digest")) | (F.col("body_bytes") != F.col("payload_bytes")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id")))
                    ).otherwise(F.col("payload_digest"))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("bigint")
    return idx.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"),
                      "record_type", number("refers_to").alias("refers_to"), "target_uri", "file", "offset", "length")
