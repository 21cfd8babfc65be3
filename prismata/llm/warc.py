"""WARC writing, and a salvage reader.

Archives are gzip files with one member a record (WARC/1.1, response and revisit records). Writers roll files over at
`segment_bytes` and write each under a temporary name that is renamed when complete; the list of files that committed
tasks wrote is itself a table, so files of lost or repeated attempts are never read.

The reader trusts nothing: a member must inflate with a right CRC and hold whole records and nothing else; a record must start
with a version line, carry a Content-Length that fits, end in an empty line, and hold a block that matches its digests (in hex
or base32, by the algorithm they name; digests of algorithms that the reader does not know are not checked). When a check
fails, it searches for the next byte position where a valid member or a version line begins, whatever the file began with,
goes on there, and logs the bytes between as a quarantined gap. Records of one member all have the member's byte range; of a
member with a damaged record the good ones are read, and the member is logged as well.

Defined results: null html is an empty payload; payloads under `least_bytes` are always responses; of equal payloads the
one with the smallest page_id is the response; rows with a null page_id are left out (a record needs a name); page_id is
taken to be unique, and repeated ids keep one row for each record; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT_BYTES = 16 << 20
LEAST_BYTES = 100
VERSION = b"WARC/1."
# Record types of the format.
KINDS = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
RECORDS = "path string, start long, end long, kind string, name string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"
GAPS = "path string, start long, end long, reason string"


def _fs(uri: str):
    """A file system of pyarrow and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + urllib.parse.quote(uri.removeprefix("file:")))


def _line(text: str | None) -> str:
    """A header value; line ends would break the header and are escaped."""
    return urllib.parse.quote(text or "", safe="!#$%&'()*+,/:;=?@[]~-._")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record, not compressed. A revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str, segment_bytes: int, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out, size, name, done = None, 0, "", []

        def close() -> None:
            out.close()
            fs.move(f"{base}/_{name}", f"{base}/{name}")
            done.append((f"{folder}/{name}", size))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page, url, html, n, digest, refers in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    raw = record(page, url, (html or "").encode(), digest, refers, n)
                    raw = member(raw) if compress else raw
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress
                        out, size = fs.open_output_stream(f"{base}/_{name}", compression=None), 0
                    out.write(raw)
                    size += len(raw)
                    if size >= segment_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "bytes"])

    return run


def write_warc(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = LEAST_BYTES, compress: bool = True) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) and returns the written files (path, bytes)."""
    rows = common.columns(pages, page_id="page_id", url="url", html="html").filter(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    # Copies are found without their payloads, so that a page that is there by the thousand never meets in one task; then each
    # record is told what it refers to by its own name.
    bare = rows.filter(F.col("n") >= least_bytes).select("page_id", "digest")
    first = bare.groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    refers = bare.join(first.hint("shuffle_hash"), F.col("digest") == F.col("same")).filter(F.col("first") < F.col("page_id")).groupBy(F.col("page_id").alias("of"), "same").agg(F.min("first").alias("refers_to"))
    marked = rows.join(refers, (F.col("page_id") == F.col("of")) & (F.col("digest") == F.col("same")), "left")
    marked = marked.select("page_id", "url", F.when(F.col("refers_to").isNotNull(), F.lit("")).otherwise(F.col("html")).alias("html"), "n", "digest", "refers_to")
    return common.stored(marked.mapInArrow(_writer(folder, segment_bytes, compress), "path string, bytes long"), "warc-files")


_FIELD = re.compile(rb"\r\n([!#$%&'*+.^_`|~0-9A-Za-z-]+)[ \t]*:[ \t]*([^\r\n]*(?:\r\n[ \t]+[^\r\n]*)*)")
_FOLD = re.compile(rb"\r\n[ \t]+")
_HTTP_LENGTH = re.compile(rb"(?i)\r\nContent-Length[ \t]*:[ \t]*(\d+)")
# The algorithms of labelled digests that are checked.
ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}


def matches(digest: str, data: bytes) -> bool:
    """Whether a labelled digest, in hex or base32, is that of the data; true if its algorithm is unknown."""
    label, colon, value = digest.strip().partition(":")
    name = ALGORITHMS.get(label.strip().lower())
    if not colon or not name:
        return True
    found, value = hashlib.new(name, data).digest(), value.strip()
    if len(value) == 2 * len(found):
        return found.hex() == value.lower()
    try:
        return base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8)) == found
    except (binascii.Error, ValueError):
        return False


def parse(raw: bytes, at: int = 0) -> tuple[dict | None, int, str]:
    """The record at `at` of uncompressed bytes, its end, and what is wrong if there is none."""
    if not raw.startswith(VERSION, at):
        return None, at, "no version line"
    head_end = raw.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None, at, "header not ended"
    fields = {k.decode("ascii").lower(): _FOLD.sub(b" ", v).decode("utf-8", "replace").strip() for k, v in _FIELD.findall(raw[at:head_end])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return None, at, "no content length"
    start, end = head_end + 4, head_end + 4 + length
    if length < 0 or len(raw) < end + 4 or raw[end : end + 4] != b"\r\n\r\n":
        return None, at, "block not ended"
    kind = fields.get("warc-type", "").lower()
    if kind not in KINDS or not fields.get("warc-record-id"):
        return None, at, "header damaged"
    block = raw[start:end]
    if not matches(fields.get("warc-block-digest", ""), block):
        return None, at, "block digest differs"
    http, _, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "application/http").lower().startswith("application/http"):
        http, payload = b"", block
    digest = fields.get("warc-payload-digest", "")
    # A segment holds a part of the payload that its digest is of.
    if kind == "response" and "warc-segment-number" not in fields and not matches(digest, payload):
        return None, at, "payload digest differs"
    label, _, value = digest.partition(":")
    if ALGORITHMS.get(label.lower()) == "sha256" and len(value) == 64:
        digest = value.lower()
    declared = _HTTP_LENGTH.search(http + b"\r\n")
    size = len(payload) if kind == "response" or not declared else int(declared[1])
    return {"kind": kind, "name": fields.get("warc-record-id", "").strip("<>"), "url": urllib.parse.unquote(fields.get("warc-target-uri", "")), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "payload_digest": digest, "payload_bytes": size, "payload": payload}, end + 4, ""


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The gzip member at `at`, and where it ends."""
    z = zlib.decompressobj(31)
    out, pos = [], at
    view = memoryview(data)
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(view[pos : pos + (1 << 16)]))
            pos += 1 << 16
    except zlib.error as e:
        return b"", at, f"member broken: {str(e)[:60]}"
    if not z.eof:
        return b"", at, "member cut off"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def _member_records(raw: bytes) -> tuple[list[dict], str]:
    """The good records of an inflated member, and what is wrong with the first bytes that are in none."""
    records, at, why = [], 0, ""
    while at < len(raw):
        found, end, problem = parse(raw, at)
        if found is None:
            why = why or (problem if not records else f"bytes after the record: {problem}")
            step = raw.find(VERSION, at + 1)
            at = len(raw) if step < 0 else step
            continue
        records.append(found)
        at = end
    return records, why if raw else "member empty"


def salvage(data: bytes, gzip: bool | None = None) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records with their byte ranges, and the gaps, of one archive. Gzip members and plain records are told apart wherever
    one begins; `gzip` True or False names the only kind to look for."""
    marks = [m for m, looked in ((b"\x1f\x8b\x08", gzip is not False), (VERSION, gzip is not True)) if looked]
    ahead = dict.fromkeys(marks, -1)  # where each mark is found next

    def following(at: int) -> int:
        for m in marks:
            if ahead[m] < at:
                place = data.find(m, at)
                ahead[m] = len(data) if place < 0 else place
        return min(ahead.values())

    records, gaps, at, bad, why = [], [], 0, None, ""
    while at < len(data):
        found, end, problem, damaged = [], at, "no member or version line", ""
        if any(data.startswith(m, at) for m in marks):
            if data.startswith(VERSION, at):
                one, end, problem = parse(data, at)
                found = [one] if one else []
            else:
                raw, end, problem = _inflated(data, at)
                if not problem:
                    found, damaged = _member_records(raw)
                    problem = "" if found else damaged
        if problem:
            if bad is None:
                bad, why = at, problem
            at = following(at + 1)
            continue
        if bad is not None:
            gaps.append((bad, at, why))
            bad = None
        records += [r | {"start": at, "end": end} for r in found]
        if damaged:
            gaps.append((at, end, damaged))
        at = end
    if bad is not None:
        gaps.append((bad, len(data), why))
    return records, gaps


def _reader(with_payload: bool, log: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records, gaps = salvage(content.as_buffer().to_pybytes() if content.is_valid else b"")
                if log:
                    yield pa.RecordBatch.from_pylist([{"path": path, "start": a, "end": b, "reason": w} for a, b, w in gaps], pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]))
                    continue
                kinds = [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
                for at in range(0, len(records), 512):
                    yield pa.RecordBatch.from_pylist([r | {"path": path, "payload": r["payload"] if with_payload else None} for r in records[at : at + 512]], pa.schema(kinds))

    return run


def _contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Whole archives, one row each; Spark reads them, so any store that it knows will do.

    Files are listed by the folders that the table of files names; a file that the table does not name is not read.
    """
    folders = [r[0] for r in files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "path string, content binary")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folders)
    return read.select("path", "content", F.substring_index("path", "/", -1).alias("file")).join(files.select(F.substring_index("path", "/", -1).alias("file")), "file", "left_semi").select("path", "content")


def read_warc(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives that `files` (path) names."""
    return _contents(spark, files).mapInArrow(_reader(with_payload, False), RECORDS)


def quarantine_log(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Gaps of the archives that `files` (path) names."""
    return _contents(spark, files).mapInArrow(_reader(False, True), GAPS)
