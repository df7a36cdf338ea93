"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The reader gives each task a byte range of a file.  A task looks for the gzip magic in its
range, takes a candidate for a record only if its first bytes inflate to a WARC version
line and headers, and owns exactly the records that start inside its range, reading past
the end to finish the last one.  So a large archive is read by many tasks without an index.

Files are opened through pyarrow's file systems, so the folder can be on any store they
know; the writer needs a folder that all executors and later readers share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sent, shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
#: Byte ranges are dealt to at most so many tasks; a task may read several.
MOST_TASKS = 20_000
VERSION = b"WARC/1."
RECORDS = "record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary, file string, position long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, sha: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit carries no payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    clean = "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Target-URI: {clean}"] if url is not None else []
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {size}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> dict | None:
    """The fields of an inflated record; None if it isn't one."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not head.startswith(VERSION):
        return None
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        body = rest[: int(found["content-length"])]
    except (KeyError, ValueError):
        return None
    payload = body.partition(b"\r\n\r\n")[2]
    kind = found.get("warc-type")
    number = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
    sha = found.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest(payload) != sha:
        raise ValueError(f"payload digest differs in {found.get('warc-record-id')}")
    size = len(payload) if kind == "response" else int(found.get("x-payload-length", 0))
    return {"record_type": kind, "record_id": found.get("warc-record-id"), "page_id": number(found.get("warc-record-id")), "url": found.get("warc-target-uri"), "payload_digest": sha, "payload_bytes": size, "refers_to": number(found.get("warc-refers-to")), "payload": payload}


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row below ``folder``; returns (file, records), one row a file.

    Of rows with equal payloads the one with the smallest key is a response, the others are
    revisits that refer to it; rows repeated with that smallest key are responses too.  A null
    payload is an empty one.  A null key is written without a number, is smaller than none and
    so is a revisit wherever another row has its payload.  Very long payloads are written whole;
    an empty table gives no archive; other columns are not read.  A task that runs twice leaves
    a file of its own each time; only files in the returned rows count, so read those.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).alias("_url"), body.alias("_body"))
    firsts = rows.groupBy(F.unhex(F.sha1("_body")).alias("_sha")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").select("_sha", "_first")
    firsts = cut(firsts, "copies")
    marked = rows.withColumn("_sha", F.unhex(F.sha1("_body"))).join(sent(firsts), "_sha", "left")
    refers = F.when(F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_id") != F.col("_first"))), F.col("_first"))

    def run(batches):
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        store, path = pafs.FileSystem.from_uri(name)
        out, n = None, 0
        for b in batches:
            for page_id, link, payload, sha, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                kind = "response" if refers_to is None else "revisit"
                out.write(record(page_id, link, payload, kind, base64.b32encode(sha).decode(), len(payload), refers_to))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return cut(marked.select("_id", "_url", "_body", "_sha", refers.alias("_refers")).mapInArrow(run, "file string, records long"), "archives")


class Source:
    """A file read forward in blocks, with the bytes from ``base`` on kept."""

    def __init__(self, file, size: int, at: int) -> None:
        self.file, self.size, self.base, self.data = file, size, at, bytearray()
        file.seek(at)

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def more(self) -> bool:
        block = self.file.read(READ_BYTES)
        self.data += block
        return bool(block)

    def drop(self, at: int) -> None:
        """Forget what lies before ``at``."""
        del self.data[: at - self.base]
        self.base = at


def _inflate(source: Source, at: int, header_only: bool) -> tuple[bytes, int] | None:
    """The member at ``at`` (or its beginning) and where it ends; None if it isn't a gzip member."""
    inflater, out, pos, seen = zlib.decompressobj(31), bytearray(), at, 0
    while True:
        if pos >= source.end and not source.more():
            return None  # the file ends inside the member
        chunk = bytes(source.data[pos - source.base : pos - source.base + (1024 if header_only else READ_BYTES)])
        try:
            out += inflater.decompress(chunk)
        except zlib.error:
            return None
        pos += len(chunk) - len(inflater.unused_data)
        if header_only and (not out.startswith(VERSION[: len(out)]) or out.find(b"\r\n\r\n", max(0, seen - 3)) >= 0):
            return bytes(out), pos
        seen = len(out)
        if inflater.eof:
            return bytes(out), pos


def records_in(file, size: int, start: int, stop: int):
    """(position, raw record) of the members that start in ``start .. stop - 1`` and hold WARC headers."""
    source, at = Source(file, size, start), start
    while at < stop:
        found = source.data.find(MAGIC, at - source.base)
        if found < 0:
            at = max(at, source.end - len(MAGIC) + 1)
            source.drop(min(at, source.end))
            if source.end >= stop + len(MAGIC) or not source.more():
                return
            continue
        at = source.base + found
        if at >= stop:
            return
        head = _inflate(source, at, True)
        whole = _inflate(source, at, False) if head and head[0].startswith(VERSION) and b"\r\n\r\n" in head[0] else None
        if whole is None:
            at += 1
        else:
            yield at, whole[0]
            at = whole[1]
        source.drop(min(at, source.end))


def read_warc(spark: SparkSession, files: DataFrame | str, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives: type, id, page_id, url, digest, full payload length, refers_to, payload, file, position.

    ``files``: a folder, or a DataFrame with a column ``file``.  Bytes that aren't records
    are passed over; a response whose payload differs from its digest fails the read.  Repeated
    records are returned each, very long ones whole; no archives give no rows; other columns
    of ``files`` are not read.  A gzip member with a whole record that lies uncompressed inside
    another record's payload is read as a record if a split begins before it.
    """
    if isinstance(files, str):
        store, path = pafs.FileSystem.from_uri(files)
        found = store.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        scheme = files[: files.index(path)] if path in files else ""
        files = spark.createDataFrame([(scheme + f.path,) for f in found if f.path.endswith(".warc.gz")], "file string")

    def ranges(batches):
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(name)
                size = store.get_file_info(path).size
                rows += [(name, at, min(at + split, size), size) for at in range(0, size, split)]
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "start", "stop", "size"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], []), strict=True)), schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("size", pa.int64())]))

    fields = [f.split() for f in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches):
        for b in batches:
            for name, start, stop, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, path = pafs.FileSystem.from_uri(name)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, raw in records_in(file, size, start, stop):
                        found = parse(raw)
                        if found is None:
                            continue
                        if not payloads:
                            found["payload"] = None
                        rows.append(found | {"file": name, "position": at})
                        held += len(raw)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    dealt = files.select("file").mapInArrow(ranges, "file string, start long, stop long, size long")
    dealt = cut(dealt, "ranges")
    return dealt.repartition(max(1, min(dealt.count(), MOST_TASKS)), "file", "start").mapInArrow(run, RECORDS)


def op8_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_warc(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = cut(read_warc(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "read")
    written, read = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if read != written:
        raise ValueError(f"{written} records written, {read} read")
    return found
