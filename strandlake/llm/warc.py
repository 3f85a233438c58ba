"""WARC archives: written from pages, indexed by record, read back by coalesced byte ranges.

Each record is a gzip member of its own. While a task writes an archive it yields one index row per
record: file, offset, length, URL, digest. Readers sort the selected rows by file and offset, merge
neighbouring ranges and fetch each merged range once. Archives have names that are never reused, and
an index row names the very file its task attempt wrote, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, lean, rows_only

#: An archive is closed beyond this size.
ARCHIVE = 1 << 30
#: Ranges at most this far apart are fetched as one, up to RANGE bytes.
GAP, RANGE = 1 << 16, 8 << 20
#: The upper half of record ids; the lower half is the page's id. A fixed value.
RECORDS = 0x5F0C8D2E_71B9_4A63
INDEX = "page_id long, url string, file string, offset long, length long, digest string, type string"


class Store:
    """Files of a shared folder: local paths directly, other schemes through Arrow's file systems."""

    def __init__(self, folder: str):
        self.local = folder.startswith(("file:", "/"))
        if self.local:
            self.root = "/" + folder.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def create(self, name: str):
        path = f"{self.root}/{name}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            return open(path, "wb")
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(path)

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_file(f"{self.root}/{name}")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=RECORDS << 64 | page % 2**64)}>" if page is not None else f"<urn:uuid:{uuid.UUID(int=0)}>"


def page_of(ident: str) -> int | None:
    n = uuid.UUID(ident.strip("<>").removeprefix("urn:uuid:")).int
    return None if not n else (n + 2**63) % 2**64 - 2**63


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(header fields, payload, its length according to the HTTP header)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, size


def _digests(batches: Iterator) -> Iterator:
    for b in batches:
        digests = [sha1_base32(h.as_py() or b"") for h in b.column("html")]
        sizes = [len(h.as_py() or b"") for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "digest", "size"])


def _write(batches: Iterator, folder: str) -> Iterator:
    store, out, name, at = Store(folder), None, "", 0
    try:
        for b in batches:
            rows: list[tuple] = []
            for page, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.create(name)
                data = gzip.compress(record(page, url, html or b"", digest, refers_to), 3, mtime=0)
                out.write(data)
                rows.append((page, url, name, at, len(data), digest, "response" if refers_to is None else "revisit"))
                at += len(data)
                if at >= ARCHIVE:
                    out.close()
                    out = None
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "file", "offset", "length", "digest", "type"])
    finally:
        if out is not None:
            out.close()


def _ranges(batches: Iterator) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """From rows sorted by file and offset: (file, start, end, [(offset, length), ...]) per merged range."""
    file, start, end, inside = None, 0, 0, []
    for b in batches:
        for f, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if f != file or at > end + GAP or at + n - start > RANGE:
                if inside:
                    yield file, start, end, inside
                file, start, end, inside = f, at, at, []
            inside.append((at, n))
            end = max(end, at + n)
    if inside:
        yield file, start, end, inside


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator, folder: str, with_payload: bool) -> Iterator:
    store, opened, last = Store(folder), None, None
    for file, start, end, inside in _ranges(batches):
        if file != last:
            if opened is not None:
                opened.close()
            opened, last = store.open(file), file
        opened.seek(start)
        data = opened.read(end - start)
        rows = []
        for at, n in inside:
            fields, payload, size = parse(zlib.decompress(data[at - start : at - start + n], 31))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                raise ValueError(f"{file} at {at}: the payload isn't what its digest says")
            refers_to = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
            rows.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, refers_to, payload if with_payload and kind == "response" else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])
    if opened is not None:
        opened.close()


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) to ``folder``; returns the index.

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is the
    response and the others are revisits of it; smaller ones are all responses. A null html is an
    empty payload. Rows that share page_id and payload are all responses if that page_id is the
    largest; so are rows with a null page_id. Other columns are ignored.
    """
    rows = rows_only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary").alias("html"))
    scope = Scope(pages.sparkSession)
    known = scope.table(rows.select("page_id", "html").mapInArrow(lean(_digests), "page_id long, digest string, size long"), "digests")
    first = known.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    again = known.join(first, "digest").where("page_id < refers_to").select(F.col("page_id").alias("again"), F.col("digest").alias("d"), "refers_to").distinct()
    own = rows.mapInArrow(_with_digest, "page_id long, url string, html binary, digest string")
    both = own.join(again.hint("merge"), (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("d")), "left")
    ready = both.select("page_id", "url", "html", "digest", "refers_to")
    return scope.result(ready.mapInArrow(lean(lambda it: _write(it, folder)), INDEX), "index")


def _with_digest(batches: Iterator) -> Iterator:
    for b in batches:
        digests = [sha1_base32(h.as_py() or b"") for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=["page_id", "url", "html", "digest"])


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected ``index`` rows, in ranges of one file at a time."""
    rows = index.select("file", "offset", "length").withColumn("part", F.floor(F.col("offset") / RANGE))
    # With the number given, tasks aren't merged by the size of the index rows, which says nothing of the records'.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return rows.mapInArrow(lambda it: _read(it, folder, with_payload), RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back.

    The archives and the index stay until the result is written, and are deleted then. Otherwise as write_archives.
    """
    scope = Scope(pages.sparkSession)
    folder = scope.path("warc")
    index = write_archives(pages, folder, least)
    scope.paths += [index.inputFiles()[0].rpartition("/")[0]] if index.head(1) else []
    return scope.result(read_records(index, folder, with_payload=False).drop("payload", "url"), "records")
