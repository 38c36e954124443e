"""Operator 4: a deterministic, sharded WARC writer, and the reader of its archives.

Records are dealt into ranges of the page id whose borders depend on the data alone, and sorted inside; a task writes its
ranges one after the other and begins a new file when the compressed size is reached. Headers, identifiers and digests are
made anew from the payload, so that the same pages give the same files whatever the cluster. A file is written under a
temporary name and moved when whole; the manifest, one row per file, is what readers go by.

Of records with equal payloads of at least ``min_revisit`` bytes, that of the smallest page id is a response and the others
revisit it. Which page that is comes from the digests alone; it reaches the writer as rows sorted in before the page's own, so
that pages travel once and a payload shared by a third of all pages is no hot group.

Null payloads are empty. Null ids sort first and are never referred to where a group has an id; of repeated rows with the
smallest id one is the response. Null or odd URLs are written percent-encoded or as ``urn:page:ID``. No pages give an empty
manifest. Columns beside the three named ones are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.files import commit_file, read_stream
from tablescope.llm.ranges import borders, dealt, with_shard
from tablescope.llm.scratch import Scratch

ROWS_PER_SHARD = 2048
BYTES_PER_FILE = 16_000_000
MIN_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"  # records carry no time of writing: files must not depend on it
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, seq int, name string, records long, bytes long"
_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{nth}')}>"


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode("utf-8")


def _compressed(record: bytes) -> bytes:
    """One gzip member without a time or a name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, date: str, revisits: tuple[int | None] | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisits else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page_id}"
    head = [
        ("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", _record_id(page_id, digest, nth)), ("WARC-Date", date),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisits:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(revisits[0], digest, 0))]
        if revisits[0] is not None:
            head.append(("X-Refers-To-Page-Id", str(revisits[0])))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _compressed(b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + block + b"\r\n\r\n")


def _file_start(name: str, date: str) -> bytes:
    body = _headers([("software", "tablescope"), ("format", "WARC File Format 1.1")])
    head = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'file:' + name)}>"), ("WARC-Date", date),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body))),
    ]
    return _compressed(b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + body + b"\r\n\r\n")


def write_warc(
    pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", bytes_per_file: int = BYTES_PER_FILE,
    rows_per_shard: int = ROWS_PER_SHARD, min_revisit: int = MIN_REVISIT, date: str = DATE,
) -> tuple[str, DataFrame]:
    """The folder of the archives, and their manifest."""
    folder = scratch.files("warc")
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("p"), F.col(f"`{url}`").cast("string").alias("u"), payload.alias("t"))
    digest = F.sha2("t", 256)
    narrow = scratch.write(base.select("p", digest.alias("d"), F.octet_length("t").alias("n")), "digests")
    shared = narrow.filter(F.col("n") >= min_revisit).groupBy("d").agg(F.min("p").alias("first"), F.count("*").alias("c")).filter("c > 1")
    shared = scratch.write(shared.select(F.col("d").alias("g"), "first"), "shared")
    told = narrow.filter(F.col("n") >= min_revisit).join(shared, F.col("d") == F.col("g")).select("p", F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("t"), "d", F.lit(0).alias("kind"), "first")
    rows = base.select("p", "u", "t", digest.alias("d"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"))
    ends = borders(narrow, "p", rows_per_shard)
    ordered = dealt(with_shard(told.unionAll(rows), "p", ends), ["p", "d", "kind", "u"]).select("shard", "p", "u", "t", "d", "kind", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, held, size, count = None, 0, [], 0, 0
        known, last, nth = None, None, 0

        def close() -> pa.RecordBatch:
            name = f"pages-{shard:05d}-{seq:05d}.warc.gz"
            written = commit_file(folder, name, [_file_start(name, date), *held])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, seq, name, count, written), _MANIFEST_ARROW, strict=True)], schema=_MANIFEST_ARROW)

        for batch in batches:
            for s, p, u, t, d, kind, first in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == 0:
                    known = (p, d, first)
                    continue
                if held and (s != shard or size >= bytes_per_file):
                    yield close()
                    seq, held, size, count = (seq + 1 if s == shard else 0), [], 0, 0
                shard = s
                nth = nth + 1 if (p, d) == last else 0
                last = (p, d)
                grouped = known is not None and known[:2] == last
                revisits = (known[2],) if grouped and (p != known[2] or nth) else None
                record = _record(p, u, t.encode("utf-8"), d, nth, date, revisits)
                held.append(record)
                size += len(record)
                count += 1
        if held:
            yield close()

    return folder, scratch.write(ordered.mapInArrow(run, _MANIFEST), "manifest")


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip()] = value.strip()
        yield head, stream.read(int(head["Content-Length"]))


def read_warc(folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record, and ``payload`` when asked for.

    Digests of blocks and of payloads are checked; a revisit's size and digest are those of the payload it stands for.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = [part.split()[0] for part in schema.split(", ")]

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with read_stream(folder, name) as source, gzip.GzipFile(fileobj=source) as plain, io.BufferedReader(plain) as stream:
                    for head, block in _records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        whole = head["WARC-Type"] == "response"
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: a block differs from its digest")
                        if whole and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        row = (number(head.get("X-Page-Id")), head["WARC-Target-URI"], size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-Id")))
                        rows.append((*row, payload) if with_payload else row)
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # A given number of tasks: adaptive execution would see a tiny table and read all archives in one.
    files = max(1, min(manifest.count(), 20_000))
    return manifest.select("name").repartition(files, "name").mapInArrow(run, schema)
