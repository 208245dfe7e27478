"""Deterministic sharded WARC writer and reader.

Pages are range-partitioned and sorted by page_id, with boundaries at exact quantiles of the payload sizes.
Each record is made anew, with its headers, digests and an id derived from page and payload, and compressed
as its own gzip member; a file is rolled when it has reached a compressed size.  Files are written under
temporary names and renamed, and only the manifest, committed beside them at the end, says which files
there are.  Running a task again writes the same bytes to the same name.

Payloads that occur more than once are stored with their smallest page_id; later pages get revisit records.
Which pages these are comes from a join of digests, and travels to the writers as small rows that are
sorted in front of their page, so that the pages themselves are shuffled once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import committed, file_system, fresh_path, range_bounds, range_key, range_of, staged, unstage

SHARD_BYTES = 16 << 20
FILE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 100
#: Fixed values of the WARC 1.1 standard.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = b"\r\n".join([_VERSION, *(f"{k}: {v}".encode() for k, v in headers)])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, level: int = 6) -> bytes:
    """Compressed response record, or revisit record if refers_to is a page."""
    digest = hashlib.sha256(payload).hexdigest()
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    return _member(headers, block, level)


def read_records(data: bytes):
    """(headers, block) of each record of a file of gzip members; checks the digests of what it reads."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            fed = view[at : at + 65536]
            if not len(fed):
                raise ValueError("a record is cut off")
            parts.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if lines[0].encode() != _VERSION or len(rest) != len(block) + 4:
            raise ValueError("not a WARC record")
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("a block differs from its digest")
        yield headers, block


def _writer(folder: str, file_bytes: int, date: str, level: int):
    def write(batches):
        store, top = file_system(folder)
        now = part = None
        parts, size, pages = [], 0, []
        out, marks = [], {}

        def begin():
            nonlocal parts, size, pages
            name = f"pages-{now:08d}-{part:05d}.warc.gz"
            info = b"software: cairn\r\nformat: WARC File Format 1.1\r\n"
            parts = [_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, level)]
            size, pages = len(parts[0]), []

        def flush():
            if not pages:
                return
            name, data = f"pages-{now:08d}-{part:05d}.warc.gz", b"".join(parts)
            temporary = f"{top}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            store.move(temporary, f"{top}/{name}")
            known = [p for p in pages if p is not None]
            out.append((now, part, f"{folder}/{name}", len(pages), len(data), min(known, default=None), max(known, default=None), hashlib.sha256(data).hexdigest()))

        for batch in batches:
            for shard, page, is_page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    flush()
                    now, part, marks = shard, 0, {}
                    begin()
                elif size >= file_bytes:
                    flush()
                    part += 1
                    begin()
                if not is_page:
                    marks = {k: v for k, v in marks.items() if k[0] == page}
                    marks[page, digest] = refers_to
                    continue
                payload = (html or "").encode()
                target = marks.get((page, hashlib.sha256(payload).hexdigest())) if marks else None
                parts.append(page_record(page, url, payload, target, date, level))
                size += len(parts[-1])
                pages.append(page)
        flush()
        names = ["shard", "part", "path", "records", "bytes", "first_page", "last_page", "sha256"]
        yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], pa.string() if n in ("path", "sha256") else pa.int64()) for i, n in enumerate(names)})

    return write


def write_warc(pages: DataFrame, *, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_revisit: int = LEAST_REVISIT, date: str = DATE, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) and return the manifest: shard, part, path, records, bytes, first_page, last_page, sha256.

    A null html is an empty payload.  Of pages with equal payloads of least_revisit bytes or more those with
    the smallest page_id are responses, the others revisit records.  Pages without an id come first and
    are responses.  Repeated rows are written each; pages that share an id are in the order of a hash of their
    payload.  A payload of any length is one record of one file.  No row gives no file and an empty manifest.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce("html", F.lit(""))
    pages = pages.withColumn("tie", F.xxhash64(payload))
    slim = staged(pages.select("page_id", "tie", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "warc-digests")
    copies = staged(slim.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-copies")
    marks = slim.where(F.col("size") >= least_revisit).join(copies, "digest").where("page_id > first").select("page_id", "tie", "digest", F.col("first").alias("refers_to")).distinct()

    key = range_key(F.col("page_id"), F.col("tie"))
    bounds = range_bounds(slim.select(key.alias("key"), (F.col("size") + 1).alias("bytes")), shard_bytes)
    shard = range_of(key, bounds).cast("int")

    rows = pages.select("page_id", "tie", F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    notes = marks.select("page_id", "tie", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    folder = fresh_path(spark, "warc")
    store, top = file_system(folder)
    store.create_dir(top)
    both = rows.unionByName(notes).select(shard.alias("shard"), "page_id", "is_page", "url", "html", "digest", "refers_to", "tie")
    both = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "tie", "is_page", "url", "html").drop("tie")
    schema = "shard long, part long, path string, records long, bytes long, first_page long, last_page long, sha256 string"
    manifest = committed(both.mapInArrow(_writer(folder, file_bytes, date, level), schema), folder)
    unstage(slim, copies)
    return manifest


def _read(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = file_system(uri)
            with store.open_input_stream(path, compression=None) as f:
                data = f.read()
            out = []
            for headers, block in read_records(data):
                kind = headers["WARC-Type"]
                if kind == "warcinfo":
                    continue
                size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"a payload in {uri} differs from its header")
                page, target = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                out.append((page and int(page), size, digest, kind, target and int(target), headers.get("WARC-Target-URI")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    files = max(1, min(manifest.count(), 1 << 16))
    return manifest.select("path").repartition(files).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
