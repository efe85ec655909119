"""WARC archives: writing captures, and assembling them again by transaction.

write_archives() stores each page as a transaction of three records: the request, the response (or, for a
payload that another capture already holds, a revisit without payload), and a metadata record. Request and
metadata name the response or revisit they belong to in WARC-Concurrent-To. Every task writes its own
gzip-per-record files below a folder of the shared store; a task that runs again writes files of another name
and only the files of the attempt that committed are listed, so that lost executors do no harm.

read_records() streams the listed files, record by record. assemble() joins the records of a transaction by the
identifiers in WARC-Concurrent-To and emits one nested row per capture; records may lie in any files.

Revisits: of captures with equal payloads of ``least`` bytes or more, the one with the largest page_id is the
response and the others revisit it; smaller payloads are all responses. The digest groups are aggregated before
anything is joined, so a payload shared by a third of all pages is one row; html is not shuffled unless the
table of shared digests outgrows Spark's broadcast threshold.

A null html is an empty payload; a null url is left out of the headers. Rows that repeat wholly are alike: all
responses or all revisits; of rows with one page_id, one payload and different urls one is the response. Rows
with a null page_id come out as such, and are a response only where no row with an id holds the payload.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILE_BYTES = 64 << 20
RECORD_SQL = "record_id string, concurrent_to string, type string, uri string, refers_to string, digest string, payload_bytes long, page_id long, date string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def described(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, record_id, digest, is_response, refers (the record revisited)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(html)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    # a record's name follows from its row, so tasks that run again give the same names
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), digest, F.coalesce("url", F.lit("null"))))
    small = keyed.select("page_id", digest.alias("sha"), F.length(html).alias("size"), name.alias("name"))
    shared = small.where(F.col("size") >= least).groupBy("sha").agg(F.max(F.struct("page_id", "name")).alias("top"), F.count("*").alias("n")).where("n > 1")
    shared = common.staged(shared.select(F.col("sha").alias("_sha"), F.col("top.page_id").alias("_page"), F.col("top.name").alias("_name")), "shared")
    return keyed.withColumns({"sha": digest, "name": name}).join(shared, F.col("sha") == F.col("_sha"), "left")


def write_archives(pages: DataFrame, least: int = 0, crawl_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns the list of committed files: path, records, bytes."""
    spark = pages.sparkSession
    root = common.new_path(spark, "warc")
    rows = described(pages, least).select("page_id", "url", "html", "sha", "name", "_page", "_name")

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out = path = None
        records = size = 0
        for batch in batches:
            for p in batch.to_pylist():
                payload = (p["html"] or "").encode()
                page = "" if p["page_id"] is None else str(p["page_id"])
                digest = base64.b32encode(bytes.fromhex(p["sha"])).decode()
                revisit = p["_name"] is not None and p["_name"] != p["name"]
                this, other = str(uuid.UUID(p["name"])), uuid.UUID(p["name"])
                common_head = [("WARC-Date", crawl_date)] + ([("WARC-Target-URI", _one_line(p["url"]))] if p["url"] is not None else [])
                status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                main = [*common_head, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    main += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(p['_name'])}>")]
                with_this = [("WARC-Concurrent-To", f"<urn:uuid:{this}>"), *common_head]
                request = b"GET " + _one_line(p["url"] or "/").encode() + b" HTTP/1.1\r\n\r\n"
                about = f"page-id: {page}\r\npayload-length: {len(payload)}\r\n".encode()
                blocks = [
                    record("request", str(uuid.uuid5(other, "request")), [*with_this, ("Content-Type", "application/http; msgtype=request")], request),
                    record("revisit" if revisit else "response", this, main, status if revisit else status + payload),
                    record("metadata", str(uuid.uuid5(other, "metadata")), [*with_this, ("Content-Type", "application/warc-fields")], about),
                ]
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = store.open_output_stream(path, compression=None), 0, 0
                for b in blocks:
                    out.write(b)
                    size += len(b)
                records += len(blocks)
                if size >= FILE_BYTES:
                    out.close()
                    yield _listed(root, path, records, size)
                    out = None
        if out is not None:
            out.close()
            yield _listed(root, path, records, size)

    # writing happens once, here: what is listed is what the committed attempts wrote
    return common.staged(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def _listed(root: str, path: str, records: int, size: int):
    return pa.RecordBatch.from_pylist([{"path": f"{root}/{path.rsplit('/', 1)[1]}", "records": records, "bytes": size}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


def parse(stream) -> object:
    """Yields (headers by lower-case name, block) of each record of a gzip-per-record or plain WARC stream."""
    reader = io.BufferedReader(_Members(stream), 1 << 20)
    while True:
        line = reader.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := reader.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, reader.read(int(headers.get("content-length", 0)))


class _Members(io.RawIOBase):
    """Concatenated gzip members, or plain bytes, as one stream."""

    def __init__(self, source):
        self.source, self.inner, self.rest, self.left, self.plain = source, None, b"", b"", None

    def readable(self):
        return True

    def readinto(self, target):
        while not self.left:
            if not self.rest:
                self.rest = self.source.read(1 << 20)
                if not self.rest:
                    return 0
            if self.plain is None:
                self.plain = self.rest[:2] != b"\x1f\x8b"
            if self.plain:
                self.left, self.rest = self.rest, b""
                continue
            if self.inner is None:
                self.inner = zlib.decompressobj(31)
            self.left = self.inner.decompress(self.rest)
            self.rest = self.inner.unused_data
            if self.inner.eof:
                self.inner = None
        n = min(len(target), len(self.left))
        target[:n], self.left = self.left[:n], self.left[n:]
        return n


def _urn(value: str | None) -> str | None:
    return value.strip("<>").rsplit(":", 1)[-1] if value else None


def read_records(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in column path. Digest and length are those of the payload that was read;
    a revisit has its header's. payload is null unless asked for."""

    def run(batches):
        rows: list[dict] = []
        held = 0
        schema = pa.schema([("record_id", pa.string()), ("concurrent_to", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("date", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for h, block in parse(stream):
                        kind = h.get("warc-type")
                        row = {"record_id": _urn(h.get("warc-record-id")), "concurrent_to": _urn(h.get("warc-concurrent-to")), "type": kind, "uri": h.get("warc-target-uri"), "refers_to": _urn(h.get("warc-refers-to")), "date": h.get("warc-date")}
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            row |= {"digest": digest32(payload), "payload_bytes": len(payload), "payload": payload if with_payload else None}
                            held += len(payload) * with_payload
                        elif kind == "revisit":
                            row["digest"] = h.get("warc-payload-digest", "").rpartition(":")[2]
                        elif kind == "metadata":
                            about = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                            row |= {"page_id": int(about["page-id"]) if about.get("page-id") else None, "payload_bytes": int(about.get("payload-length", 0))}
                        rows.append(row)
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    width = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(max(width, common.shuffle_width(files.sparkSession))).mapInArrow(run, RECORD_SQL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, uri, and structs request, response (record_id, type, digest,
    payload_bytes, refers_to, payload) and metadata. Request and metadata records find their capture by
    concurrent_to. Records without a capture are left out; a missing request or metadata is a null struct."""
    key = F.coalesce("concurrent_to", "record_id")
    body = F.struct("record_id", "type", "digest", "payload_bytes", "refers_to", "payload")
    about = F.struct("record_id", "page_id", "payload_bytes")
    ask = F.struct("record_id", "uri", "date")
    main = F.col("type").isin("response", "revisit")
    numbered = records.withColumn("capture_id", key)
    # a record's name follows from its row: equal rows give equal records, counted here, and each comes out
    grouped = numbered.groupBy("capture_id").agg(
        F.max(F.when(F.col("type") == "request", ask)).alias("request"),
        F.max(F.when(main, body)).alias("response"),
        F.count(F.when(main, F.lit(1))).alias("copies"),
        F.max(F.when(F.col("type") == "metadata", about)).alias("metadata"),
        F.max(F.when(main, F.col("uri"))).alias("uri"),
    )
    return grouped.select("capture_id", F.col("metadata.page_id").alias("page_id"), "uri", "request", "response", "metadata", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), "copies"))).alias("_copy")).drop("_copy")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages, reads the archives back, assembles them, and reports page_id, payload_bytes,
    payload_digest, record_type and refers_to (the page whose response a revisit stands for)."""
    captures = assemble(read_records(write_archives(pages, least), with_payload=False))
    flat = common.staged(
        captures.select(
            "capture_id", "page_id", F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
            F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to"),
        ), "captures",
    )
    # the responses that are revisited, each once: names to pages
    wanted = flat.where("_to is not null").select("_to").distinct()
    named = flat.where("record_type = 'response'").select(F.col("capture_id").alias("_to"), F.col("page_id").alias("refers_to"))
    named = wanted.join(named, "_to").groupBy("_to").agg(F.max("refers_to").alias("refers_to"))
    out = flat.join(named, "_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
