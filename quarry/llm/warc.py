"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The reader deals byte ranges to tasks. A task looks for the gzip magic in its range, takes a candidate for a member only if
its first bytes inflate to a WARC version line, and owns each record whose member starts inside the range; the last one may
end beyond it. Members that follow a valid one are found by inflating, so compressed bytes that look like a header cost one
failed probe and give no record. (An archive stored uncompressed inside a record is the one thing that such a probe can't
tell from a record when a range happens to start inside it; the writer here always deflates.)
"""

import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROBE_BYTES, READ_BYTES = 4096, 1 << 20
RECORD_SCHEMA = "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def open_file(uri: str, mode: str):
    """A stream of bytes in any store that pyarrow knows: local, HDFS, S3, GCS."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store, path, store.open_output_stream(path, compression=None)
    return store, path, store.open_input_file(path)


def header_value(x) -> str:
    """Header lines can't hold line ends or other control characters; those are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in x)


def record_bytes(record_id: str, record_type: str, uri, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit holds no payload, only its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{header_value(record_id)}>", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {header_value(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{header_value(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records: record_id, record_type, target_uri, refers_to (strings), payload (binary), payload_digest. One archive a
    partition, under a name that no other attempt uses: a repeated task leaves at most a file that the manifest
    doesn't name. Returns the manifest (file, size, records)."""

    def write(batches):
        file = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for x in batches:
            for rid, kind, uri, ref, payload, digest in zip(x.record_id, x.record_type, x.target_uri, x.refers_to, x.payload, x.payload_digest):
                if out is None:
                    _, _, out = open_file(file, "w")
                member = record_bytes(rid, kind, None if pd.isna(uri) else uri, bytes(payload), digest, None if pd.isna(ref) else ref)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [file], "size": [size], "records": [n]})

    cols = ["record_id", "record_type", "target_uri", "refers_to", "payload", "payload_digest"]
    return records.select(cols).mapInPandas(write, "file string, size long, records long")


class Members:
    """The gzip members of one archive that start in [start, end)."""

    def __init__(self, stream, size: int, start: int, end: int):
        self.stream, self.size, self.at, self.end = stream, size, start, min(end, size)

    def read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(min(n, self.size - at))

    def valid(self, head: bytes) -> bool:
        try:
            return zlib.decompressobj(31).decompress(head, len(VERSION)) == VERSION
        except zlib.error:
            return False

    def first(self, at: int) -> int:
        """The first member that starts at or after a place, or the end of the range."""
        while at < self.end:
            data = self.read(at, READ_BYTES + PROBE_BYTES)
            found = data.find(MAGIC)
            while 0 <= found < READ_BYTES and at + found < self.end:
                if self.valid(data[found : found + PROBE_BYTES]):
                    return at + found
                found = data.find(MAGIC, found + 1)
            at += READ_BYTES
        return self.end

    def __iter__(self):
        at = self.first(self.at)
        while at < self.end:
            inflate, parts, pos, left = zlib.decompressobj(31), [], at, b""
            try:
                while not inflate.eof:
                    data = self.read(pos, READ_BYTES)
                    if not data:
                        raise zlib.error("torn member")
                    pos += len(data)
                    parts.append(inflate.decompress(data))
                left = inflate.unused_data
            except zlib.error:  # damaged: the next member that can be read goes on
                at = self.first(at + 1)
                continue
            body = b"".join(parts)
            if body.startswith(VERSION):
                yield at, body
            nxt = pos - len(left)
            at = nxt if nxt >= self.end or self.valid(self.read(nxt, PROBE_BYTES)) else self.first(nxt)


def parse(body: bytes) -> tuple[dict, bytes]:
    head, _, block = body.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = block[: int(fields.get("content-length", len(block)))]
    if "application/http" in fields.get("content-type", "") and b"\r\n\r\n" in block:
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def read_archives(files: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """files: file, size. Splits each into ranges of range_bytes and returns RECORD_SCHEMA. The digest and the length are
    of the payload as read; a revisit's are those in its header, as its payload stands in the record it refers to."""

    def read(batches):
        name = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v is not None else None
        for x in batches:
            for file, size, start in zip(x.file, x["size"], x.start):
                _, _, stream = open_file(file, "r")
                rows, held = [], 0
                for at, body in Members(stream, int(size), int(start), int(start) + range_bytes):
                    f, payload = parse(body)
                    kind, whole = f.get("warc-type"), f.get("warc-type") != "revisit"
                    rows.append((file, at, name(f.get("warc-record-id")), kind, f.get("warc-target-uri"), name(f.get("warc-refers-to")), len(payload) if whole else int(f.get("x-payload-length", 0)), hashlib.sha256(payload).hexdigest() if whole else f.get("warc-payload-digest", "").removeprefix("sha256:"), payload if whole else None))
                    held += len(payload)
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                stream.close()
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    ranges = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))).alias("start"))
    n = ranges.sparkSession.sparkContext.defaultParallelism * 4
    return ranges.repartition(n, "file", "start").mapInPandas(read, RECORD_SCHEMA)


def archive_records(pages: DataFrame, scratch: Scratch, min_bytes: int = 100) -> DataFrame:
    """pages (page_id, url, html) as records. Of the pages with equal payloads of at least min_bytes the smallest page_id is
    the response and the others revisit it. A null html is an empty payload. Rows that share that smallest page_id are the
    same record and each a response; a row without page_id can only revisit, or respond where no page of its payload has one."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    # Only payloads that occur twice go on: a table of one narrow row each, written, so that the join below is between two
    # plain exchanges, which Spark splits where one payload holds many of the rows (or broadcasts, where the table is small).
    twice = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .select("page_id", F.unhex("payload_digest").alias("d")).groupBy("d").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null").select(F.lower(F.hex("d")).alias("payload_digest"), "first_id")
    )
    twice = scratch.save(twice, "twice")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(twice, "payload_digest", "left").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, F.col("first_id").cast("string")).alias("refers_to"),
        "payload",
        "payload_digest",
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives of the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    scratch = Scratch(spark, "warc")
    manifest = scratch.save(write_archives(archive_records(pages, scratch), f"{scratch.path}/archives"), "manifest")
    got = read_archives(manifest)
    return got.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "target_uri",
    )
