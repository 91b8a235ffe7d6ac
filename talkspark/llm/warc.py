"""WARC: a normaliser of monolithic gzip archives (operator 10).

Pages become WARC/1.1 records in archives that are one gzip stream each. ``normalise`` inflates
such a stream once, from front to back, and rewrites every record as a gzip member of its
own, with a sidecar index of (record, offset, length); ``read_records`` then inflates single
members by the index. Of pages with equal payloads of at least ``least`` bytes, the one with the
smallest page_id is a response and the others are revisits that refer to it.

Only digests are grouped. Those that repeat are staged, so that Spark sends them to the pages where
they are few; very common ones always go that way, so that no page's payload gathers in one task.

Archives hold about ``archive_bytes`` of payload, or one record. They are kept as binary rows of
staged tables, which any store that Spark writes can hold; ``export_files`` writes them as
.warc.gz files with a .cdx.json beside each, and ``read_files`` reads such files. One record at
a time is in memory beside its archive.

Nulls: null html is an empty payload, a null url an empty target; pages with null page_id are
kept, never referred to, and revisit the smallest page_id with their payload. Repeated rows:
each gets a record; all rows with the smallest page_id are responses. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm.common import Staged, read_table

HOT = 1000
_GZIP = 31  # zlib's window bits for gzip
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id: object, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}' if page_id is not None else place)}>"


def make_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, place: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, place)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        *([] if refers_to is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, '')}", f"X-Refers-To-Page: {refers_to}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from pieces of a stream of them."""
    buf = bytearray()
    need = -1  # bytes of the record at the front, once its header is whole
    for piece in pieces:
        buf += piece
        while True:
            if need < 0:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                m = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", buf[: end + 2])
                if not m:
                    raise ValueError("a WARC record without Content-Length")
                need = end + 4 + int(m[1]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = -1
    if buf.strip():
        raise ValueError(f"{len(buf)} bytes after the last whole WARC record")


def inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    at, d = 0, zlib.decompressobj(_GZIP)
    while at < len(data):
        piece = data[at : at + step]
        at += len(piece)
        while piece:
            yield d.decompress(piece)
            piece = b""
            if d.eof:
                piece, d = d.unused_data, zlib.decompressobj(_GZIP)
    yield d.flush()


def normalise_stream(data: bytes, level: int = 6) -> tuple[bytes, list[dict]]:
    """(the same records, each its own gzip member; their index)."""
    out, index = bytearray(), []
    for record in split_records(inflate(data)):
        c = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
        member = c.compress(record) + c.flush()
        head = parse_head(record)[0]
        index.append({"record_id": head.get("warc-record-id", ""), "offset": len(out), "length": len(member)})
        out += member
    return bytes(out), index


def parse_head(record: bytes) -> tuple[dict[str, str], int]:
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


INDEX = "array<struct<record_id:string,offset:long,length:long>>"
_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def write_monolithic(pages: DataFrame, *, least: int = 100, archive_bytes: int = 8 << 20, level: int = 1) -> DataFrame:
    """(archive, data): gzip streams of many records."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    same = Staged(pages.sparkSession, "digests").put(same, "repeated")
    # payloads of more than a page in HOT: at most HOT of them, so they are sent to all; the rest meet by digest
    total = pages.count()
    common = same.where(F.col("n") * HOT > total).select("digest", F.col("first").alias("common"))
    rows = rows.join(F.broadcast(common), "digest", "left")
    key = F.when(F.col("common").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "digest", F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(same.where(F.col("n") * HOT <= total).select(F.col("digest").alias("key"), "first"), "key", "left")
    first = F.coalesce("common", "first")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, stream, out = TaskContext.get().partitionId(), 0, 0, None, bytearray()

        def close() -> pa.RecordBatch:
            nonlocal n, size, stream, out
            out += stream.flush()
            row = pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}"]), pa.array([bytes(out)], pa.binary())], ["archive", "data"])
            n, size, stream, out = n + 1, 0, None, bytearray()
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                if stream is not None and size + len(payload) > archive_bytes:
                    yield close()
                stream = stream or zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                out += stream.compress(make_record(page_id, url, payload, digest, refers_to, f"{part}-{n}-{size}-{i}"))
                size += len(payload)
        if stream is not None:
            yield close()

    return rows.mapInArrow(work, "archive string, data binary")


def normalise(archives: DataFrame, *, level: int = 1) -> DataFrame:
    """(archive, data, index): each record a member of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, index = normalise_stream(batch.column("data")[i].as_py(), level)
                yield pa.RecordBatch.from_arrays([batch.column("archive").slice(i, 1), pa.array([data], pa.binary()), pa.array([index], _INDEX)], ["archive", "data", "index"])

    return archives.select("archive", "data").mapInArrow(work, f"archive string, data binary, index {INDEX}")


def read_records(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row a record, each member inflated alone by the index: archive, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, rows = batch.column("archive")[i].as_py(), batch.column("data")[i].as_buffer(), []
                view = memoryview(data)
                for entry in batch.column("index")[i].as_py():
                    record = zlib.decompress(view[entry["offset"] : entry["offset"] + entry["length"]], _GZIP)
                    head, start = parse_head(record)
                    block = record[start : start + int(head["content-length"])]
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if f"sha256:{digest}" != head["warc-payload-digest"]:
                            raise ValueError(f"{name} at {entry['offset']}: the payload doesn't match its digest")
                    else:
                        n, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((name, entry["offset"], head.get("x-page-id"), head.get("warc-target-uri"), n, digest, head["warc-type"], head.get("x-refers-to-page")))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["archive", "offset", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    out = archives.mapInArrow(work, "archive string, offset long, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def export_files(archives: DataFrame, uri: str) -> DataFrame:
    """Writes normalised archives as files from the executors, to a URI that pyarrow opens; (archive, bytes). Run it by an action."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                for suffix, content in ((".warc.gz", r["data"]), (".cdx.json", json.dumps(r["index"]).encode())):
                    with fs.open_output_stream(f"{root}/{r['archive']}{suffix}", compression=None) as f:
                        f.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([r["archive"]]), pa.array([len(r["data"])], pa.int64())], ["archive", "bytes"])

    import pyarrow.fs  # noqa: F401

    return archives.mapInArrow(work, "archive string, bytes long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of .warc.gz files in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.warc\.gz$", 1).alias("archive"), F.col("content").alias("data"))


def roundtrip(pages: DataFrame) -> DataFrame:
    st = Staged(pages.sparkSession, "warc")
    st.put(write_monolithic(pages), "monolithic")
    spark = pages.sparkSession
    st.put(normalise(spark.read.parquet(f"{st.root}/monolithic")), "normalised")
    st.drop("monolithic")
    return read_records(spark.read.parquet(f"{st.root}/normalised"), pages.schema["page_id"].dataType.simpleString())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, octet_length(encode(h))::bigint payload_bytes, sha256(h) payload_digest, min(page_id) over (partition by h) first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id is distinct from first and first is not null then 'revisit' else 'response' end record_type,
case when payload_bytes >= 100 and page_id is distinct from first then first end refers_to from q"""
