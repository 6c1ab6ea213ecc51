"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of about `frame_bytes` of records, then a skippable frame with the
seek table (sizes of each frame, in the published seekable format), which ends the file. An index maps each record to
its bundle, frame and offset within the frame, so one record is read by decompressing one frame. Tasks write bundles with
pyarrow's file systems below the shared folder, under names of their own attempt; only bundles named in the index count,
so a lost or repeated task leaves nothing behind that is read.

Defined cases: a null payload is empty; a null page id is written without a page header and comes back null; ids repeated
with equal payloads are each written, and all rows that carry the largest id of equal payloads are responses; if such a
group has null ids only, all are responses. A null url gives a record without a target. An empty table gives an empty
index and an empty result. Only the id, url and payload column are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import lookup_join, shared_dir, staged, table

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 256 << 20
#: Fixed values of the published seekable Zstandard format and of WARC/1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_size long, offset int, size int"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """Record id and bytes of one WARC record. A revisit has the HTTP head only; the payload is that of the response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    record_id = f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{url}|{digest}'.encode()).hexdigest())}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return record_id, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields; the payload and its digest are of the bytes read, a revisit's come from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    page, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != declared):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": None if page is None else int(page),
        "payload_bytes": length,
        "payload_digest": declared,
        "record_type": fields["WARC-Type"],
        "refers_to": None if to is None else int(to),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """Appends records to one bundle; close() writes the seek table."""

    def __init__(self, folder: str, frame_bytes: int) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path, self.frame_bytes = f"{root}/{uuid.uuid4().hex}.warc.zst", frame_bytes
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.at, self.buffer, self.waiting = 0, io.BytesIO(), []

    def add(self, key: tuple, data: bytes) -> list[tuple]:
        self.waiting.append((*key, self.buffer.tell(), len(data)))
        self.buffer.write(data)
        return self.flush() if self.buffer.tell() >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        """Ends the frame; returns its records' index rows."""
        if not self.waiting:
            return []
        raw = self.buffer.getvalue()
        frame = zstandard.ZstdCompressor(level=3).compress(raw)
        self.out.write(frame)
        rows = [(page, rid, self.path, len(self.frames), self.at, len(frame), offset, size) for page, rid, offset, size in self.waiting]
        self.frames.append((len(frame), len(raw)))
        self.at += len(frame)
        self.buffer, self.waiting = io.BytesIO(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()
        return rows


def seek_table(data: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the table that ends the bundle."""
    data.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", data.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    data.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", data.read(8 * count)))
    starts = [0]
    for packed, _ in sizes:
        starts.append(starts[-1] + packed)
    return [(s, *x) for s, x in zip(starts, sizes, strict=False)]


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        to_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)
        writer = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                writer = writer or BundleWriter(folder, frame_bytes)
                rid, data = record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"], date)
                rows += writer.add((r["page_id"], rid), data)
                if writer.at >= bundle_bytes:
                    rows += writer.close()
                    writer = None
            if rows:
                yield to_batch(rows)
        if writer and (rows := writer.close()):
            yield to_batch(rows)

    return write


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit. Equal payloads: same length, SHA-1 and SHA-256."""
    rows = pages.withColumn("digest", F.sha1("payload")).withColumn("strong", F.unhex(F.sha2("payload", 256)))
    large = rows.filter(F.octet_length("payload") >= revisit_bytes)
    shared = staged(large.groupBy("strong").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1 and last_id is not null").drop("n"), "warc-shared")
    out = lookup_join(rows, shared, ["strong"], "left", ["page_id", "url"])
    revisit = F.expr(f"last_id is not null and octet_length(payload) >= {int(revisit_bytes)} and not (page_id <=> last_id)")
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("last_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes bundles below folder, and the index as Parquet in folder/index; returns the index."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    index = with_revisits(rows, revisit_bytes).mapInArrow(_writer(f"{folder}/bundles", frame_bytes, bundle_bytes, date), INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")][: None if with_payload else -1]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        path, source, table_, raw, at = None, None, [], b"", None
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != path:
                    path = r["bundle"]
                    source = fs.open_input_file(path)
                    table_, at = seek_table(source, source.size()), None
                if r["frame"] != at:
                    at = r["frame"]
                    start, packed, _ = table_[at]
                    source.seek(start)
                    raw = unpack.decompress(source.read(packed))
                rows.append(parse_record(raw[r["offset"] : r["offset"] + r["size"]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, kinds, strict=False)], names)

    return read


def read_archive(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that index names, read from their bundles; filter the index first to read single records.

    Rows are dealt out by frame, so each frame is decompressed once and no task holds more than a frame.
    """
    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(_reader(folder, with_payload), RECORD if with_payload else RECORD.rpartition(", ")[0])


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(index, folder, with_payload=False).drop("url")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM p
"""
