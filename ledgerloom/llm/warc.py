"""WARC archives as seekable Zstandard bundles.

A bundle is a row of the archive table; its content is one Zstandard file: independent frames of whole
records, a skippable frame with the index (record id to frame and offset inside the frame), and a skippable
frame with the seek table (compressed and plain size of each frame), whose footer ends the file. One record is
read by the footer, the index and one frame. The table is Parquet, so it can lie in any store Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_path, small_batches

# Fixed values of the seekable format and of WARC 1.1.
SEEK_FRAME, INDEX_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
ARCHIVE = "bundle long, n_records long, content binary"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the records that repeat a payload of at least `min_bytes`.

    The largest id of equal payloads (same SHA-1 and length) holds the payload. Only ids and digests are
    shuffled, counted per task first; a payload with very many copies is a skewed join key, which adaptive
    execution splits. Rows without an id are always responses.
    """
    body = payload(F.col(html_col))
    narrow = pages.select(F.col(id_col).alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    narrow = narrow.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    groups = (narrow.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
              .where("least <> refers_to").drop("least"))
    return narrow.join(groups, ["digest", "n"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def record(page_id, url: str | None, body: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url or ""),
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


class Bundle:
    """Collects records into frames; `close` gives the file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.open, self.frames, self.sizes, self.index, self.size = frame_bytes, bytearray(), [], [], {}, 0
        self.n_records = 0

    def add(self, name: str, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self._end_frame()
        self.index.setdefault(name, []).append([len(self.frames), len(self.open), len(data)])
        self.open += data
        self.n_records += 1

    def _end_frame(self) -> None:
        if self.open:
            packed = zstandard.ZstdCompressor(level=3).compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.size += len(packed)
            self.open = bytearray()

    def close(self) -> bytes:
        self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_FOOTER)
        index = zstandard.compress(json.dumps(self.index).encode())
        return b"".join([*self.frames, _skippable(INDEX_FRAME, index), _skippable(SEEK_FRAME, table)])


def _seek_table(content: bytes) -> list[tuple[int, int]]:
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEK_FOOTER:
        raise ValueError("the bundle does not end with a seek table")
    return list(struct.iter_unpack("<II", content[-9 - 8 * n:-9]))


def _frame(content: bytes, at: int, size: int, plain: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(content[at:at + size], max_output_size=plain)


def read_record(content: bytes, name: str) -> list[bytes]:
    """The records with a name (several if rows were repeated), each by decompressing one frame."""
    sizes = _seek_table(content)
    starts = [0]
    for size, _ in sizes:
        starts.append(starts[-1] + size)
    n = struct.unpack("<I", content[starts[-1] + 4:starts[-1] + 8])[0]
    index = json.loads(zstandard.decompress(content[starts[-1] + 8:starts[-1] + 8 + n]))
    return [_frame(content, starts[frame], *sizes[frame])[at:at + size] for frame, at, size in index.get(name, [])]


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of all records of a bundle, a frame at a time."""
    at = 0
    for size, plain in _seek_table(content):
        frame, k = _frame(content, at, size, plain), 0
        while k < len(frame):
            head_end = frame.index(b"\r\n\r\n", k)
            head = dict(line.split(": ", 1) for line in frame[k:head_end].decode().split("\r\n")[1:])
            block = frame[head_end + 4:head_end + 4 + int(head["Content-Length"])]
            http_end = block.index(b"\r\n\r\n")
            head |= {f"http {a}": b for a, b in (line.split(": ", 1) for line in block[:http_end].decode().split("\r\n")[1:])}
            yield head, block[http_end + 4:]
            k = head_end + 8 + int(head["Content-Length"])
        at += size


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_bytes: int = MIN_REVISIT_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """All rows of `pages` as records in the archive table at `path`.

    NULL html is an empty payload, a NULL url an empty target; repeated rows are records each. Pages are
    archived where they are read, unless the join with the revisits has to shuffle them.
    """
    small_batches(pages.sparkSession)
    repeats = revisits(pages, id_col, html_col, min_bytes)
    body = payload(F.col(html_col))
    rows = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
            .join(repeats, ["page_id", "digest"], "left").select("page_id", "url", "body", "digest", "refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bundle = TaskContext.get().partitionId() << 32, Bundle()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([bundle.n_records], pa.int64()),
                                               pa.array([bundle.close()], pa.binary())], names=["bundle", "n_records", "content"])

        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(c for c in batch.columns)):
                page_id = page_id.as_py()
                bundle.add(str(page_id), record(page_id, url.as_py(), body.as_py(), digest.as_py(), refers_to.as_py()))
                if bundle.size >= bundle_bytes:
                    yield closed()
                    name, bundle = name + 1, Bundle()
        if bundle.n_records:
            yield closed()

    rows.mapInArrow(run, ARCHIVE).write.parquet(path)


def read(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in the archive table.

    The digest of each response is taken from its payload and must be the one in its head.
    """
    def name(text: str) -> str | None:
        return text.removeprefix("<urn:page:").removesuffix(">") or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, body in records(content.as_py()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have the digest of its head")
                    rows.append((name(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["http Content-Length"]), digest,
                                 head["WARC-Type"], name(head.get("WARC-Refers-To", ""))))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
                    "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = archives.select("content").mapInArrow(run, (
        "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archived(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write all pages to a new archive table in the shared folder and read every record back."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write(pages, path, id_col, **options)
    return read(spark.read.schema(ARCHIVE).parquet(path), pages.schema[id_col].dataType.simpleString())
