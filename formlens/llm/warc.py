"""WARC archives of pages: records compressed one by one with a dictionary that the archive carries."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, sampled, stored
from formlens.session import scratch_path

# Values of the WARC and Zstandard formats.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"

SAMPLE_RECORDS = 400
SAMPLE_RECORD_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20
LEVEL = 3

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "null") else int(name)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, date: str, refers_to: int | None = None
) -> bytes:
    """One WARC record; without a payload a revisit, which has that payload's digest and size."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(size)),
    ]
    if url is not None:
        # A header is one line; line breaks and per cent signs in a URL are escaped and restored.
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"".join((f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass"), block, BREAK, BREAK))


def parse_record(record: bytes) -> tuple:
    """A record's row of ``RECORDS``; what a response says of its payload is checked against the payload."""
    head, _, rest = record.partition(BREAK + BREAK)
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or rest[len(block) :] != BREAK + BREAK:
        raise ValueError("a WARC record does not end where its header says")
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(BREAK + BREAK)[2]
        if len(payload) != size or payload_digest(payload) != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its header")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return _page(fields["WARC-Record-ID"]), url, size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))


def _dictionary(pages: DataFrame, date: str, sample: int) -> bytes:
    """A Zstandard dictionary of about ``sample`` records, chosen by hash, none over 64 KiB.

    Too few records to train on make a dictionary of plain content.
    """
    rows = (
        sampled(pages, sample, "page_id", "html")
        .filter(F.coalesce(F.octet_length("html"), F.lit(0)) <= SAMPLE_RECORD_BYTES)
        .limit(2 * sample)
        .collect()
    )
    records = []
    for row in sorted(rows, key=lambda row: (row.page_id is None, row.page_id or 0)):
        payload = (row.html or "").encode("utf-8", "surrogatepass")
        records.append(record_bytes(row.page_id, row.url, payload, len(payload), payload_digest(payload), date))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[-DICTIONARY_BYTES:]


class _Archive:
    """One archive: the dictionary in a skippable frame, then a frame per record."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{name}"
        self.files.create_dir(root, recursive=True)
        self.out = self.files.open_output_stream(f"{self.path}.open")
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
        self.n_bytes, self.n_records = 8 + len(dictionary), 0

    def add(self, frame: bytes) -> None:
        self.out.write(frame)
        self.n_bytes += len(frame)
        self.n_records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(f"{self.path}.open", self.path)
        return self.path.rpartition("/")[2], self.n_records, self.n_bytes


def write_archives(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    sample: int = SAMPLE_RECORDS,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page ``(page_id, url, html)`` below ``folder``; the manifest of the archives.

    Among pages with equal payloads of ``min_revisit_bytes`` or more that with the largest id is a
    response and the others are revisits of it. Which id that is, is a combined maximum per digest; a
    payload shared by a large part of all pages makes a skewed join, which Spark splits.

    Null html is an empty payload. A null url leaves its header out. Null ids are written as such and
    are never the largest unless the group has no other. Rows that repeat the largest id with its
    payload are all responses. An empty table writes nothing. Other columns are ignored.

    ``folder`` is a place that all executors share. A task names its archives by its attempt and the
    manifest names those of the attempts that counted, so a lost executor leaves no record twice.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html")
    dictionary = spark.sparkContext.broadcast(_dictionary(pages, date, sample))
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit(""))))
    keyed = pages.withColumn("digest", digest)
    latest = keyed.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("latest"))
    latest = stored(latest, "latest-pages")  # a join of two shuffled scans is one that Spark can split at a common payload
    joined = keyed.join(latest.hint("shuffle_hash"), "digest")
    revisits = (F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest"))
    rows = joined.select("page_id", "url", F.when(~revisits, F.col("html")).alias("html"), "digest", revisits.alias("revisits"),
                         F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"), "latest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary.value)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        archive, closed = None, []
        for batch in batches:
            for page_id, url, html, sha1, revisit, size, latest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = None if revisit else (html or "").encode("utf-8", "surrogatepass")
                record = record_bytes(page_id, url, payload, size, base64.b32encode(sha1).decode(), date, latest)
                if archive is None or archive.n_bytes >= archive_bytes:
                    if archive is not None:
                        closed.append(archive.close())
                    archive = _Archive(folder, f"{name}-{len(closed):04d}.warc.zst", dictionary.value)
                archive.add(compressor.compress(record))
        if archive is not None:
            closed.append(archive.close())
        columns = list(zip(*closed, strict=True)) or [[], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "n_records", "n_bytes"])

    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def archive_records(content: memoryview) -> Iterator[bytes]:
    """The records of an archive, decompressed one frame at a time."""
    magic, size = struct.unpack("<II", content[:8])
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    shared = zstandard.ZstdCompressionDict(bytes(content[8 : 8 + size]))
    reader = zstandard.ZstdDecompressor(dict_data=shared)
    at = 8 + size
    while at < len(content):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            chunk = content[at : at + 16_384]
            if not len(chunk):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row per record of the archives that ``manifest`` names, each checked against its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for content in batch.column(0):
                rows = [parse_record(record) for record in archive_records(memoryview(content.as_buffer()))]
                columns = zip(*rows, strict=True)
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    named = files.join(manifest.select(F.col("path").alias("name")), "name", "left_semi")
    return named.select("content").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read the archives back: a row per record."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, min_revisit_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, folder, manifest)
