"""WARC archives as a Spark data source (format ``warc``), and page archives with revisit records.

Writing: each task writes files of about ``max_file_bytes`` under names of its
own; the commit lists them in a manifest, so files of lost or repeated tasks are
never read. The manifest also holds split points, record starts about
``split_bytes`` apart.

Reading: the plan has one partition per split (per file where there is no
manifest). Equality, IN and prefix predicates on the header columns are pushed
down. A record's header is parsed first; a record that the predicates reject, or
any block when ``payload`` is ``false``, is skipped by seeking, not decoded.

With ``compression`` ``gzip`` each record is a gzip member whose extra field ``SL`` holds the member's length, so
records are skipped without inflating them; from the first member without it on, a file is read in sequence.

Paths may be on any file system that pyarrow opens by URI. A folder with manifests holds what they list; other files in
it are leftovers of lost tasks and are not read, unless the option ``unlisted`` is ``true``.

Defined cases: a null payload is an empty one; a null header value leaves the
header out and reads back as null; line breaks in header values are written
percent-encoded; an empty frame gives an archive without records, which reads
back as no rows; repeated rows give repeated records.
"""

from __future__ import annotations

import datetime
import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, StringStartsWith,
    WriterCommitMessage,
)

from fieldlake.llm.common import col
from fieldlake.session import cut_lineage, shared_dir

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes bigint, payload binary"
)
#: Header names of the format, and one extension for the size of the whole payload.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Bytes",
}
_COLUMN = {v.lower(): k for k, v in HEADERS.items()}
VERSION = b"WARC/1.1"
MIN_REVISIT_BYTES = 100
_ARROW = pa.schema([
    *((n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A").strip(" \t")


def record_bytes(row: dict) -> bytes:
    """One record: header lines, an empty line, the block, two line ends."""
    payload = row["payload"] or b""
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    lines = [VERSION.decode()]
    for name, header in HEADERS.items():
        value = size if name == "payload_bytes" else row[name]
        if value is not None:
            lines.append(f"{header}: {_clean(str(value))}")
    if row["record_type"] == "response":
        lines.append("Content-Type: application/http; msgtype=response")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"" if row["record_type"] == "revisit" else payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with its own length and that of the data in the extra field ``SL``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sH", 12, b"SL", 8)
    sizes = struct.pack("<II", len(head) + 8 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return head + sizes + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member(source) -> tuple[int, int] | None:
    """(start of the deflated data, end of the member) of the member that starts here; None without ``SL``."""
    start = source.tell()
    head = source.read(24)
    if len(head) == 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[10:16] == struct.pack("<H2sH", 12, b"SL", 8):
        return start + 24, start + struct.unpack("<I", head[16:20])[0]
    source.seek(start)
    return None


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, list[int], int]]):
        self.files = files


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.max_file = int(options.get("max_file_bytes", 256 << 20))
        self.split = int(options.get("split_bytes", 16 << 20))
        self.gzip = str(options.get("compression", "none")).lower() == "gzip"
        self.date = options.get("date") or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done, out, at, splits, name = [], None, 0, [], ""
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    out, at, splits = system.open_output_stream(f"{folder}/{name}", compression=None), 0, [0]
                row["date"] = row.get("date") or self.date
                data = record_bytes(row)
                data = gzip_member(data) if self.gzip else data
                if at - splits[-1] >= self.split:
                    splits.append(at)
                out.write(data)
                at += len(data)
                if at >= self.max_file:
                    out.close()
                    done, out = [*done, (name, splits, at)], None
        if out is not None:
            out.close()
            done.append((name, splits, at))
        return _Files(done)

    def commit(self, messages: list[_Files | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        listed = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[_Files | None]) -> None:
        system, folder = _open(self.path)
        for message in messages:
            for name, _, _ in message.files if message is not None else ():
                system.delete_file(f"{folder}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.unlisted = str(options.get("unlisted", "false")).lower() == "true"
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS or name == "payload_bytes":
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(x for x in f.value if x is not None)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, folder = _open(self.path)
        found = system.get_file_info(fs.FileSelector(folder))
        manifests = [x.path for x in found if x.base_name.startswith("manifest-")]
        if not manifests:
            return [_Split(x.path, 0, None) for x in found if x.base_name.endswith((".warc", ".warc.gz"))] or [_Split("", 0, 0)]
        splits, listed = [], set()
        for path in manifests:
            with system.open_input_stream(path) as f:
                for name, starts, size in json.loads(f.read()):
                    listed.add(name)
                    splits += [_Split(f"{folder}/{name}", a, b) for a, b in zip(starts, [*starts[1:], size])]
        if self.unlisted:
            splits += [_Split(x.path, 0, None) for x in found if x.base_name.endswith((".warc", ".warc.gz")) and x.base_name not in listed]
        return splits or [_Split("", 0, 0)]  # nothing to read

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            got = row[name]
            if got is None or (got not in value if kind == "in" else not got.startswith(value)):
                return False
        return True

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as raw:
            raw.seek(partition.start)
            stop = None if partition.end is None else partition.end - partition.start
            source = io.BufferedReader(_Part(raw, stop), 1 << 18)
            if not partition.path.endswith(".gz"):
                found = self.records(source)
            elif (first := _member(source)) is not None:
                source.seek(first[0] - 24)
                found = self.members(source)
            else:
                found = self.records(gzip.GzipFile(fileobj=source))
            rows, size = [], 0
            for row in found:
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size >= self.batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def members(self, source) -> Iterator[dict]:
        """Records in members with known lengths, of which only the beginning is inflated unless the record is wanted.

        From the first member without a length on all are read in sequence.
        """
        while (place := _member(source)) is not None:
            begin, end = place
            unpack = zlib.decompressobj(-15)
            head = unpack.decompress(source.read(min(2048, end - 8 - begin)), 8192)
            if b"\r\n\r\n" in head:
                row, _ = self.header(io.BytesIO(head))
                if not self.wanted(row) or not self.payload:
                    source.seek(end)
                    if self.wanted(row):
                        yield row
                    continue
            source.seek(begin)
            yield from self.records(io.BytesIO(zlib.decompress(source.read(end - 8 - begin), -15)))
            source.seek(end)
        # members of another writer follow, or nothing
        yield from self.records(gzip.GzipFile(fileobj=source))

    def header(self, source) -> tuple[dict, int] | None:
        """The next record's header columns and the length of its block."""
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        row, length = dict.fromkeys(_ARROW.names), 0
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "content-length":
                length = int(value)
            elif key in _COLUMN:
                row[_COLUMN[key]] = int(value) if _COLUMN[key] == "payload_bytes" else value
        return row, length

    def records(self, source) -> Iterator[dict]:
        while (head := self.header(source)) is not None:
            row, length = head
            if not self.wanted(row) or not self.payload:
                source.seek(length, io.SEEK_CUR)
                if self.wanted(row):
                    yield row
                continue
            block = source.read(length)
            row["payload"] = block.partition(b"\r\n\r\n")[2] if row["record_type"] == "response" else block
            yield row


class _Part(io.RawIOBase):
    """A file from where it stands, ``size`` bytes long; seeking forward costs no read."""

    def __init__(self, raw: pa.NativeFile, size: int | None):
        self.raw, self.start = raw, raw.tell()
        self.size = raw.size() - self.start if size is None else size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.raw.tell() - self.start

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self.tell(), io.SEEK_END: self.size}[whence]
        self.raw.seek(self.start + min(max(base + offset, 0), self.size))
        return self.tell()

    def readinto(self, buffer) -> int:
        data = self.raw.read(min(len(buffer), self.size - self.tell()))
        buffer[: len(data)] = data
        return len(data)


def use_warc(spark: SparkSession) -> SparkSession:
    """Register the format, and allow predicates to reach Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return use_warc(spark).read.format("warc").options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Append records (the columns of ``SCHEMA``; missing ones are null) to the archive at ``path``."""
    use_warc(records.sparkSession)
    have = {c.lower() for c in records.columns}
    fields = [part.split() for part in SCHEMA.split(", ")]
    chosen = [(col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields]
    records.select(*chosen).write.format("warc").mode("append").options(**options).save(path)


def page_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records of pages: of equal payloads that with the smallest page_id is a response, the others revisit it.

    Only digests and ids are aggregated. A null page_id comes after all others; rows that repeat the smallest page_id
    are all responses.
    """
    payload = F.coalesce(F.encode(col("html").cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(
        col("page_id").cast("bigint").alias("page_id"), col("url").cast("string").alias("target_uri"), payload.alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    firsts = rows.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = cut_lineage(firsts)  # a join with shuffles of its own: hot digests can be split
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.join(firsts, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"),
        "target_uri", F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive of ``pages`` and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Size and digest of a response are those of the payload that was read; a revisit has them in its header only, so its
    block is never decoded.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path, compression="gzip")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    responses = read_warc(spark, path).filter(F.col("record_type") == "response").select(
        page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"), "target_uri",
    )
    revisits = read_warc(spark, path, payload="false").filter(F.col("record_type") == "revisit").select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type",
        page(F.col("refers_to")).alias("refers_to"), "target_uri",
    )
    return responses.unionByName(revisits)
