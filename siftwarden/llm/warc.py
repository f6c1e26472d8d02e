"""WARC archives as a Python data source, read and written.

``spark.read.format("warc")`` plans committed archive files into partitions by size,
takes over predicates on the record type and the header fields, parses a record's
headers first and goes on to its payload only if the record passes and the read schema
has a ``payload``. Each record is a gzip member that states its own length, so an
unwanted one is passed over without inflating it; archives whose members do not say so
are inflated only to find where the next one begins, and plain ``.warc`` files are
passed over by their Content-Length.

``df.write.format("warc")`` writes one file or more per task under names of their own
and lists them in a commit file when the job ends: files of failed attempts are never read.

Cases: null header fields are left out and read back as null; a null payload is empty;
control characters in a header value are percent-encoded; repeated rows are repeated
records; an empty table writes a commit file without archives and reads as no rows;
columns that are no WARC fields are refused by the writer.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)

FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
HEAD = 4096

# WARC header names of the columns.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", payload_bytes bigint, payload binary"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(row: dict) -> bytes:
    """One WARC record; a revisit has the HTTP head alone, which still states the payload's length."""
    payload = row.get("payload") or b""
    n = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    revisit = row.get("record_type") == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block += b"" if revisit else payload
    lines = ["WARC/1.1", *(f"{name}: {_clean(row[c])}" for c, name in FIELDS.items() if row.get(c) is not None)]
    lines += [f"WARC-Profile: {REVISIT_PROFILE}"] * revisit
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field states its length, deflated and plain."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path = path
        unknown = set(columns) - {*FIELDS, "payload_bytes", "payload"}
        if unknown:
            raise ValueError(f"no WARC fields: {sorted(unknown)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                if isinstance(row.get("payload"), str):
                    row["payload"] = row["payload"].encode()
                size += out.write(member(record(row)))
        if out is not None:
            out.close()
        message = WriterCommitMessage()
        message.names = names
        return message

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(f"{root}/{name}")


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class Source:
    """A buffered input that can hand out, look ahead and pass over bytes."""

    def __init__(self, stream) -> None:
        self.stream, self.held = stream, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.stream.read(max(1 << 16, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        data = self.peek(n)
        self.held = self.held[n:]
        return data

    def skip(self, n: int) -> None:
        have = min(n, len(self.held))
        self.held = self.held[have:]
        if n > have:
            self.stream.seek(n - have, io.SEEK_CUR)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records(source: Source, wanted, with_payload: bool) -> Iterator[tuple[dict, int, bytes | None]]:
    """Header fields, payload length and payload of the records that ``wanted`` accepts."""
    while magic := source.peek(24):
        if magic[:2] == b"\x1f\x8b":
            stated = magic[3] & 4 and magic[12:14] == b"sl"
            if stated:
                size = struct.unpack("<I", magic[16:20])[0]
                n = HEAD
                while True:
                    data = zlib.decompressobj(31).decompress(source.peek(min(size, n)), n * 4)
                    head, blank, _ = data.partition(b"\r\n\r\n")
                    if blank or n >= size and len(data) < n * 4:
                        break
                    n *= 2
                if blank and not wanted(_headers(head)):
                    source.skip(size)
                    continue
                whole_head = blank and data.find(b"\r\n\r\n", len(head) + 4) >= 0
                if whole_head and not with_payload:
                    source.skip(size)
                else:
                    data = zlib.decompress(source.take(size), 31)
            else:
                inflate, parts = zlib.decompressobj(31), []
                while not inflate.eof and (some := source.take(1 << 16)):
                    parts.append(inflate.decompress(some))
                source.held = inflate.unused_data + source.held
                data = b"".join(parts)
            head, _, block = data.partition(b"\r\n\r\n")
            fields = _headers(head)
            if not wanted(fields):
                continue
        else:
            n = HEAD
            while b"\r\n\r\n" not in (seen := source.peek(n)) and len(seen) == n:
                n *= 2
            head = seen.partition(b"\r\n\r\n")[0]
            fields = _headers(head)
            source.take(len(head) + 4)
            length = int(fields.get("content-length", 0))
            if not wanted(fields):
                source.skip(length + 4)
                continue
            if with_payload:
                block = source.take(length)
                source.skip(4)
            else:
                n = HEAD
                while b"\r\n\r\n" not in (block := source.peek(min(length, n))) and n < length:
                    n *= 2
                source.skip(length + 4)
        length = int(fields.get("content-length", 0))
        http, _, payload = block[:length].partition(b"\r\n\r\n")
        inner = _headers(http)
        n = int(inner["content-length"]) if "content-length" in inner else length - len(http) - 4
        yield fields, n, payload if with_payload else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in FIELDS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((FIELDS[column].lower(), "in", [f.value]))
            elif isinstance(f, In):
                self.tests.append((FIELDS[column].lower(), "in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((FIELDS[column].lower(), "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((FIELDS[column].lower(), "known", None))
            else:
                yield f

    def wanted(self, fields: dict) -> bool:
        for name, kind, value in self.tests:
            have = fields.get(name)
            if have is None or kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        found = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(root, recursive=False))}
        commits = [n for n in found if n.startswith("_committed-")]
        names = sorted(n for n in found if n.endswith((".warc", ".warc.gz")))
        if commits:
            names = sorted(x for n in commits for x in json.loads(fs.open_input_stream(f"{root}/{n}").read()))
        parts, size = [], PARTITION_BYTES
        for n in names:
            if size + found[n].size > PARTITION_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f"{root}/{n}")
            size += found[n].size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        types = {**{c: pa.string() for c in FIELDS}, "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, types[c]) for c in self.columns])
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for fields, n, payload in records(Source(stream), self.wanted, "payload" in self.columns):
                    row = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
                    rows.append({**row, "payload_bytes": n, "payload": payload})
                    size += 500 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives; without ``payload`` in the columns no payload is decoded."""
    register(spark)
    types = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {types[c]}" for c in columns or types)).load(path)


def revisits(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """WARC fields of pages: of equal payloads of ``least`` bytes or more the largest key responds.

    Only digests are grouped and joined first; the payload moves once, by key, to meet the
    verdict on it. Rows repeated with the responding key are all responses.
    """
    content = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(key).alias("key"), F.col("url"), content.alias("payload"), F.sha1(content).alias("digest"),
        F.octet_length(content).cast("bigint").alias("payload_bytes"),
    )
    large = rows.where(F.col("payload_bytes") >= least).select("key", "digest", "payload_bytes")
    first = large.groupBy("digest", "payload_bytes").agg(F.max("key").alias("first"))
    known = large.join(first, ["digest", "payload_bytes"]).where("key < first").select("key", "digest", "first").distinct()
    told = rows.join(known, ["key", "digest"], "left")
    again = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return told.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("key")).alias("record_id"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.col("url").alias("target_uri"),
        F.when(again, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records_table: DataFrame, path: str) -> None:
    register(records_table.sparkSession)
    records_table.write.format("warc").mode("append").save(path)

