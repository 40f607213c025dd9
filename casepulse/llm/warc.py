"""WARC archives as a Spark data source: ``warc``.

Reading plans one partition per group of files from their sizes. Wanted record types and values of
other header columns go to the reader as the option ``where``: it parses a record's headers first
and, if one has another value or the payload is not among the asked columns, moves on without
reading the block. (Spark can also push filters of a query to a Python source, but then keeps the
first query's for later queries over the same frame, which lose rows; so that is not used here.)
Writing gives each task files of its own, which the driver makes visible once all tasks are done.

A ``response`` record holds an HTTP answer with the payload; a ``revisit`` record holds the
answer's headers only and names the record with the equal payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from casepulse.llm.common import join_groups, whole
from casepulse.session import shared_folder
from casepulse.sources.writers import stage

#: Bytes of a file after which the next one begins, and of the files that one read task gets.
FILE_BYTES, TASK_BYTES = 64 << 20, 64 << 20
#: Bytes of the payloads in one batch of rows.
BATCH_BYTES = 8 << 20
#: Effort of the compression, and the extra field of a gzip member: name, size, length of the member and of the record.
LEVEL, _EXTRA = 1, struct.Struct("<2sHII")

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])
#: Header lines by column. payload_bytes comes from the HTTP headers, which a revisit keeps.
HEADERS = {
    "record_id": b"WARC-Record-ID", "record_type": b"WARC-Type", "target_uri": b"WARC-Target-URI",
    "payload_digest": b"WARC-Payload-Digest", "refers_to": b"WARC-Refers-To",
}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to else b"response"),
        b"WARC-Record-ID: " + _line(record_id), b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + sha1_base32(payload).encode(),
    ]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + _line(uri))
    if refers_to:
        lines += [b"WARC-Refers-To: " + _line(refers_to), b"WARC-Profile: " + _PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def _line(value: str) -> bytes:
    """A header's value; line breaks would end it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode()


def _value(line: bytes) -> str:
    return line.strip().decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def packed(data: bytes) -> bytes:
    """A record as a gzip member that names its own length, so that a reader can go past it."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = _EXTRA.pack(b"sl", 8, len(body) + 10 + 2 + _EXTRA.size + 8, len(data) & 0xFFFFFFFF)
    return (
        b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body
        + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    )


class Stream:
    """Lines and blocks of a file through one buffer. What is skipped beyond it is not read."""

    def __init__(self, file: pa.NativeFile, size: int = 1 << 16):
        self.file, self.size, self.buffer, self.at = file, size, b"", 0

    def more(self, n: int) -> bytes:
        return self.file.read(max(n, self.size))

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are in the buffer, or could be read into it."""
        if len(self.buffer) - self.at >= n:
            return True
        parts, held = [self.buffer[self.at:]], len(self.buffer) - self.at
        while held < n and (part := self.more(n - held)):
            parts.append(part)
            held += len(part)
        self.buffer, self.at = b"".join(parts), 0
        return held >= n

    def readline(self) -> bytes:
        end, seen = self.buffer.find(b"\n", self.at), len(self.buffer) - self.at
        while end < 0:
            if not self.fill(seen + 1):
                end = len(self.buffer) - 1
                break
            end, seen = self.buffer.find(b"\n", self.at), len(self.buffer) - self.at
        line = self.buffer[self.at:end + 1]
        self.at = end + 1
        return line

    def read(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("a WARC file ends inside a record")
        self.at += n
        return self.buffer[self.at - n:self.at]

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n > held:
            self.file.seek(n - held, 1)
            self.buffer, self.at = b"", 0
        else:
            self.at += n

    def ended(self) -> bool:
        """Whether only blank lines are left."""
        while self.fill(1) and self.buffer[self.at:self.at + 1] in (b"\r", b"\n"):
            self.at += 1
        return not self.fill(1)

    def take(self) -> bytes:
        """The rest of the buffer."""
        got, self.buffer, self.at = self.buffer[self.at:], b"", 0
        return got

    def give(self, unread: bytes) -> None:
        """Puts back what was read too far."""
        self.buffer, self.at = unread + self.buffer[self.at:], 0

    def another(self) -> bool:
        """Whether the same member holds another record."""
        return False

    def close(self) -> None:
        """The record is done with."""


class Member(Stream):
    """The records in the gzip member at the place of ``raw``; inflated only as far as it is read."""

    def __init__(self, raw: Stream):
        super().__init__(None)
        start = raw.read(10)
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.raw, self.left, flags = raw, None, start[3]
        if flags & 4:
            extra = raw.read(struct.unpack("<H", raw.read(2))[0])
            if extra[:2] == b"sl" and len(extra) == _EXTRA.size and not flags & ~4:
                self.left = _EXTRA.unpack(extra)[2] - 10 - 2 - len(extra) - 8
        for flag in (8, 16):  # a name, a comment
            while flags & flag and raw.read(1) != b"\0":
                pass
        if flags & 2:
            raw.read(2)
        self.inflate = zlib.decompressobj(-15)

    def more(self, n: int) -> bytes:
        while not self.inflate.eof:
            if self.left is None:
                part = self.inflate.unconsumed_tail or (self.raw.read(1) + self.raw.take())
            else:
                size = min(self.left, max(4096, n))
                part = self.inflate.unconsumed_tail + self.raw.read(size)
                self.left -= size
            got = self.inflate.decompress(part, max(4096, n))
            if not part and not got and not self.inflate.eof:
                raise ValueError("a gzip member ends too early")
            if self.inflate.unused_data:
                self.raw.give(self.inflate.unused_data)
            if got:
                return got
        return b""

    def skip(self, n: int) -> None:
        if self.left is None or n <= len(self.buffer) - self.at:
            self.read(n)

    def another(self) -> bool:
        return self.left is None and not self.ended()

    def close(self) -> None:
        if self.left is None:
            while self.more(1 << 16):
                pass
            self.raw.skip(8)
        else:
            self.raw.skip(self.left + 8)


def _headers(stream: Stream) -> dict[bytes, bytes]:
    """The header lines of the record at the stream's place."""
    while (line := stream.readline()) in (b"\r\n", b"\n"):
        pass
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC file ends inside a record")
        name, _, value = line.partition(b":")
        found[name.strip().lower()] = value
    return found


def _http(stream: Stream, length: int) -> tuple[int | None, int]:
    """Content-Length among the HTTP headers at the stream's place, and the bytes of the headers."""
    size, used = None, 0
    while used < length:
        line = stream.readline()
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            size = int(value)
    return size, used


@dataclass
class Files(InputPartition):
    """The files that one task reads."""

    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    """The files that one task wrote."""

    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(
        self, path: str, schema: T.StructType, where: Mapping[str, Sequence[str]] | None = None, verify: bool = False
    ):
        self.path, self.columns, self.verify = path, schema.fieldNames(), verify
        self.types = [f.dataType for f in schema]
        self.wanted = {column: set(values) for column, values in (where or {}).items()}
        if unknown := set(self.columns) - set(SCHEMA.fieldNames()) or set(self.wanted) - set(HEADERS):
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def partitions(self) -> list[InputPartition]:
        system, root = pafs.FileSystem.from_uri(self.path)
        found = [
            (i.path, i.size) for i in system.get_file_info(pafs.FileSelector(root))
            if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))
        ]
        out, held, size = [], [], 0
        for path, n in sorted(found):
            if held and size + n > TASK_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(tuple(held))] if held else out or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
        schema = pa.schema([(c, arrow[t]) for c, t in zip(self.columns, self.types, strict=True)])
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in self.records(Stream(file), path.endswith(".gz")):
                    rows.append(row)
                    held += 256 + sum(len(v) for v in row if isinstance(v, bytes))
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def records(self, file: Stream, gzipped: bool) -> Iterator[tuple]:
        """The asked columns of the records that pass the filters."""
        body = {"payload", "payload_bytes"} & set(self.columns)
        stream = None
        while stream or not file.ended():
            stream = stream or (Member(file) if gzipped else file)
            headers, used = _headers(stream), 0
            length = int(headers[b"content-length"])
            row = {c: _value(headers[h.lower()]) if h.lower() in headers else None for c, h in HEADERS.items()}
            digest = row["payload_digest"] or ""
            if digest:
                row["payload_digest"] = digest.removeprefix("sha1:")
            passes = all(row[c] in values for c, values in self.wanted.items())
            if passes and body:
                row["payload_bytes"], used = _http(stream, length)
            if passes and "payload" in body and row["record_type"] == "response":
                row["payload"] = stream.read(length - used)
                if self.verify and digest.startswith("sha1:") and sha1_base32(row["payload"]) != row["payload_digest"].upper():
                    raise ValueError(f"the payload of {row['record_id']} has another digest than its header: {digest}")
            else:
                stream.skip(length - used)
            if not stream.another():
                stream.close()
                stream = None
            if passes:
                yield tuple(row.get(c) for c in self.columns)


class WarcWriter(DataSourceArrowWriter):
    """Writes record_id, target_uri, payload and refers_to; a row with refers_to is a revisit."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.columns, self.overwrite = path, schema.fieldNames(), overwrite
        lacking = {"record_id", "target_uri", "payload", "refers_to"} - set(self.columns)
        if lacking:
            raise ValueError(f"missing columns: {sorted(lacking)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            picked = [batch.column(self.columns.index(c)) for c in ("record_id", "target_uri", "payload", "refers_to")]
            for row in zip(*picked, strict=True):
                record_id, uri, payload, refers_to = (v.as_py() for v in row)
                if out is None:
                    # A task that runs twice writes other names; only those it reports are published.
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}.tmp"), 0
                data = packed(record(record_id, uri, payload or b"", refers_to))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        old = [i.path for i in system.get_file_info(pafs.FileSelector(root)) if i.path.endswith((".warc", ".warc.gz"))]
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/{name}.tmp", f"{root}/{name}")
        for path in old if self.overwrite else ():
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(f"{root}/{name}.tmp")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; ``path`` is a URI of a folder that all machines reach."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        verify = json.loads(self.options.get("verify", "false"))
        return WarcReader(self.options["path"], schema, json.loads(self.options.get("where", "{}")), verify)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema, overwrite)


def _uri(path: str) -> str:
    """A path as a URI that names its file system."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def register(spark) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(WarcDataSource)


def read_warc(
    spark, path: str, *, payload: bool = True, where: Mapping[str, Sequence[str]] | None = None, verify: bool = False
) -> DataFrame:
    """The records under ``path``; without ``payload`` no block's body is read.

    ``where`` lists the wanted values of header columns: ``{"record_type": ["revisit"]}``. A record
    without such a header is not wanted. With ``verify``, a payload that is read and whose SHA-1 is not
    that in its header is an error; payloads without such a header are not compared.
    """
    register(spark)
    fields = [f for f in SCHEMA if payload or f.name != "payload"]
    reader = spark.read.format("warc").schema(T.StructType(fields)).option("verify", json.dumps(verify))
    return reader.option("where", json.dumps({c: list(v) for c, v in (where or {}).items()})).load(_uri(path))


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    least: int = 0, mode: str = "append",
) -> None:
    """Writes a record per row of ``pages`` to new archives under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest id is a response
    and the others are revisits of it; the payload of a revisit is not stored. Payloads are grouped
    by their SHA-256 and counted before the shuffle; a very frequent one is spread over salted
    parts on its way back to its rows. The record's id is ``<urn:page:ID>``, from the row's id.

    A NULL payload is empty. Rows without an id are never what others refer to, unless no row of
    the group has one: then all of them are responses. Rows that repeat the smallest id with its
    payload are responses all. Other columns are ignored; an empty table writes no file.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("target_uri"),
        F.encode(whole(payload_col), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    groups = stage(spark, rows.groupBy("sha").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    ), "payload-groups")
    urn = F.lit("<urn:page:")
    joined = join_groups(rows, groups, ["sha"], size="n", spread=["id"])
    revisit = (F.octet_length("payload") >= least) & ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    joined.select(
        F.concat(urn, F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"), "target_uri",
        "payload", F.when(revisit, F.concat(urn, "first", F.lit(">"))).alias("refers_to"),
    ).write.format("warc").mode(mode).save(_uri(path))


def new_folder(spark, name: str) -> str:
    """A new folder in the shared one."""
    return _uri(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def page_of(urn: str):
    """The page's id in a record's id."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


