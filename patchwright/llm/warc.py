"""WARC: a Python data source that reads and writes gzip-per-record archives.

Reading plans whole files into partitions of about `partitionBytes`, takes record-type and header
predicates from the plan (`pushFilters`, where `spark.sql.python.filterPushdown.enabled` is set)
or from options, parses the headers of a record first, and neither reads nor inflates the payloads of records that fail or
whose schema has no payload column: each gzip member names its own length in its header, so only a head is
inflated before the next member is sought. (Members of other writers, without that length, are inflated whole and stepped over.) Writing gives each task attempt its own files of at most
`recordsPerFile` records and about `bytesPerFile` bytes. The driver's commit is one small file, renamed into place, that lists the
files that count; readers pass over written files that no such list has. So a write is there as a whole
or not at all, and a task that is repeated or lost leaves nothing that is read.

Columns: record_id, record_type, target_uri, date, content_type, refers_to, payload_digest,
payload_bytes, page_id (a header of its own) and payload. Folders are local or anything that
pyarrow.fs opens by URI (hdfs, s3, gs).

Defined cases: an empty folder or table gives no records; a null html is an empty payload; a null url
is an empty target; a record without a header has null there; a broken record raises.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.storage import store
from .common import materialise, new_path, table

FORMAT = "patchwright_warc"
PARTITION_BYTES, RECORDS_PER_FILE, BYTES_PER_FILE, MIN_BYTES = 32 << 20, 20_000, 64 << 20, 0
OWN_FILE = re.compile(r"part-[0-9]{5}-[0-9]{3}-[0-9a-f]{32}-[0-9]+\.warc\.gz")
COLUMNS = "record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, payload_digest string, payload_bytes bigint, page_id bigint, payload binary"
# The headers of WARC 1.1 behind the columns; the last two are our own.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Bytes",
    "page_id": "X-Page-ID",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Members:
    """The uncompressed bytes of a gzip (of one or many members) or plain file, read forward; memory is one block."""

    def __init__(self, raw, packed: bool) -> None:
        self.raw, self.packed, self.buffer, self.done = raw, packed, b"", False
        self.pending, self.engine = b"", zlib.decompressobj(31)

    def _more(self) -> None:
        if not self.packed:
            block = self.raw.read(1 << 18)
            self.done = not block
            self.buffer += block
            return
        if self.engine.eof:  # the next member
            self.pending, self.engine = self.engine.unused_data, zlib.decompressobj(31)
        block = self.pending or self.raw.read(1 << 18)
        self.pending = b""
        if not block:
            self.done = True
            return
        self.buffer += self.engine.decompress(block)

    def head(self) -> bytes | None:
        """The bytes up to an empty line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0 and not self.done:
            self._more()
        if at < 0:
            if self.buffer.strip():
                raise ValueError("broken WARC record: no end of its headers")
            return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return out

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes, or None if they are only stepped over."""
        got = [] if keep else None
        while n > 0:
            if not self.buffer:
                if self.done:
                    raise ValueError("broken WARC record: short payload")
                self._more()
                continue
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            if keep:
                got.append(part)
        return b"".join(got) if keep else None


#: The subfield of a gzip header that holds its member's whole length, and the bytes in front of the deflated data.
SUBFIELD, FRONT = b"PW", 24
READ, STEP = 1 << 16, 2048


def pack(data: bytes, level: int = 3) -> bytes:
    """A gzip member that names its own length, which any reader of gzip passes over."""
    engine = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = engine.compress(data) + engine.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    front = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + SUBFIELD + struct.pack("<HQ", 8, FRONT + len(body) + len(tail))
    return front + body + tail


class Seeking:
    """The records of a file of such members: a head is inflated in small steps, and what is not wanted is never read or inflated."""

    def __init__(self, raw, size: int) -> None:
        self.raw, self.size, self.start, self.held, self.inflated = raw, size, 0, b"", 0

    def view(self, at: int, n: int) -> bytes:
        """n bytes from a place, or what there is; of one read ahead if they are in it."""
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.raw.seek(at)
            self.start, self.held = at, self.raw.read(min(max(n, READ), self.size - at))
        return self.held[at - self.start : at - self.start + n]

    def length(self, at: int) -> int | None:
        """The length of the member that begins here, if it names it."""
        front = self.view(at, FRONT)
        known = len(front) == FRONT and front[:4] == b"\x1f\x8b\x08\x04" and front[10:16] == struct.pack("<H", 12) + SUBFIELD + struct.pack("<H", 8)
        return struct.unpack("<Q", front[16:])[0] if known else None

    def member(self, at: int, n: int, wanted) -> tuple[dict[str, str], bytes | None] | None:
        """(headers, payload) of the member; wanted(headers) tells whether the payload is inflated."""
        engine, place, end, data, rest = zlib.decompressobj(31), at, at + n, b"", b""
        while (stop := data.find(b"\r\n\r\n")) < 0:
            if not rest:
                if place >= end:
                    raise ValueError("broken WARC record: no end of its headers")
                rest = self.view(place, min(STEP, end - place))
                place += len(rest)
                if not rest:
                    raise ValueError("broken WARC record: short file")
            more = engine.decompress(rest, STEP)
            rest, data = engine.unconsumed_tail, data + more
            self.inflated += len(more)
        h = headers_of(data[:stop])
        if not wanted(h):
            return h, None
        parts = [data[stop + 4 :]]
        for block in (rest, self.view(place, end - place)):
            parts.append(engine.decompress(block))
            self.inflated += len(parts[-1])
        payload, size = b"".join(parts), int(h["content-length"])
        if len(payload) != size + 4:
            raise ValueError("broken WARC record: short payload")
        return h, payload[:size]


def records_of(raw, size: int, packed: bool, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload if wanted) of all records of a file. From the first member on that does not name its length, as in files of other writers, all bytes are inflated."""
    at = 0
    if packed:
        ahead = Seeking(raw, size)
        while at < size and (n := ahead.length(at)) is not None:
            yield ahead.member(at, n, wanted)
            at += n
        if at >= size:
            return
    raw.seek(at)
    members = Members(raw, packed)
    while (head := members.head()) is not None:
        h = headers_of(head)
        payload = members.take(int(h["content-length"]), keep=wanted(h))
        members.take(4, keep=False)
        yield h, payload


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"broken WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options = schema.names, options
        self.wanted: dict[str, set] = {}
        if "recordtypes" in options:
            self.wanted["record_type"] = set(options["recordtypes"].split(","))

    def pushFilters(self, filters):
        """Equality and membership of header columns are checked before a payload is touched; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        where, base = store(self.options["path"])
        found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
        whole = set()
        for f in found:
            if f.base_name.startswith("_committed-"):
                with where.open_input_stream(f.path, compression=None) as lists:
                    whole.update(json.loads(lists.read()))
        files = (f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and (f.base_name in whole or not OWN_FILE.fullmatch(f.base_name)))
        files = sorted(files, key=lambda f: f.path)
        limit, out, size = int(self.options.get("partitionbytes", PARTITION_BYTES)), [], 0
        for f in files:
            if not out or size + f.size > limit:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = store(self.options["path"])
        names = [HEADERS.get(n, "").lower() for n in self.names]
        whole = "payload" in self.names

        def fits(h: dict[str, str]) -> bool:
            return all(value_of(n, h.get(HEADERS[n].lower())) in v for n, v in self.wanted.items())

        for path in partition.paths:
            with where.open_input_file(path) as raw:
                for h, payload in records_of(raw, raw.size(), path.endswith(".gz"), lambda h: whole and fits(h)):
                    if payload is not None or fits(h):
                        yield tuple(payload if n == "payload" else value_of(n, h.get(x)) for n, x in zip(self.names, names, strict=True))


def value_of(name: str, text: str | None):
    if text is None:
        return None
    return int(text) if name in ("payload_bytes", "page_id") else text.removeprefix("sha1:") if name == "payload_digest" else text.strip("<>") if name in ("record_id", "refers_to") else text


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options, self.job = schema.names, options, uuid.uuid4().hex

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, base = store(self.options["path"])
        where.create_dir(base, recursive=True)
        most, most_bytes = int(self.options.get("recordsperfile", RECORDS_PER_FILE)), int(self.options.get("bytesperfile", BYTES_PER_FILE))
        done, out, n, size = [], None, 0, 0
        try:
            for row in rows:
                if out is None or n >= most or size >= most_bytes:
                    if out is not None:
                        out.close()
                    done.append(f"part-{task.partitionId():05d}-{len(done):03d}-{self.job}-{task.taskAttemptId()}.warc.gz")
                    out, n, size = where.open_output_stream(f"{base}/{done[-1]}", compression=None), 0, 0
                packed = pack(record(row.asDict()))
                out.write(packed)
                n, size = n + 1, size + len(packed)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages) -> None:
        where, base = store(self.options["path"])
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/_new-{self.job}", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        where.move(f"{base}/_new-{self.job}", f"{base}/_committed-{self.job}")

    def abort(self, messages) -> None:
        where, base = store(self.options["path"])
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f"{base}/{f}")


def record(row: dict) -> bytes:
    """One WARC record of a row of COLUMNS (any may be missing)."""
    payload = row.get("payload") or b""
    out = io.BytesIO()
    out.write(b"WARC/1.1\r\n")
    lines = [(HEADERS[n], row.get(n)) for n in HEADERS]
    if row.get("record_type") == "revisit":
        lines.append(("WARC-Profile", PROFILE))
    for name, value in [*lines, ("Content-Length", len(payload))]:
        if value is not None:
            text = str(value).replace("\r", " ").replace("\n", " ")
            text = f"<{text}>" if name in ("WARC-Record-ID", "WARC-Refers-To") else f"sha1:{text}" if name == "WARC-Payload-Digest" else text
            out.write(f"{name}: {text}\r\n".encode())
    out.write(b"\r\n" + bytes(payload) + b"\r\n\r\n")
    return out.getvalue()


def lowered(options) -> dict[str, str]:
    """Options by lower-case names, as Spark takes them in any case."""
    return {k.lower(): v for k, v in options.items()}


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, lowered(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, lowered(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from the hexadecimal one by groups of 20 bits."""
    sha = F.sha1(payload)
    # conv writes base 32 with 0-9A-V; RFC 4648 has A-Z2-7
    groups = [F.lpad(F.conv(F.substr(sha, F.lit(1 + 5 * k), F.lit(5)), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows to write. Of equal payloads of at least min_bytes that of the largest page_id is the response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    # counts per digest merge in each task first; only digests that repeat go on
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("d")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select("d", "first_id"), "responses")
    # few repeated digests are broadcast by their size; more take a shuffle of the rows, whose hot digests AQE splits
    out = rows.join(first, rows["payload_digest"] == first["d"], "left")
    again = F.coalesce(F.col("page_id") < F.col("first_id"), F.lit(False))
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    uri = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return out.select(
        uri(F.col("page_id")).alias("record_id"),
        "record_type",
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(again, uri(F.col("first_id"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        "page_id",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The records of a folder; columns: those to decode (all if none are given)."""
    register(spark)
    full = [c.strip().split() for c in COLUMNS.split(",")]
    schema = ", ".join(f"{n} {t}" for n, t in full if columns is None or n in columns)
    return spark.read.format(FORMAT).schema(schema).options(**options).load(path)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(records(table(spark, sf_dir, "pages")), path)
    # responses with their payloads, revisits by their headers alone: both filters reach the reader
    found = read(spark, path, ["record_type", "page_id", "payload"]).where("record_type = 'response'")
    again = read(spark, path, ["record_type", "payload_digest", "payload_bytes", "page_id", "refers_to"]).where("record_type = 'revisit'")
    none = F.lit(None).cast("bigint").alias("refers_to")
    responses = found.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), digest(F.col("payload")).alias("payload_digest"), "record_type", none)
    return responses.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", F.substring_index("refers_to", ":", -1).cast("bigint").alias("refers_to")))
