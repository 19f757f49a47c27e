"""WARC archives as a PySpark Python data source, ``warc``: writing, and reading with pushdown.

Writing: each task writes ``.warc.gz`` files with one gzip member per record. A member's header holds
an extra field with the member's length, so a reader that has seen a record's headers can step over
the rest of it. The files of the tasks that were committed are listed in ``_manifest-*``; those of lost
or repeated tasks are not, and readers ignore them. Each write adds a list of its own, so a folder can
be appended to.

Reading: the files are planned into partitions by size. Equality, IN and prefix filters on the record's
columns and on single named headers are pushed down: headers are parsed first, and the payload of a
record that fails them is neither decompressed nor decoded. With option ``payload`` = ``false`` no
payload is. Archives of other writers (also uncompressed ones) are read too.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS), on the driver and the executors.

Cases: null urls, ids and payloads are written as empty; see ``archive`` for ids. Empty tables give an
archive without records, which reads as an empty table. Payloads are bytes and pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from glyphlake.llm.shared import written
from glyphlake.sources.files import new_path, store as _files

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"
#: Columns that come from one header each.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: A file is closed beyond this many bytes; a read partition holds files of about as many.
FILE_BYTES = 128 << 20
_FIXED_DATE = "2000-01-01T00:00:00Z"
#: Names of fields that are known in any case, by the lower-case name.
_KNOWN = {n.lower(): n for n in (*HEADERS.values(), "WARC-Date", "WARC-Profile", "Content-Length", "Content-Type")}


def member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as a gzip member; the extra field ``WL`` holds the member's length and that of the headers' part.

    The headers are flushed before the body, so that they can be decompressed alone.
    """
    head = "".join(("WARC/1.1\r\n", *(f"{k}: {_line(v)}\r\n" for k, v in headers), f"Content-Length: {len(body)}\r\n\r\n")).encode()
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    first = squeeze.compress(head) + squeeze.flush(zlib.Z_SYNC_FLUSH)
    rest = squeeze.compress(body + b"\r\n\r\n") + squeeze.flush()
    check = zlib.crc32(body + b"\r\n\r\n", zlib.crc32(head))
    start = struct.pack("<4BIBBH2sHQQ", 0x1F, 0x8B, 8, 4, 0, 0, 255, 20, b"WL", 16, 32 + len(first) + len(rest) + 8, len(first))
    return start + first + rest + struct.pack("<II", check, (len(head) + len(body) + 4) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A header's value: line ends can't stand in one."""
    return " ".join(value.split("\r")).replace("\n", " ")


def parse(head: bytes) -> dict[str, str]:
    """The named fields of a record's header block; the case of known names doesn't matter."""
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[_KNOWN.get(name.strip().lower(), name.strip())] = value.strip()
    return found


@dataclass
class Wanted:
    """What is pushed down: per header, a set of values or a prefix."""

    values: dict[str, set[str]]
    prefixes: dict[str, str]

    def take(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in v for k, v in self.values.items()) and all(headers.get(k, "").startswith(v) for k, v in self.prefixes.items())


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a record's block: an HTTP message's body, without its chunks' marks, else the block itself."""
    if not headers.get("Content-Type", "").lower().startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    coded = (line.lower().partition(b":") for line in head.split(b"\r\n")[1:])
    return _unchunked(body) if any(k.strip() == b"transfer-encoding" and b"chunked" in v for k, _, v in coded) else body


def _unchunked(body: bytes) -> bytes:
    """The parts of a chunked body, joined; one that isn't chunked as it says stays as it is."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return body


def records(stream, wanted: Wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of each wanted record of a file; what isn't wanted is stepped over."""
    while lead := stream.read(2):
        if lead == b"\x1f\x8b":
            yield from _member(stream, wanted, payload)
        else:
            yield from _plain(_Rest(lead, stream), wanted, payload)


class _Rest:
    """A stream whose first bytes were read already."""

    def __init__(self, lead: bytes, stream):
        self.lead, self.stream = lead, stream

    def read(self, n: int) -> bytes:
        lead, self.lead = self.lead[:n], self.lead[n:]
        return lead + self.stream.read(n - len(lead)) if len(lead) < n else lead


class _Inflated:
    """What a member holds, decompressed as it is read."""

    def __init__(self, stream, inflate):
        self.stream, self.inflate, self.held = stream, inflate, bytearray()

    def read(self, n: int) -> bytes:
        while len(self.held) < n and not self.inflate.eof and (part := self.stream.read(1 << 16)):
            self.held += self.inflate.decompress(part)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _plain(stream, wanted: Wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """One uncompressed record."""
    head = bytearray()
    while not head.endswith(b"\r\n\r\n"):
        if not (c := stream.read(1)):
            return
        head += c
        if head == b"\r\n":  # blank lines between records
            head.clear()
    headers = parse(bytes(head))
    left = int(headers.get("Content-Length", 0))
    take = wanted.take(headers)
    block = bytearray()
    while left and (part := stream.read(min(left, 1 << 20))):
        left -= len(part)
        if take and payload:
            block += part
    if take:
        yield headers, payload_of(headers, bytes(block)) if payload else None


def _member(stream, wanted: Wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records of one gzip member: decompressed only if wanted or if it doesn't say its length."""
    _, flags, _, _, _ = struct.unpack("<BBIBB", stream.read(8))
    extra = stream.read(struct.unpack("<H", stream.read(2))[0]) if flags & 4 else b""
    for bit in (8, 16):  # name, comment
        while flags & bit and stream.read(1) not in (b"\0", b""):
            pass
    if flags & 2:
        stream.read(2)
    inflate = zlib.decompressobj(-15)
    if len(extra) == 20 and extra[:2] == b"WL" and not flags & 26:
        total, first = struct.unpack("<QQ", extra[4:])
        head = inflate.decompress(stream.read(first))
        headers, rest = parse(head), total - 32 - first
        if not wanted.take(headers) or not payload:
            stream.seek(rest, 1)
            if wanted.take(headers):
                yield headers, None
            return
        tail = stream.read(rest)
        block = inflate.decompress(tail[:-8])
        if zlib.crc32(block, zlib.crc32(head)) != struct.unpack("<I", tail[-8:-4])[0]:
            raise ValueError("a record's checksum is wrong")
        yield headers, payload_of(headers, block[: int(headers["Content-Length"])])
        return
    inner = _Inflated(stream, inflate)
    while lead := inner.read(1):  # other writers may put many records into one member
        yield from _plain(_Rest(lead, inner), wanted, payload)
    stream.seek(8 - len(inflate.unused_data), 1)


class FilePart(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.size = int(options.get("partitionbytes", FILE_BYTES))
        self.wanted = Wanted({}, {})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what can be told from a record's headers; gives back the rest."""
        for f in filters:
            at = getattr(f, "attribute", ())
            name = HEADERS.get(at[0]) if len(at) == 1 else at[1] if len(at) == 2 and at[0] == "headers" else None
            if name and isinstance(f, EqualTo) and isinstance(f.value, str):
                self._narrow(name, {f.value})
            elif name and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self._narrow(name, set(f.value))
            elif name and isinstance(f, StringStartsWith) and name not in self.wanted.prefixes:
                self.wanted.prefixes[name] = f.value
            else:
                yield f

    def _narrow(self, name: str, values: set[str]) -> None:
        self.wanted.values[name] = self.wanted.values.get(name, values) & values

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _files(self.path)
        infos = store.get_file_info(fs.FileSelector(root))
        lists = [i.path for i in infos if i.is_file and i.base_name.startswith("_manifest-")]
        names = set() if lists else None
        for path in lists:
            with store.open_input_stream(path) as f:
                names.update(json.loads(f.read()))
        parts, held, size = [], [], 0
        for info in sorted(infos, key=lambda i: i.path):
            if not info.is_file or info.base_name.startswith(("_", ".")) or names is not None and info.base_name not in names:
                continue
            if held and size + info.size > self.size:
                parts.append(FilePart(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*parts, *([FilePart(held)] if held else [])]

    def read(self, partition: FilePart | None) -> Iterator[tuple]:
        store, _ = _files(self.path)
        for path in partition.paths if partition else ():
            with store.open_input_file(path) as stream:
                for headers, payload in records(stream, self.wanted, self.payload):
                    yield (*(headers.get(h) for h in HEADERS.values()), int(headers.get("Content-Length", 0)), headers, payload)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    """Takes rows (record_type, record_id, target_uri, refers_to, extra map, payload)."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        store, root = _files(self.path)
        store.create_dir(root)
        names, stream, size = [], None, 0
        for row in rows:
            if stream is None or size > FILE_BYTES:
                if stream:
                    stream.close()
                names.append(f"{uuid.uuid4().hex}.warc.gz")
                stream, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                stream.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _FIXED_DATE), ("Content-Type", "application/warc-fields")], b"software: glyphlake\r\n"))
            record = member(*record_of(row))
            stream.write(record)
            size += len(record)
        if stream:
            stream.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _files(self.path)
        store.create_dir(root)
        before = store.get_file_info(fs.FileSelector(root)) if self.overwrite else []
        names = [n for m in messages if m for n in m.names]
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps(names).encode())
        # What an overwriting write replaces goes last: until then the folder holds both.
        for info in sorted(before, key=lambda i: not i.base_name.startswith("_manifest-")):
            if info.is_file and info.base_name not in names:
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _files(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{name}")


def record_of(row) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a row."""
    payload = bytes(row["payload"] or b"")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", _FIXED_DATE), ("WARC-Target-URI", row["target_uri"] or ""), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if row["record_type"] == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", row["refers_to"])]
    headers += sorted((row["extra"] or {}).items())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return headers, head if row["record_type"] == "revisit" else head + payload


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a record per row of (page_id, url, html); equal payloads of ``min_bytes`` or more once.

    Of those the smallest page_id's record is the response (a null id comes last, rows that repeat that id
    are responses too) and the others revisit it. Record ids hold the page id, or ``null``.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = written(repeated, "warc-repeated")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("repeats") & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(repeated.withColumn("repeats", F.lit(True)), "digest", "left").withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    joined.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("revisit"), urn(F.col("first"))).alias("refers_to"),
        F.create_map(F.lit("X-Payload-Length"), F.octet_length("payload").cast("string")).alias("extra"),
        "payload",
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(urn) -> F.Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archive into the shared folder and gives what its records say."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path)
    found = read(pages.sparkSession, path).where(F.col("record_type").isin("response", "revisit"))
    own = F.octet_length("payload").cast("long")
    return found.select(
        page_id(F.col("record_id")).alias("page_id"),
        F.when(F.col("record_type") == "response", own).otherwise(F.col("headers")["X-Payload-Length"].cast("long")).alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        page_id(F.col("refers_to")).alias("refers_to"),
    )
