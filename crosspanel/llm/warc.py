"""WARC archives as a PySpark data source, for reading and writing.

Reading plans partitions of whole files by size.  Predicates on record type and header
columns are pushed into the reader: of every record the headers are parsed first, and a
payload is decoded only if the record passes and the query asks for the payload or its
verification.  Other records are skipped by their length.  Gzip archives hold one member a
record; the members written here name their own length in the gzip header's extra field
(``SL``), so that a skipped record isn't even decompressed.  Foreign gzip files without the
field are read through.

Writing gives files of bounded size under temporary names that the commit renames, so
attempts that fail or repeat leave nothing behind that a reader would see.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from crosspanel.llm.frames import staged
from crosspanel.session import ensure_checkpoint_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
IDS = ("record_id", "refers_to")
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
CHUNK = 1 << 16


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record_bytes(row: dict[str, object], date: str) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP headers only."""
    payload = bytes(row["payload"] or b"")
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": date,
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "WARC-Refers-To": f"<{row['refers_to']}>" if row["refers_to"] is not None else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {_one_line(str(v))}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def _one_line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\n" in text or "\r" in text else text


def gzip_member(raw: bytes, level: int) -> bytes:
    """One gzip member whose extra field holds its own length and the length of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 12 + 20 + len(body) + 8
    extra = b"SL" + struct.pack("<HQQ", 16, size, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path = options["path"]
        self.level = int(options.get("level", "3"))
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.date = options.get("date") or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = open_store(self.path)
        store.create_dir(f"{base}/_writing-{self.run}", recursive=True)
        names: list[str] = []
        out, used = None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None or used >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                        out, used = store.open_output_stream(f"{base}/_writing-{self.run}/{names[-1]}", compression=None), 0
                    raw = record_bytes(row, self.date)
                    raw = gzip_member(raw, self.level) if self.gzip else raw
                    out.write(raw)
                    used += len(raw)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = open_store(self.path)
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for f in _archives(store, base):
                store.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{base}/_writing-{self.run}/{name}", f"{base}/{name}")
        self._clean(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*open_store(self.path))

    def _clean(self, store: fs.FileSystem, base: str) -> None:
        folder = f"{base}/_writing-{self.run}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


# Reading


def _archives(store: fs.FileSystem, base: str) -> list[fs.FileInfo]:
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(base) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not hidden(f.path)), key=lambda f: f.path)


@dataclass
class Archives(InputPartition):
    files: list[str]


class Record:
    """Headers of a record, and its block on demand."""

    def __init__(self, headers: dict[str, str], block) -> None:
        self.headers = headers
        self.block = block  # called at most once: the first n bytes of the block, or all

    def column(self, name: str) -> str | None:
        value = self.headers.get(HEADER_OF[name])
        if value is None:
            return None
        if name in IDS:
            return value[1:-1] if value[:1] == "<" else value
        return value.removeprefix("sha1:") if name == "payload_digest" else value


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def plain_records(f) -> Iterator[Record]:
    """Records of an uncompressed archive; what isn't asked for is skipped by seeking."""
    while True:
        head = b""
        while line := f.readline():
            head += line
            if line in (b"\r\n", b"\n") and head.strip():
                break
        if not head.strip():
            return
        headers = _parse(head.lstrip())
        begin, size = f.tell(), int(headers.get("content-length", "0"))

        def block(n: int | None = None, size: int = size) -> bytes:
            return f.read(size if n is None else min(n, size))

        yield Record(headers, block)
        f.seek(begin + size + 4)


def gzip_records(f) -> Iterator[Record]:
    """Records of an archive with one gzip member a record."""
    start = 0
    while True:
        f.seek(start)
        fixed = f.read(12)
        if not fixed:
            return
        if fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        size = None
        if fixed[3] & 4:
            extra = f.read(struct.unpack("<H", fixed[10:12])[0])
            if extra[:2] == b"SL" and len(extra) >= 20:
                size = struct.unpack("<Q", extra[4:12])[0]
            f.seek(start)
        else:
            f.seek(start)
        unpack = zlib.decompressobj(31)
        got = bytearray()

        def fill(n: int | None) -> None:
            """Decompress until ``n`` bytes are there, or all."""
            while not unpack.eof and (n is None or len(got) < n):
                raw = unpack.unconsumed_tail or f.read(CHUNK if n is None else 2048)
                if not raw:
                    raise EOFError("archive ends inside a record")
                got.extend(unpack.decompress(raw, 0 if n is None else max(n - len(got), 1)))

        end = -1
        while end < 0:
            fill(len(got) + 2048)
            end = got.find(b"\r\n\r\n")
            if end < 0 and unpack.eof:
                raise ValueError("record without end of headers")
        headers = _parse(bytes(got[:end]))
        length = int(headers.get("content-length", "0"))

        def block(n: int | None = None, at: int = end + 4, length: int = length) -> bytes:
            fill(at + (length if n is None else min(n, length)))
            return bytes(got[at : at + (length if n is None else min(n, length))])

        yield Record(headers, block)
        if size is None:
            fill(None)
            start = f.tell() - len(unpack.unused_data)
        else:
            start += size


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.schema = options["path"], schema
        self.verify = options.get("verify", "false") == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.equal: list[tuple[str, tuple]] = []
        self.prefix: list[tuple[str, str]] = []
        self.present: list[str] = []
        unknown = set(schema.names) - set(HEADER_OF) - {"payload_bytes", "payload"}
        if unknown:
            raise ValueError(f"a WARC archive has no column {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership, prefix and presence of header columns; leave the rest to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADER_OF:
                yield f
            elif isinstance(f, EqualTo):
                self.equal.append((name, (f.value,)))
            elif isinstance(f, In):
                self.equal.append((name, tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.prefix.append((name, f.value))
            elif isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> list[Archives]:
        store, base = open_store(self.path)
        planned, files, used = [], [], 0
        for f in _archives(store, base):
            if files and used + f.size > self.partition_bytes:
                planned.append(Archives(files))
                files, used = [], 0
            files.append(f.path)
            used += f.size
        if files:
            planned.append(Archives(files))
        return planned or [Archives([])]

    def _passes(self, r: Record) -> bool:
        return (
            all(r.column(k) in values for k, values in self.equal)
            and all((r.column(k) or "").startswith(v) and r.column(k) is not None for k, v in self.prefix)
            and all(r.column(k) is not None for k in self.present)
        )

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        target = to_arrow_schema(self.schema)
        rows, used = [], 0
        for path in partition.files:
            with io.BufferedReader(store.open_input_file(path), CHUNK) as f:
                for record in gzip_records(f) if path.endswith(".gz") else plain_records(f):
                    if not self._passes(record):
                        continue
                    rows.append(self._row(record))
                    used += len(rows[-1].get("payload") or b"") + 256
                    if used >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, target)
                        rows, used = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, target)

    def _row(self, record: Record) -> dict[str, object]:
        wanted = set(self.schema.names)
        row: dict[str, object] = {k: record.column(k) for k in wanted & set(HEADER_OF)}
        response = record.headers.get("warc-type") == "response"
        payload = None
        if "payload" in wanted or self.verify and response:
            block = record.block()
            _, mark, payload = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
            head = block[: len(block) - len(payload)]
        elif "payload_bytes" in wanted:
            head = record.block(CHUNK)
            end = head.find(b"\r\n\r\n") if head[:5] == b"HTTP/" else -4
            head = head[: end + 4]
        if self.verify and response and record.column("payload_digest") not in (None, digest_of(payload)):
            raise ValueError(f"payload of {record.column('record_id')} doesn't match its digest")
        if "payload_bytes" in wanted:
            named = [x.partition(b":")[2] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
            row["payload_bytes"] = int(named[0]) if named else int(record.headers.get("content-length", "0")) - len(head)
        if "payload" in wanted:
            row["payload"] = payload if response else None
        return row


class WarcSource(DataSource):
    """``format("warc")``; options path, compression, level, filebytes, date, verify, partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        missing = {"record_id", "record_type", "target_uri", "refers_to", "payload"} - set(schema.names)
        if missing:
            raise ValueError(f"records need the columns {sorted(missing)}")
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """Records of the archives under ``path``; ask for few columns, payloads cost decoding."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Write (record_id, record_type, target_uri, refers_to, payload) rows as archives."""
    records.sparkSession.dataSource.register(WarcSource)
    columns = records.select("record_id", "record_type", "target_uri", "refers_to", "payload")
    columns.write.format("warc").options(**options).mode("append").save(path)


PAGE = "urn:page:"


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of crawled pages; equal payloads of at least ``least_bytes`` become revisits.

    The row with the smallest page_id of a payload is the response; rows that repeat that id
    are responses as well.  A null html is an empty payload.  Rows without an id refer to the
    smallest id like any other; if no row of a payload has one, all are responses.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    hashed = lambda df: df.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Only digests meet; payloads travel only if the table of repeats is too large to send around.
    groups = hashed(rows).where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = staged(groups.where("n > 1 AND first IS NOT NULL").select("sha", "size", "first"), "warc-repeats")
    joined = hashed(rows).join(groups, ["sha", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.concat(F.lit(PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, F.concat(F.lit(PAGE), F.col("first").cast("string"))).alias("refers_to"),
        "payload",
    )


def archive_pages(spark: SparkSession, pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives (below the checkpoint folder unless named) and read them back.

    Two scans with a pushed record type: responses are decoded and held against their digests,
    revisits are read from their headers alone.
    """
    path = path or f"{ensure_checkpoint_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_warc(page_records(pages, least_bytes), path)
    columns = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"
    responses = read_warc(spark, path, columns, verify=True).where(F.col("record_type") == "response")
    back = responses.unionByName(read_warc(spark, path, columns).where(F.col("record_type") == "revisit"))
    number = lambda c: F.regexp_extract(c, f"^{PAGE}(-?[0-9]+)$", 1)
    return back.select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(number("refers_to") != "", number("refers_to")).cast("long").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (instr('0123456789abcdef', substr(h, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, (5 * i // 4 + 2)::INT, 1)) - 1
  ) >> (3 - 5 * i % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p JOIN f USING (h)
"""
