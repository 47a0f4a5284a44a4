"""WARC as a Spark data source in Python, and a deduplicating archive of pages.

Reading (``spark.read.format("docsieve_warc").load(folder)``): files are the
manifest of a committed write, or else all ``*.warc`` and ``*.warc.gz`` below the
folder, and are planned into partitions by size. Equality, set and prefix
predicates on record headers are pushed down; the reader parses a record's
headers first and does not inflate, read or hash the payloads of records that
the predicates refuse: an uncompressed block is skipped by Content-Length, a
gzip member of one record by the ``sl`` (skip lengths) extra field of the WARC
standard's annex, and without that field it is inflated to its end and thrown
away. A member may hold several records; all are read, with the member's offset.
The option
``payload`` is ``bytes`` (default), ``digest`` (length and SHA-256 only) or
``none``. A malformed record ends its file with an error naming file and offset.

Writing: each task writes its own files, one gzip member a record; a commit
publishes the manifest of the successful tasks' files, so a lost or repeated
task leaves nothing that a reader sees. Files live in a folder that pyarrow's
file systems reach (local, shared, HDFS, S3).

Null ids, addresses and payloads: headers are left out, a payload is empty.
Repeated rows are records of their own; an empty table makes an archive without
pages; other columns of the table, whatever their names, are not read. One
record is held whole, so memory follows the longest payload.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .shared import new_path, stored

NAME = "docsieve_warc"
SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, declared_digest string, content_type string, payload_bytes long, payload_digest string, payload binary, file string, offset long"
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "declared_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
WRITTEN = "warc_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
MANIFEST = "_manifest.json"
PARTITION_BYTES = 64 << 20
FILE_BYTES = 1 << 30
BATCH_RECORDS, BATCH_BYTES = 1000, 16 << 20
HEADER_LIMIT = 1 << 20
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(record: bytes) -> bytes:
    """A gzip member that says its compressed and its plain length in its header, unless they need over 32 bits."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(record)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + tail


def skip_lengths(head: bytes) -> tuple[int, int] | None:
    """The member's compressed and plain length, if its header says so."""
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
    while len(extra) >= 4:
        n = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"sl" and n == 8 and len(extra) >= 12:
            lengths = int.from_bytes(extra[4:8], "little"), int.from_bytes(extra[8:12], "little")
            return lengths if lengths[0] else None
        extra = extra[4 + n :]
    return None


def record(warc_type: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", warc_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_block(size: int, payload: bytes) -> bytes:
    """A stored response; a revisit keeps the headers, so also the payload's length, and no payload."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload


def parse_headers(raw: bytes) -> dict[str, str]:
    """Named fields after the first line, names in small letters; a line that begins with white space continues the last."""
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Plain:
    """Records of an uncompressed file."""

    def __init__(self, file: io.RawIOBase):
        self.file = file

    def records(self) -> Iterator[tuple[int, dict[str, str], object]]:
        while True:
            offset = self.file.tell()
            first = self.file.readline()
            while first in (b"\r\n", b"\n"):
                offset = self.file.tell()
                first = self.file.readline()
            if not first:
                return
            raw = [first]
            while (line := self.file.readline()) not in (b"\r\n", b"\n", b""):
                raw.append(line)
                if sum(map(len, raw)) > HEADER_LIMIT:
                    raise ValueError(f"no end of headers at {offset}")
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no record at {offset}")
            headers = parse_headers(b"".join(raw))
            begin, n = self.file.tell(), int(headers["content-length"])
            yield offset, headers, lambda n=n: self.file.read(n)
            self.file.seek(begin + n)


class _Member:
    """The records of one gzip member, inflated as far as they are asked for."""

    STEP = 1 << 16

    def __init__(self, file: io.RawIOBase, offset: int, head: bytes):
        self.file, self.offset, self.raw, self.fed = file, offset, head, len(head)
        self.inflate = zlib.decompressobj(31)
        self.buffer = bytearray()
        self.done = 0  # plain bytes behind the buffer's beginning
        self.lengths = skip_lengths(head)
        self.skipped = False

    def more(self) -> bool:
        """Inflates another portion into the buffer; whether there was one."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.file.read(self.STEP)
                self.fed += len(self.raw)
                if not self.raw:
                    raise ValueError(f"cut off at {self.offset}")
            out = self.inflate.decompress(self.raw, 1 << 20)
            self.raw = self.inflate.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next ``n`` plain bytes, or what is left of the member."""
        parts = []
        while n:
            if not self.buffer and not self.more():
                break
            part = bytes(self.buffer[:n]) if keep else b""
            went = min(n, len(self.buffer))
            del self.buffer[:went]
            parts.append(part)
            n -= went
            self.done += went
        return b"".join(parts)

    def records(self) -> Iterator[tuple[int, dict[str, str], object]]:
        while True:
            while self.buffer[:1] in (b"\r", b"\n") or not self.buffer:
                if self.buffer:
                    self.take(1, keep=False)
                elif not self.more():
                    return
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if len(self.buffer) > HEADER_LIMIT:
                    raise ValueError(f"no end of headers at {self.offset}")
                if not self.more():
                    raise ValueError(f"no record at {self.offset}")
            if not self.buffer.startswith(b"WARC/"):
                raise ValueError(f"no record at {self.offset}")
            headers = parse_headers(self.take(end + 4)[:-4])
            n = int(headers["content-length"])
            upto = self.done + n
            yield self.offset, headers, lambda n=n: self.take(n)
            # nothing behind this record, as the header's lengths tell: the rest is not even inflated
            if self.lengths and self.lengths[1] == (upto + 4) & 0xFFFFFFFF and self.done < upto:
                self.skipped = True
                return
            self.take(upto - self.done, keep=False)
            if self.done < upto:
                raise ValueError(f"a record is cut off at {self.offset}")

    def size(self) -> int:
        """The member's compressed length, once its records have been read."""
        return self.lengths[0] if self.skipped else self.fed - len(self.inflate.unused_data)


class _Gzip:
    """Records of a file of gzip members: one each as the standard asks, or several."""

    def __init__(self, file: io.RawIOBase):
        self.file = file

    def records(self) -> Iterator[tuple[int, dict[str, str], object]]:
        offset = 0
        while True:
            self.file.seek(offset)
            head = self.file.read(_Member.STEP)
            if not head:
                return
            if head[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at {offset}")
            member = _Member(self.file, offset, head)
            yield from member.records()
            offset += member.size()


@dataclass
class _Files(InputPartition):
    files: tuple[str, ...]


def _wanted(filters: list[Filter]):
    """Whether a record's headers pass the pushed predicates."""
    tests = []
    for f in filters:
        name = HEADERS[f.attribute[0]].lower()
        if isinstance(f, EqualTo):
            tests.append((name, lambda v, x=f.value: v == x))
        elif isinstance(f, In):
            tests.append((name, lambda v, x=frozenset(f.value): v in x))
        elif isinstance(f, StringStartsWith):
            tests.append((name, lambda v, x=f.value: v is not None and v.startswith(x)))
        else:
            tests.append((name, lambda v: v is not None))
    return lambda headers: all(test(_value(headers, name)) for name, test in tests)


def _value(headers: dict[str, str], name: str) -> str | None:
    v = headers.get(name)
    return v[1:-1] if v is not None and name in ("warc-record-id", "warc-refers-to") and v[:1] == "<" and v[-1:] == ">" else v


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.payload = options.get("payload", "bytes")
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError(f"payload is bytes, digest or none, not {self.payload}")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = {i.path: i.size for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file}
        if (manifest := posixpath.join(root, MANIFEST)) in found:
            with store.open_input_stream(manifest) as f:
                names = [posixpath.join(root, x) for x in json.loads(f.read())]
        else:
            names = [x for x in found if x.endswith((".warc", ".warc.gz"))]
        plan, held = [[]], 0
        for name in sorted(names):
            if plan[-1] and held + found[name] > PARTITION_BYTES:
                plan.append([])
                held = 0
            plan[-1].append(name)
            held += found[name]
        return [_Files(tuple(p)) for p in plan if p] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        wanted, rows, held = _wanted(self.filters), [], 0
        for name in partition.files:
            with store.open_input_file(name) as raw:
                file = io.BufferedReader(raw, 1 << 18) if not name.endswith(".gz") else raw
                try:
                    for offset, headers, block in (_Gzip if name.endswith(".gz") else _Plain)(file).records():
                        if not wanted(headers):
                            continue
                        row = {column: _value(headers, header.lower()) for column, header in HEADERS.items()}
                        rows.append(row | self._payload(headers, block) | {"file": posixpath.basename(name), "offset": offset})
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{name}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _payload(self, headers: dict[str, str], block) -> dict:
        """Length, digest and bytes; of a revisit what its own headers say of the full payload."""
        none = {"payload_bytes": None, "payload_digest": None, "payload": None}
        if self.payload == "none":
            return none
        data = block()
        size = None
        if headers.get("content-type", "").startswith("application/http"):
            top, _, data = data.partition(b"\r\n\r\n")
            size = parse_headers(top).get("content-length")
        if headers.get("warc-type") == "revisit":
            return none | {"payload_bytes": int(size) if size is not None else None, "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2] or None}
        return {"payload_bytes": len(data), "payload_digest": hashlib.sha256(data).hexdigest(), "payload": data if self.payload == "bytes" else None}


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of WRITTEN; rows of type revisit get no payload."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() > FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(posixpath.join(root, names[-1]), compression=None)
                    out.write(member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("Content-Type", "application/warc-fields")], b"software: docsieve\r\nformat: WARC File Format 1.1\r\n")))
                out.write(member(_record(row)))
        if out is not None:
            out.close()
        return _Written(tuple(names))

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(posixpath.join(root, MANIFEST), compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        for name in (x for m in messages if m for x in m.files):
            store.delete_file(posixpath.join(root, name))


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    headers = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")]
    if row["target_uri"] is not None:
        headers.append(("WARC-Target-URI", " ".join(row["target_uri"].split())))
    if row["warc_type"] == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
        payload = b""
    return record(row["warc_type"], row["record_id"], headers, http_block(row["payload_bytes"], payload))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and turns on its predicate pushdown for Python sources, which this reader needs to skip payloads."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


LEAST_REVISIT = 100
#: Most digests of repeated payloads that are broadcast (about 100 bytes each); more meet the pages in a join.
BROADCAST_DIGESTS = 200_000
URN = "urn:docsieve:page:"


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record a page: of equal payloads of LEAST_REVISIT bytes or more the least id's is a response, others revisit it.

    Rows that repeat the least id are responses too; rows without an id revisit
    like others, and are responses where no row of their payload has an id.
    """
    register(pages.sparkSession)
    body = F.encode(F.coalesce(pages[html].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    repeated = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    # ids and digests alone are shuffled; the payloads stay where they are as long as the digests fit a broadcast
    first = stored(repeated.select("digest", "first"), "digests")
    placed = rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first.hint("merge"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    written = placed.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null:"), F.uuid()))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(again, F.concat(F.lit(URN), F.col("first").cast("string"))).alias("refers_to"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    written.write.format(NAME).mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from an archive of pages."""
    register(spark)
    read = spark.read.format(NAME).option("payload", "digest").load(path).where(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(URN) + 1}) AS long)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archive back."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path)
    return page_records(pages.sparkSession, path)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS h FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= {LEAST_REVISIT} AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM g
"""
