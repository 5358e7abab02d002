"""WARC archives as a Spark data source: one gzip member a record, written by tasks and read back in sequence (op11).

``WarcSource`` is a Python data source.  Its writer appends records to archives of a bounded size in each
task; the driver then publishes the names of the finished ones in a manifest, so that readers see all archives of a
job or none, and what a lost task left is never read.  Its reader takes an archive a task: pieces of bounded
size are decompressed one after the other, the headers give the length of the block, and the digests of block and payload
are computed as the bytes go by.  Without ``payload`` a record of any size needs a few pieces of memory.

Payloads that were stored before are revisits: a record that names the response with the same payload and
holds its length and digest, but not its bytes.

Edge cases: a null or empty html is an empty payload; a null url leaves out the target; line breaks in it are
percent-encoded; repeated rows of one page_id are records of their own, and all of
those with the largest page_id of a payload are responses; a null page_id comes back as null and is the smallest; an empty table gives
an empty result.  A damaged member gives one row with a problem, and reading goes on at the next member that
holds a record; a record whose digest, length or framing is wrong comes with its problem.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lexaudit.llm._util import small_batches, table, written
from lexaudit.sources.shared import scratch

SCHEMA = "archive string, record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"
COLUMNS = pa.schema(
    [(c, pa.string()) for c in ("archive", "record_id", "record_type", "target_uri", "date", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())]
)
MANIFEST = "_archives.json"
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 256 * 1024 * 1024
#: Bytes read, and bytes decompressed, at once.
PIECE = 256 * 1024
#: A header of more bytes is taken as damage.
MOST_HEADER = 1024 * 1024
#: Payloads under this many bytes are stored again rather than referred to.
LEAST_REVISIT = 1000
#: Keepers of repeated payloads are broadcast up to this count (under 10 MB); beyond it the join is dealt by payload and salt.
MOST_BROADCAST, SALTS = 100_000, 64
#: Rows and bytes of records that a reading task hands on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 * 1024 * 1024
PAGE = "urn:lexaudit:page:"


# -- one record -------------------------------------------------------------------------------------


def digest_field(raw: bytes) -> str:
    """A SHA-1 as archives write it."""
    return f"sha1:{base64.b32encode(raw).decode()}"


def parsed_digest(value: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a digest field in base 16 or 32; None if it cannot be checked."""
    name, _, text = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return None
    size, text = hashlib.new(name).digest_size, text.strip()
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def record_head(fields: list[tuple[str, str | None]]) -> bytes:
    clean = lambda v: "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in v)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode("utf-8", "surrogatepass")


def member(row: dict, date: str) -> Iterator[bytes]:
    """The gzip member of one record, in pieces; a revisit holds the headers of the answer alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else payload
    sha = hashlib.sha1(http)
    sha.update(body)
    head = record_head(
        [
            ("WARC-Type", row["record_type"]),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None),
            ("WARC-Payload-Digest", digest_field(bytes.fromhex(row["payload_digest"]))),
            ("WARC-Block-Digest", digest_field(sha.digest())),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", str(len(http) + len(body))),
        ]
    )
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    yield z.compress(head + http)
    for at in range(0, len(body), PIECE):
        yield z.compress(body[at : at + PIECE])
    yield z.compress(b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    """A record as it was read; payload is kept only where it is asked for."""

    fields: dict[str, str] = field(default_factory=dict)
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None
    problem: str | None = None


class RecordParser:
    """Takes the bytes of records in pieces of any size and gives the records that have ended."""

    def __init__(self, keep_payload: bool) -> None:
        self.keep = keep_payload
        self._start()

    def _start(self) -> None:
        self.state, self.held, self.record = "head", bytearray(), Record()

    def _damage(self, what: str) -> None:
        self.record.problem = self.record.problem or what

    def feed(self, data: bytes) -> Iterator[Record]:
        while data:
            data = yield from getattr(self, f"_{self.state}")(data)

    def end(self) -> Iterator[Record]:
        """At the end of a member: what has begun is given with its problem."""
        if self.state == "lost":
            return
        if self.state != "head" or self.held.strip(b"\r\n"):
            if self.state in ("http", "body"):
                self._finish()
            self._damage("the record ends before its length")
            yield self.record
        self._start()

    def _until_blank(self, data: bytes, most: int) -> tuple[bytes, bytes] | None:
        """(header, rest) once the blank line is there."""
        seen = max(0, len(self.held) - 3)
        self.held += data[:most]
        at = self.held.find(b"\r\n\r\n", seen)
        if at < 0:
            return None
        rest = bytes(self.held[at + 4 :]) + data[most:]
        head = bytes(self.held[:at])
        self.held = bytearray()
        return head, rest

    def _head(self, data: bytes):
        if not self.held:
            data = data.lstrip(b"\r\n")
            if not data:
                return b""
        found = self._until_blank(data, len(data))
        if found is None:
            if len(self.held) > MOST_HEADER:
                self._damage("the header does not end")
                yield self.record
                self.state = "lost"
            return b""
        head, rest = found
        lines = head.decode("utf-8", "replace").split("\r\n")
        last = None
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and last:
                self.record.fields[last] += " " + line.strip()
                continue
            name, colon, value = line.partition(":")
            if colon:
                last = name.strip().lower()
                self.record.fields[last] = value.strip()
        length = self.record.fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not (length.isascii() and length.isdigit()):
            self._damage("no WARC header" if not lines[0].startswith("WARC/") else "no length")
            yield self.record
            self.state = "lost"
            return b""
        f = self.record.fields
        self.left = int(length)
        self.block, self.body = hashlib.sha1(), hashlib.sha1()
        self.checks = {"block": parsed_digest(f.get("warc-block-digest")), "payload": parsed_digest(f.get("warc-payload-digest"))}
        self.sums = {k: hashlib.new(v[0]) for k, v in self.checks.items() if v}
        self.size, self.parts, self.http_head = 0, [], b""
        self.is_http = f.get("content-type", "").lower().startswith("application/http")
        self.state = "http" if self.is_http else "body"
        if not self.left:
            return (yield from self._end_block(rest))
        return rest

    def _take(self, data: bytes) -> tuple[bytes, bytes]:
        """(bytes of the block, rest)"""
        own, rest = data[: self.left], data[self.left :]
        self.left -= len(own)
        if "block" in self.sums:
            self.sums["block"].update(own)
        return own, rest

    def _http(self, data: bytes):
        own, rest = self._take(data)
        found = self._until_blank(own, len(own))
        if found is not None:
            self.http_head, body = found
            self._payload(body)
            self.state = "body"
        elif len(self.held) > MOST_HEADER:
            self._damage("the header of the answer does not end")
            self.held, self.state = bytearray(), "body"
        if not self.left:
            if self.state == "http":
                self._damage("the header of the answer does not end")
            return (yield from self._end_block(rest))
        return rest

    def _body(self, data: bytes):
        own, rest = self._take(data)
        self._payload(own)
        if not self.left:
            return (yield from self._end_block(rest))
        return rest

    def _payload(self, data: bytes) -> None:
        self.size += len(data)
        self.body.update(data)
        if "payload" in self.sums:
            self.sums["payload"].update(data)
        if self.keep:
            self.parts.append(data)

    def _finish(self) -> None:
        r, revisit = self.record, self.record.fields.get("warc-type", "").lower() == "revisit"
        r.payload_bytes, r.payload_digest = self.size, self.body.hexdigest()
        if revisit:  # what was not stored is described by the headers
            length = next((v.strip() for k, _, v in (x.partition(":") for x in self.http_head.decode("latin-1").split("\r\n")) if k.strip().lower() == "content-length"), "")
            r.payload_bytes = int(length) if length.isascii() and length.isdigit() else None
            r.payload_digest = self.checks["payload"][1] if self.checks["payload"] else None
        elif self.keep:
            r.payload = b"".join(self.parts)
        for k in ("block",) if revisit else ("block", "payload"):
            if self.checks[k] and self.sums[k].hexdigest() != self.checks[k][1]:
                self._damage(f"the {k} digest differs")

    def _end_block(self, rest: bytes):
        self._finish()
        self.held = bytearray()
        self.state = "tail"
        return rest
        yield  # a generator like the others

    def _tail(self, data: bytes):
        """The two line ends behind a block."""
        want = b"\r\n\r\n"
        n = min(len(data), 4 - len(self.held))
        self.held += data[:n]
        if not want.startswith(bytes(self.held)):
            self._damage("the block does not end where its length says")
            yield self.record
            self.state = "lost"
            return b""
        if len(self.held) == 4:
            yield self.record
            self._start()
        return data[n:]

    def _lost(self, data: bytes):
        """The rest of the member cannot be framed."""
        return b""
        yield


def read_records(stream, keep_payload: bool = True, piece: int = PIECE) -> Iterator[Record]:
    """The records of an archive, in sequence; stream.read(n) gives its bytes."""
    data, damaged = b"", False
    while data := data or stream.read(piece):
        z, parser, full = zlib.decompressobj(31), RecordParser(keep_payload), False
        skip, before = 1, b""  # where to look for the next member if this one is damaged
        while not z.eof:
            if not data and not full:
                data = stream.read(piece)
                if not data:
                    if not damaged:
                        yield _cut_short(parser, "the archive ends within a member")
                    return
            now = data
            try:
                out = z.decompress(now, piece)
            except zlib.error:
                if not damaged:
                    yield _cut_short(parser, "a gzip member is damaged")
                damaged = True
                data = _next_member((before + now)[skip:], stream, piece)
                break
            full = len(out) == piece
            data = z.unused_data if z.eof else z.unconsumed_tail
            if len(data) < len(now):
                skip, before = 0, now[: len(now) - len(data)][-2:]
            for r in parser.feed(out):
                damaged = False
                yield r
        else:
            yield from parser.end()


def _cut_short(parser: RecordParser, what: str) -> Record:
    """The record that was being read, with what happened to its member."""
    parser.record.problem = parser.record.problem or what
    return parser.record


def _next_member(data: bytes, stream, piece: int) -> bytes:
    """What follows from the next bytes that look like the head of a member; empty at the end."""
    while True:
        at = data.find(b"\x1f\x8b\x08")
        if at >= 0:
            return data[at:]
        more = stream.read(piece)
        if not more:
            return b""
        data = data[-2:] + more


# -- the data source --------------------------------------------------------------------------------


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else f"file://{uri[5:]}")


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


@dataclass
class Archive(InputPartition):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int) -> None:
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        fs, root = _at(self.path)
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    for part in member(row, date):
                        out.write(part)
                    if out.tell() >= self.archive_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        fs, root = _at(self.path)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with fs.open_output_stream(f"{root}/{MANIFEST}.new", compression=None) as out:
            out.write(json.dumps(names).encode())
        fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Archives | None]) -> None:
        fs, root = _at(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                fs.delete_file(f"{root}/{n}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, keep_payload: bool) -> None:
        self.path, self.keep = path, keep_payload

    def partitions(self) -> list[Archive]:
        """The archives that the manifest names; without one, all *.warc.gz of the folder."""
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                names = json.loads(f.read())
        else:
            names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".warc.gz"))
        return [Archive(n) for n in names] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _at(self.path)
        rows, size = [], 0
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None) as stream:
            for r in read_records(stream, self.keep):
                f = r.fields
                bare = lambda k: f[k].strip("<>") if k in f else None  # noqa: B023, E731
                rows.append((partition.name, bare("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), bare("warc-refers-to"), r.payload_bytes, r.payload_digest, r.payload, r.problem))
                size += len(r.payload or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


class WarcSource(DataSource):
    """format("warc"): options path, payload (false: lengths and digests alone), archive_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        fs, root = _at(self.options["path"])
        fs.create_dir(root, recursive=True)
        return WarcWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


# -- pages ------------------------------------------------------------------------------------------


def page_records(pages: DataFrame, least: int = LEAST_REVISIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, payload) of pages(page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("key", F.when(F.col("payload_bytes") >= least, F.sha2("payload", 256)))
    record_id = lambda page: F.concat(F.lit(PAGE), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("payload_digest"))
    groups = p.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL").drop("n")
    groups = written(groups, "payloads")
    if groups.count() <= most_broadcast:
        p = p.join(F.broadcast(groups), "key", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left").drop("salt")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    p = p.withColumn("payload_digest", F.sha1("payload"))
    return p.select(
        record_id(F.col("page_id")).alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, record_id(F.col("keeper"))).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes records with the columns of page_records as archives in a new folder."""
    spark = records.sparkSession
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    records.write.format("warc").option("archive_bytes", archive_bytes).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """SCHEMA: all records of the archives of a folder."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(record_id: str):
    """The page_id within a record's name."""
    return F.regexp_extract(record_id, f"^{PAGE}(-?[0-9]+):", 1).try_cast("long")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of archives, read back; problem is null where framing and digests are right."""
    at = scratch(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), at)
    r = read_warc(spark, at, payload=False)
    return r.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "problem")


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE octet_length(encode(html)) >= {LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.keeper IS DISTINCT FROM p.page_id AND g.keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.keeper IS DISTINCT FROM p.page_id THEN g.keeper END AS refers_to, NULL::VARCHAR AS problem
FROM p LEFT JOIN g USING (html)
"""
