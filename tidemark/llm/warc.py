"""WARC archives as tables of chunks.

An archive is a sequence of gzip members, one per record. The archive table holds it as rows
(archive, seq, chunk_no, last, data): the member of a record, cut into pieces of at most `chunk_bytes`. The data in
order of (archive, seq, chunk_no) are the bytes of an ordinary .warc.gz file. Writing digests and deflates slices of the payload
where Arrow holds it and gives each piece as soon as it is full; reading inflates and parses a record as a
stream and gives rows of at most `chunk_bytes` of payload with the digest so far. So no step makes
a record of any size in one piece. Records of one chunk are read where they lie; only longer ones are brought together.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table


@dataclass(frozen=True)
class WarcConfig:
    chunk_bytes: int = 64 * 1024
    min_revisit_bytes: int = 0  # payloads below this are never stored as revisits
    date: str = "2024-01-01T00:00:00Z"
    batch_bytes: int = 4 << 20  # data that a task gathers before it passes them on
    head_bytes: int = 1 << 20  # a record whose heads are longer is in error


ARCHIVE = "archive string, seq long, chunk_no int, last boolean, data binary"
CHUNKS = "archive string, seq long, record_id string, record_type string, target_uri string, page_id long, refers_to long, chunk_no int, last boolean, payload binary, payload_bytes long, payload_digest string, error string"


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}"


def record_head(kind: str, page_id: int | None, url: str | None, payload_bytes: int, digest: str, c: WarcConfig, refers_to: int | None = None) -> bytes:
    """Everything of a record before its payload. The HTTP head of a revisit still tells the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    uri = (url or "").encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A").decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {c.date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    size = len(http) + (payload_bytes if kind == "response" else 0)
    return "\r\n".join([*lines, f"Content-Length: {size}", "", ""]).encode() + http


def gzip_pieces(parts: Iterable[bytes | memoryview], size: int) -> Iterator[bytes]:
    """One gzip member of the parts, in pieces of `size` bytes."""
    z, held = zlib.compressobj(6, zlib.DEFLATED, 31), bytearray()
    for x in itertools.chain(map(z.compress, parts), (z.flush() for _ in range(1))):
        held += x
        while len(held) > size:
            yield bytes(held[:size])
            del held[:size]
    yield bytes(held)


def _slices(data: pa.Buffer | None, size: int) -> Iterator[memoryview]:
    view = memoryview(data or b"")
    for at in range(0, len(view), size):
        yield view[at : at + size]


def _rows(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[tuple]:
    """Rows of batches as tuples, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(x.to_pylist() for x in part.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, c: WarcConfig) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each passed on once its binary values reach batch_bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= c.batch_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    columns = list(zip(*held, strict=True)) or [[]] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


_MEMBERS = "page_id long, url string, n long, hex string, row long, chunk_no int, last boolean, data binary"


def write_archive(pages: DataFrame, config: WarcConfig = WarcConfig(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The archive table of one record per page, written to the shared folder.

    Of pages with equal payloads of at least min_revisit_bytes bytes the one with the smallest id is a response,
    the others revisit it. Null payloads are empty. Rows that repeat the smallest id are responses, too; pages with
    null ids count as larger than all others and are responses if there is no other. Response members are deflated before
    the join, so that the shuffle moves compressed bytes; equal payloads only meet in a min() and in a join that AQE can split.
    """
    c = config

    def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        row = TaskContext.get().partitionId() << 40  # tells repeated rows apart
        for batch in batches:
            payloads = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                page_id, url, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), payloads[i].as_buffer()
                sha1, n = hashlib.sha1(), 0
                for part in _slices(data, c.chunk_bytes):
                    sha1.update(part)
                    n += len(part)
                head = record_head("response", page_id, url, n, bare_digest(sha1.digest()), c)
                row += 1
                pieces = gzip_pieces(itertools.chain([head], _slices(data, c.chunk_bytes), [b"\r\n\r\n"]), c.chunk_bytes)
                piece, k = next(pieces), 0
                for further in pieces:
                    yield page_id, url, n, sha1.hexdigest(), row, k, False, piece
                    piece, k = further, k + 1
                yield page_id, url, n, sha1.hexdigest(), row, k, True, piece

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, seq = f"tidemark-{TaskContext.get().partitionId():05d}.warc.gz", 0
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {c.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
        yield name, 0, 0, True, next(gzip_pieces([head + info + b"\r\n\r\n"], 1 << 20))
        for page_id, url, n, sha1, chunk_no, last, data, first in _rows(batches):
            if chunk_no == 0:
                seq += 1
            if n < c.min_revisit_bytes or first is None or page_id == first:
                yield name, seq, chunk_no, last, data
            elif chunk_no == 0:
                revisit = record_head("revisit", page_id, url, n, bare_digest(bytes.fromhex(sha1)), c, first) + b"\r\n\r\n"
                yield name, seq, 0, True, next(gzip_pieces([revisit], 1 << 30))

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(deflated(batches), _schema(_MEMBERS), c)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(assembled(batches), _schema(ARCHIVE), c)

    members = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(deflate, _MEMBERS)
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    firsts = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("hex")).groupBy("hex").agg(F.min("page_id").alias("first"))
    ordered = members.join(firsts, "hex").sortWithinPartitions("hex", "page_id", "row", "chunk_no")
    return materialize(ordered.select("page_id", "url", "n", "hex", "chunk_no", "last", "data", "first").mapInArrow(assemble, ARCHIVE), "warc")


class _Record:
    """Parses one record from the pieces of its gzip member and gives chunk rows as payload comes out of it."""

    def __init__(self, archive: str, seq: int, c: WarcConfig, with_payload: bool):
        self.key, self.size, self.head_bytes, self.with_payload = (archive, seq), c.chunk_bytes, c.head_bytes, with_payload
        self.failed = False
        self.z = zlib.decompressobj(31)
        self.held, self.stage, self.left = bytearray(), "warc", 0
        self.head: dict[str, str] = {}
        self.declared = self.payload_bytes = self.chunk_no = 0
        self.sha1 = hashlib.sha1()

    def feed(self, data: bytes) -> Iterator[tuple]:
        """Chunk rows as they are complete; the error row, and nothing after it, once the data turn out not to be a record."""
        try:
            while data and not self.failed and not self.z.eof:
                self.held += self.z.decompress(data, self.size)
                data = self.z.unconsumed_tail
                yield from self._advance()
                if self.stage != "payload" and len(self.held) > self.head_bytes:
                    raise ValueError("the heads don't end")
        except (zlib.error, ValueError) as e:
            yield self._failure(str(e))

    def _failure(self, why: str) -> tuple:
        self.failed = True
        told = {k: self.head.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri")}
        return (*self.key, (told["warc-record-id"] or "").strip("<>"), told["warc-type"], told["warc-target-uri"], None, None, self.chunk_no, False, None, self.payload_bytes, None, why)

    @staticmethod
    def _fields(lines: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}

    def _advance(self) -> Iterator[tuple]:
        if self.stage == "warc" and (at := self.held.find(b"\r\n\r\n")) >= 0:
            self.head = self._fields(bytes(self.held[:at]))
            del self.held[: at + 4]
            self.left = int(self.head.get("content-length", 0))
            self.stage = "http" if self.head.get("content-type", "").startswith("application/http") else "payload"
        if self.stage == "http" and (at := self.held.find(b"\r\n\r\n")) >= 0:
            self.declared = int(self._fields(bytes(self.held[:at])).get("content-length", 0))
            self.left -= at + 4
            del self.held[: at + 4]
            self.stage = "payload"
        while self.stage == "payload" and self.left and len(self.held) >= min(self.size, self.left):
            piece = bytes(self.held[: min(self.size, self.left)])
            del self.held[: len(piece)]
            self.left -= len(piece)
            yield self._row(piece)

    def _row(self, piece: bytes | None) -> tuple:
        self.sha1.update(piece or b"")
        self.payload_bytes += len(piece or b"")
        number = lambda k: int(self.head[k]) if k in self.head else None
        revisit, done = self.head.get("warc-type") == "revisit", self.left == 0
        told = self.head.get("warc-payload-digest", "").removeprefix("sha1:")
        row = (*self.key, self.head.get("warc-record-id", "").strip("<>"), self.head.get("warc-type"), self.head.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), self.chunk_no, done, piece if self.with_payload else None, self.declared if revisit else self.payload_bytes, told if revisit else bare_digest(self.sha1.digest()), None)
        self.chunk_no += 1
        return row

    def end(self) -> Iterator[tuple]:
        if not self.failed and (self.stage != "payload" or self.left):
            yield self._failure("the record is cut off")
        elif not self.failed and not self.chunk_no:
            try:
                yield self._row(None)
            except ValueError as e:
                yield self._failure(str(e))


def read_archive(archive: DataFrame, config: WarcConfig = WarcConfig(), with_payload: bool = True) -> DataFrame:
    """The chunked record table: one row per record and chunk_no, at least one a record.

    payload_bytes and payload_digest are those of the payload up to and with the chunk; a revisit has one row
    without payload, with the figures its headers give for the full payload. The row with `last` set completes a record.
    A record that is cut off, doesn't inflate or has no proper heads ends with a row that has `error` set, and isn't `last`.
    """
    c = config

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        record: _Record | None = None
        for archive_name, seq, data in _rows(batches):
            if record is None or record.key != (archive_name, seq):
                if record is not None:
                    yield from record.end()
                record = _Record(archive_name, seq, c, with_payload)
            yield from record.feed(data or b"")
        if record is not None:
            yield from record.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(records(batches), _schema(CHUNKS), c)

    rows = archive.select("archive", "seq", "data", "chunk_no", "last")
    alone = (F.col("chunk_no") == 0) & F.col("last")
    whole = rows.where(alone).select("archive", "seq", "data")
    cut = rows.where(~alone).repartition("archive", "seq").sortWithinPartitions("archive", "seq", "chunk_no").select("archive", "seq", "data")
    return whole.mapInArrow(run, CHUNKS).union(cut.mapInArrow(run, CHUNKS))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(table(spark, sf_dir, "pages")), with_payload=False)
    return records.where("last and record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the hexadecimal digest: four groups of ten digits give eight letters each.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31), 1)), '')"

OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (hex)
"""
