"""WARC archives as a chunked record table: a row for each chunk of each record, so that no record is ever whole in memory."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import partitions, table

CHUNK = 64 << 10
LEAST = 100  # bytes of a payload that a revisit can refer to
SMALL = 50_000  # repeated payloads up to which their table is broadcast (under 10 MB)
DATE = "2024-01-01T00:00:00Z"
ARCHIVE = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("running", pa.string()), ("data", pa.binary())])
FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("digest_ok", pa.bool_())])


def header(record_id: str, uri: str | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """The head of a record up to its payload: WARC fields, then those of the HTTP response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if refers_to else size)}", "", ""]
    return "\r\n".join(lines).encode() + http


def chunks(head: bytes, payload: memoryview, size: int) -> Iterator[tuple[bytes, str]]:
    """A record's bytes in pieces of `size`, each with the digest of the payload up to its end, which runs along; the
    payload is sliced, not copied whole."""
    total, at, sha = len(head) + len(payload) + 4, 0, hashlib.sha256()
    while at < total:
        stop, piece = min(at + size, total), bytearray()
        if at < len(head):
            piece += head[at:stop]
        a, b = max(at - len(head), 0), min(stop - len(head), len(payload))
        if b > a:
            piece += payload[a:b]
            sha.update(payload[a:b])
        if stop > (e := len(head) + len(payload)):
            piece += b"\r\n\r\n"[max(at - e, 0) : stop - e]
        yield bytes(piece), sha.copy().hexdigest()
        at = stop


class Reader:
    """Reads a record from its chunks, one at a time: the digest runs along, and only the head is kept."""

    def __init__(self) -> None:
        self.head, self.body, self.left, self.sha, self.size = b"", None, 0, hashlib.sha256(), 0

    def feed(self, data: memoryview, running: str) -> None:
        """The next chunk and the digest that the payload should have by its end."""
        self._take(data)
        if self.sha.copy().hexdigest() != running:
            raise ValueError(f"a chunk is damaged before byte {self.size} of a payload")

    def _take(self, data: memoryview) -> None:
        if self.body is None:
            self.head += data
            first = self.head.find(b"\r\n\r\n")
            second = self.head.find(b"\r\n\r\n", first + 4) if first >= 0 else -1
            if second < 0:
                return
            data = memoryview(self.head)[second + 4 :]
            self.fields = dict(x.split(b": ", 1) for x in self.head[:first].split(b"\r\n")[1:])
            self.http = dict(x.split(b": ", 1) for x in self.head[first + 4 : second].split(b"\r\n")[1:])
            self.left = int(self.fields[b"Content-Length"]) - (second - first)
            self.body, self.head = b"", b""
        own = data[: self.left]
        self.sha.update(own)
        self.size += len(own)
        self.left -= len(own)

    def row(self, page_id: int | None) -> tuple:
        if self.body is None or self.left:
            raise ValueError(f"a record of page {page_id} is cut off")
        kind = self.fields[b"WARC-Type"].decode()
        stated = self.fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
        uri = self.fields.get(b"WARC-Target-URI")
        if kind == "revisit":
            refers = int(self.fields[b"WARC-Refers-To"].split(b":")[2].rstrip(b">"))
            return page_id, int(self.http[b"Content-Length"]), stated, kind, refers, uri and uri.decode(), None
        return page_id, self.size, self.sha.hexdigest(), kind, None, uri and uri.decode(), stated == self.sha.hexdigest()


def archive(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record table of pages (page_id, url, html), written to the shared folder: a row for each chunk of a record,
    with the digest of its payload so far.

    Very long payloads become as many chunks as they need. Other columns of the table are not read, whatever their names;
    an empty table gives an empty archive. A record is named by its page and its place in the table, which is the same
    however often the table's files are read; a revisit names the record that it refers to.

    Of equal payloads of LEAST bytes or more the smallest page_id is the response, others revisit it; rows that share
    that page_id are all responses. Null html: an empty payload; null url: no target; null page_id: last in
    order, so a revisit if any other page has its payload. A payload that a third of all pages share is one row of the repeats' table, and the join with
    it can be split by AQE, since both sides are plain exchanges; a small table is broadcast after counting it.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2("html", 256))
    facts = rows.select("page_id", "row", "digest", F.octet_length("html").alias("n")).where(f"n >= {LEAST}")
    named = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("named")
    firsts = facts.groupBy("digest").agg(named, F.count(F.lit(1)).alias("c")).where("c > 1 and named is not null").select("digest", F.col("named.page_id").alias("first"), F.col("named.row").alias("first_row"))
    firsts = table(firsts, "repeats")
    small = firsts.limit(SMALL + 1).count() <= SMALL
    joined = rows.join(F.broadcast(firsts) if small else firsts, "digest", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            held = 0
            for page, url, row, digest, first, first_row, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "row", "digest", "first", "first_row")), batch.column("html"), strict=True):
                payload = memoryview(text.as_buffer())
                rid = f"page:{'' if page is None else page}:{row}"
                head = header(rid, url, digest, len(payload), None if first is None else f"page:{first}:{first_row}")
                body = memoryview(b"") if first is not None else payload
                n = max(1, -(-(len(head) + len(body) + 4) // chunk))
                for k, (piece, running) in enumerate(chunks(head, body, chunk)):
                    out.append((rid, page, k, n, running, piece))
                    held += len(piece)
                    if held > 4 << 20:
                        yield _batch(out, ARCHIVE)
                        out, held = [], 0
            if out:
                yield _batch(out, ARCHIVE)

    made = joined.mapInArrow(write, "record_id string, page_id bigint, chunk int, chunks int, running string, data binary")
    return table(made, "warc")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read(records: DataFrame) -> DataFrame:
    """A row for each record. Records of one chunk are read where they lie; only oversized ones are brought together by
    record and streamed in chunk order, each with the memory of a chunk."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, done = None, None, []
        for batch in it:
            for rid, page, k, n, running, data in zip(*(batch.column(c).to_pylist() for c in ("record_id", "page_id", "chunk", "chunks", "running")), batch.column("data"), strict=True):
                if k == 0:
                    reader, now = Reader(), rid
                elif rid != now:
                    raise ValueError(f"{rid} begins with chunk {k}")
                reader.feed(memoryview(data.as_buffer()), running)
                if k == n - 1:
                    done.append(reader.row(page))
            if done:
                yield _batch(done, FOUND)
                done = []

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, digest_ok boolean"
    whole = records.where("chunks = 1").mapInArrow(run, ddl)
    many = records.where("chunks > 1").repartition(partitions(records.sparkSession), "record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(run, ddl)
    return whole.unionByName(many)


def export(records: DataFrame, page_id: int, out) -> None:  # noqa: ANN001
    """Streams one page's records into a writable file, as a .warc holds them."""
    for r in records.where(F.col("page_id") == page_id).orderBy("record_id", "chunk").toLocalIterator():
        out.write(r["data"])


def page_table(pages: DataFrame) -> DataFrame:
    """The digest of op3: what the archives say, after writing and reading all of them."""
    return read(archive(pages))
