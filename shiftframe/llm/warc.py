"""WARC archives by way of a chunked record table.

Writing: payloads are hashed by the JVM; of records with equal payloads of at least `least` bytes, that with the
largest id is the response and the others revisit it. Each task streams its records into an archive of its own in the
shared folder, a gzip member per record, with payloads passing in chunks. The archive's name holds a random part, and
only names that a task returns through Spark's own commit enter the manifest, so files of lost or repeated attempts
are never read.

Reading: each archive is streamed by one task, with a bounded buffer. A record becomes one row per chunk, (record,
chunk number, bytes), with length and SHA-1 carried from chunk to chunk, so no record is ever held as a whole; its
last row holds the totals, and the digest is compared with the record's own header. Archives of others can be read as
well, with a gzip member per record or plain: records of any type give chunk rows (of a response with an HTTP head, what
follows it), and what their headers lack is null. A header of over HEADER bytes is refused.

A null payload counts as an empty one. Repeated rows make a record each; rows that share the largest id are all
responses, and have one record identifier if they are equal. A null id is written as an empty header and read as null; it is the response only
if no other record has that payload. Empty tables give an empty manifest and no rows. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Bytes of a chunk.
CHUNK = 1 << 20
READ = 1 << 18
#: Bytes that the header of a record, or the HTTP head in its block, may have.
HEADER = 1 << 20
#: Name space of the record identifiers of responses, which are made from page id and digest, so that revisits can name them.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


class Writer:
    """Streams records into gzip members of one archive."""

    def __init__(self, out):
        self.out = out

    def record(self, headers: list[tuple[str, str]], block: Iterator[bytes], length: int) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {length}", "", ""]
        self.out.write(z.compress("\r\n".join(lines).encode()))
        for part in block:
            self.out.write(z.compress(part))
        self.out.write(z.compress(b"\r\n\r\n") + z.flush())


class Reader:
    """Streams records of one archive: headers, then the block in chunks."""

    def __init__(self, raw):
        self.raw, self.held, self.z = raw, b"", None
        self.rest = raw.read(READ)
        self.plain = not self.rest.startswith(b"\x1f\x8b")

    def _more(self) -> bool:
        """Inflate one more read; a new member begins where the last one ended."""
        while True:
            data = self.rest or self.raw.read(READ)
            self.rest = b""
            if not data:
                return False
            if self.plain:
                part = data
            else:
                if self.z is None:
                    self.z = zlib.decompressobj(31)
                part = self.z.decompress(data, CHUNK)
                if self.z.eof:
                    self.rest, self.z = self.z.unused_data, None
                else:
                    self.rest = self.z.unconsumed_tail
            if part:
                self.held += part
                return True

    def headers(self) -> dict[str, str] | None:
        """The record's headers by lower-case name."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > HEADER:
                raise ValueError("a record's header does not end")
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends within a header")
                return None
        lines = self.held[:end].decode(errors="replace").lstrip("\r\n").split("\r\n")
        self.held = self.held[end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def payload(self, headers: dict[str, str]) -> Iterator[bytes]:
        """The block without the HTTP head of a response."""
        parts = self.block(int(headers["content-length"]))
        if not headers.get("content-type", "").startswith("application/http"):
            yield from parts
            return
        head = b""
        for part in parts:
            head += part
            if (end := head.find(b"\r\n\r\n")) >= 0:
                if head[end + 4 :]:
                    yield head[end + 4 :]
                break
            if len(head) > HEADER:
                raise ValueError("an HTTP head does not end")
        yield from parts

    def block(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held and not self._more():
                raise ValueError("archive ends within a block")
            part, self.held = self.held[: min(length, CHUNK)], self.held[min(length, CHUNK) :]
            length -= len(part)
            yield part
        while len(self.held) < 4 and self._more():
            pass
        if self.held[:4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        self.held = self.held[4:]


def _parts(value: pa.Scalar) -> Iterator[bytes]:
    """A payload's bytes in chunks, each a copy of a slice of Arrow's buffer."""
    buffer = value.as_buffer() if value.is_valid else None
    for k in range(0, buffer.size if buffer else 0, CHUNK):
        yield buffer.slice(k, min(CHUNK, buffer.size - k)).to_pybytes()


def with_roles(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, payload binary, sha1, response, response_url): id and url of the record that this one revisits, or null."""
    one = pages.select(
        pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload")
    ).select("*", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size"))
    last = F.max(F.struct("id", "url")).alias("last")
    groups = one.where(F.col("size") >= least).groupBy("sha1", "size").agg(last, F.count("*").alias("n")).where("n > 1")
    firsts, _ = c.saved(groups.select("sha1", "size", F.col("last.id").alias("response"), F.col("last.url").alias("response_url")), "warc-responses")
    return one.join(firsts, ["sha1", "size"], "left")


def _record_id(page: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{sha1}')}>"


def _uri(url: str | None) -> str:
    return "".join((url or "").split())


def write(pages: DataFrame, *, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; the manifest (path, n_records) names those that count. All records get the date given."""
    spark = pages.sparkSession
    c.tune(spark)
    rows = with_roles(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, least=least)
    folder = c.new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            if out is None:
                fs, at = _open(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(at, compression=None, buffer_size=1 << 20)
                writer = Writer(out)
            ids, urls, sha1s, responses, at_urls = (b.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for k, (page, url, sha1, response, at_url) in enumerate(zip(ids, urls, sha1s, responses, at_urls, strict=True)):
                payload = b.column(2)[k]
                size = payload.as_buffer().size
                again = response is not None and page != response
                headers = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if again else _record_id(page, sha1)), ("WARC-Date", date),
                    ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"), ("Content-Type", "application/http;msgtype=response"),
                    ("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Length", str(size)),
                ]
                if again:
                    headers += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(response, sha1)),
                        ("WARC-Refers-To-Target-URI", _uri(at_url)), ("X-Refers-To-Page-ID", str(response)),
                    ]
                    writer.record(headers, iter(()), 0)
                else:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
                    writer.record(headers, itertools.chain((head,), _parts(payload)), len(head) + size)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    manifest = rows.select("id", "url", "payload", "sha1", "response", "response_url").mapInArrow(run, "path string, n_records long")
    return c.saved(manifest, "warc-manifest")[0]


CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk long, is_last boolean, payload_bytes long, payload_digest string, content binary"


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdecimal() else None


def read(manifest: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table. payload_bytes and payload_digest are carried: of a row's chunk and those before it.

    A revisit's single row has the length and digest that its header states.
    """
    c.tune(manifest.sparkSession)
    schema = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()),
        ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("content", pa.binary()),
    ])

    def records(path: str) -> Iterator[tuple]:
        fs, at = _open(path)
        with fs.open_input_stream(at, compression=None) as raw:
            reader = Reader(raw)
            while (h := reader.headers()) is not None:
                own = h.get("warc-record-id"), _number(h.get("x-page-id")), h.get("warc-type")
                stated = h.get("warc-payload-digest", "")
                stated = stated.removeprefix("sha1:") if stated.startswith("sha1:") else None
                if own[2] == "revisit":
                    for _ in reader.payload(h):
                        pass
                    yield *own, _number(h.get("x-refers-to-page-id")), 0, True, _number(h.get("x-payload-length")), stated, None
                    continue
                digest, got, number, held = hashlib.sha1(), 0, 0, io.BytesIO()
                for part in reader.payload(h):
                    while part:
                        if held.tell() == chunk:  # full, and more to come
                            yield *own, None, number, False, got, base32(digest.digest()), held.getvalue()
                            number, held = number + 1, io.BytesIO()
                        some = part[: chunk - held.tell()]
                        part = part[len(some) :]
                        digest.update(some)
                        got += len(some)
                        held.write(some)
                if own[2] == "response" and stated not in (None, base32(digest.digest())):
                    raise ValueError(f"the payload of {own[0]} does not have its digest")
                yield *own, None, number, True, got, base32(digest.digest()), held.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in records(path):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > c.BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(run, CHUNKS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each record, from the last row of its chunks."""
    chunks = read(write(c.table(spark, sf_dir, "pages")))
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM g
"""
