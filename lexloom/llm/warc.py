"""WARC archives: a writer and a sequential reader.

Writing: one gzip member per record. Spark's text writer puts the members into files, so archives land on
any store Spark reaches and only committed tasks leave files. That writer ends each row with a
separator; a member's last byte is the top byte of its length, which is zero below 16 MB, so the row is the
member without it and the separator is a zero byte. A larger record is followed by an empty member.

Files are bounded by bytes: records go by size classes, and each class has as many records a file as the bound
holds of its largest; only a record beyond the bound has a larger file, of its own.

Reading: archives are opened as streams and read front to back, one record in memory at a time. Each member is
inflated piece by piece, the header is parsed as soon as it is complete, the block is framed by
Content-Length, and its digests are verified. A store that Python cannot open is read by Spark, file by file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, remove_at_end, shared_dir, shuffles_end

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: Bytes of records in a file, uncompressed, and the limits of the size classes.
FILE_BYTES, CLASSES = 1 << 26, (1 << 15, 1 << 20, 1 << 23)
#: Upper 64 bits of record ids, so that a page's id can be read from its record's; the other is for rows without an id.
_PAGE, _NONE = 0x6C65786C6F6F4D01, 0x6C65786C6F6F4D02


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    high, low = (_PAGE, page) if page is not None else (_NONE, 0)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low % 2**64)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = number & (2**64 - 1)
    return None if number >> 64 == _NONE else low - 2**64 * (low >= 2**63)


def _plain(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, is_revisit: bool = False) -> bytes:
    """A response, or a revisit that holds the HTTP header but not the payload, as WARC/1.1."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if is_revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """data as gzip, ended by a zero byte."""
    packed = _gzip(data, level)
    return packed if packed[-1] == 0 else packed + _gzip(b"", level)


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head), body


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Damaged(ValueError):
    """An archive that is cut short, is framed wrongly or fails a digest."""


def read(stream, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order. Zero bytes between members and members of nothing are passed over."""
    pending = b""
    while True:
        pending = pending.lstrip(b"\0") if pending else pending
        if not pending:
            pending = stream.read(chunk)
            if not pending:
                return
            continue
        inflate, got, head, need = zlib.decompressobj(31), bytearray(), None, None
        while not inflate.eof:
            if not pending and not (pending := stream.read(chunk)):
                raise Damaged("the archive ends inside a record")
            try:
                got += inflate.decompress(pending)
            except zlib.error as error:
                raise Damaged(str(error)) from error
            pending = inflate.unused_data
            if head is None and (end := got.find(b"\r\n\r\n")) >= 0:
                if not got.startswith(b"WARC/"):
                    raise Damaged("no WARC header")
                head = _fields(bytes(got[:end]))
                try:
                    need = end + 4 + int(head["content-length"])
                except (KeyError, ValueError) as error:
                    raise Damaged("no Content-Length") from error
                start = end + 4
            if need is not None and len(got) > need + 4:
                raise Damaged("a record is longer than its Content-Length")
        if not got:
            continue
        if need is None or len(got) != need + 4 or got[need:] != b"\r\n\r\n":
            raise Damaged("a record isn't framed by its Content-Length")
        found = Record(head, bytes(got[start:need]))
        if (said := head.get("warc-block-digest")) and said != f"sha1:{base32_sha1(found.block)}":
            raise Damaged(f"{head.get('warc-record-id')}: block digest")
        if head.get("warc-type") == "response" and (said := head.get("warc-payload-digest")) and said != f"sha1:{base32_sha1(found.http[1])}":
            raise Damaged(f"{head.get('warc-record-id')}: payload digest")
        yield found


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 3) -> None:
    """Archives of a record for each row below path, with payloads of file_bytes a file at most, or one record.

    Of rows with equal payloads of at least min_bytes, that with the largest key is the response and the
    others revisit it; rows that repeat that key are responses too. A null payload is empty, a null url
    is left out, and a row with a null key revisits another's response or, with none, is a response.
    No group of equal payloads is gathered: keys are summed before the shuffle and joined back. Tables whose
    payloads are of one size class are written in one go, others once for each class.
    """
    scratch = Scratch(pages.sparkSession)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    digest = [F.sha1("body").alias("sha1"), F.octet_length("body").alias("n")]
    limits = [min(c, file_bytes) for c in CLASSES]
    size_class = lambda n: sum((n > c).cast("int") for c in limits)
    sizes = {r["c"] for r in rows.select(size_class(F.octet_length("body")).alias("c")).distinct().collect()}
    equal = rows.select("k", *digest).filter(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.max("k").alias("top"), F.count("*").alias("m"))
    equal = scratch.keep(equal.filter("m > 1").select("sha1", "n", "top"))
    joined = rows.select("*", *digest).join(equal, ["sha1", "n"], "left")
    again = F.col("top").isNotNull() & ~F.col("k").eqNullSafe(F.col("top"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                cols = [part.column(i).to_pylist() for i in range(5)]
                got = [member(record(k, u, b, top, is_again), level)[:-1] for k, u, b, top, is_again in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["value"])

    with shuffles_end(pages.sparkSession):
        for i, most in enumerate([*(file_bytes // c for c in limits), 1]):
            if i in sizes or not (i or sizes):
                some = joined.filter(size_class(F.col("n")) == i) if len(sizes) > 1 else joined
                out = some.select("k", "url", "body", "top", again.alias("again")).mapInArrow(packed, "value binary")
                out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, most)).mode("error").text(f"{path}/class-{i}")


def _open(url: str):
    """A stream of a file that Spark named."""
    if url.startswith("file:"):
        return open("/" + url.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(url)
    return system.open_input_stream(at, compression=None)


def _opens(url: str) -> bool:
    try:
        with _open(url) as stream:
            stream.read(1)
    except (OSError, ValueError, ImportError):
        return False
    return True


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path: record_id, page_id, record_type, url, refers_to,
    payload_bytes, payload_digest and payload (null for a revisit). An archive that is damaged fails the read.

    Where the driver can open the first file by itself, tasks open theirs as streams, of any length; elsewhere
    Spark reads each file whole.
    """
    names = ["record_id", "page_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def row(found: Record) -> tuple:
        h, (http, body) = found.headers, found.http
        revisit = h["warc-type"] == "revisit"
        return (
            h["warc-record-id"],
            page_of(h["warc-record-id"]),
            h["warc-type"],
            h.get("warc-target-uri"),
            page_of(h["warc-refers-to"]) if revisit else None,
            int(http["content-length"]) if revisit else len(body),
            h["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(body),
            None if revisit else body,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column(0)[i]
                rows, size = [], 0
                with _open(one.as_py()) if streamed else io.BytesIO(memoryview(one.as_buffer())) as stream:
                    for found in read(stream):
                        rows.append(row(found))
                        size += len(found.block)
                        if size > 8_000_000 or len(rows) >= 2000:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    first = files.select("path").head()
    streamed = first is not None and _opens(first[0])
    return files.select("path" if streamed else "content").mapInArrow(
        run, "record_id string, page_id bigint, record_type string, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """read_archives() of what write() made of pages, in a new folder below the shared one, which goes when the driver ends."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    write(pages, path, **options)
    return read_archives(spark, path)
