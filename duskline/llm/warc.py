"""WARC archives: written one gzip member per record, read back sequentially.

Archives are folders of gzipped WARC files written by Spark's text writer (so their names are
those it gives), and can lie in any store Spark reaches. That writer ends each row with a separator; here it is the zero byte that
ends every gzip member of a record under 16 MiB (the high byte of its length), which the rows
leave out. A larger record is followed by an empty member, whose last byte is zero as well. The
files are therefore plain sequences of gzip members.

A reader task takes one file, inflates it in small steps, frames each record by its
Content-Length and checks block and payload digests. Records of equal payloads of at least
`min_revisit` bytes: that of the smallest page_id is the response, the others are revisits
without payload, whose HTTP header keeps the full length.

Defined cases: a null html is empty; a null url is written as an empty one; a null page_id comes
after all others and is written as an empty id; rows that repeat the response's page_id and
payload are responses too; an empty table gives an archive without records; other columns of the
pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ_STEP = 1 << 16
# Rows of one file hold about this many bytes of payload at the mean length.
FILE_BYTES = 16 << 20
EMPTY_MEMBER = zlib.compress(b"", 9, 31)
DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, payload binary"
)


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn[len("<urn:page:") : -1]
    return int(number) if number else None


def record(
    page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool
) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(first)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "!#$&'()*+,/:;=?@[]~-._|^`{}\"<>\\"


def member(data: bytes) -> bytes:
    return zlib.compress(data, 6, 31)


def _row(data: bytes) -> bytes:
    """A member without the zero byte that the writer's separator puts back."""
    whole = member(data)
    return (whole if whole[-1] == 0 else whole + EMPTY_MEMBER)[:-1]


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of each gzip member, inflated step by step; empty members are left out."""
    inflate, held = zlib.decompressobj(31), []
    begun = False
    for chunk in chunks:
        while chunk:
            begun = True
            held.append(inflate.decompress(chunk))
            chunk = b""
            if inflate.eof:
                chunk = inflate.unused_data
                if content := b"".join(held):
                    yield content
                inflate, held, begun = zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the archive ends within a member")


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _fields(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head + b"\r\n")}


def parse(content: bytes) -> tuple:
    """The row of one record; raises WarcError where lengths or digests do not hold."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    fields = _fields(head.partition(b"\r\n")[2])
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError("the block does not have its Content-Length")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block does not have its digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = int(_fields(http.partition(b"\r\n")[2])["content-length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise WarcError("the payload does not have its length or digest")
    return (
        _page(fields["warc-record-id"]),
        unquote(fields.get("warc-target-uri", "")),
        kind,
        _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        length,
        digest,
        payload if kind == "response" else None,
    )


def _payload():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Writes one record per row of `pages` (page_id, url, html) as gzipped WARC files under `path`."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digests = source.select(
        "page_id", F.sha1(_payload()).alias("digest"), F.length(_payload()).alias("bytes")
    )
    # Only payloads that occur more than once need a look-up; the join below is on the page.
    first = (
        digests.where(F.col("bytes") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    later = (
        digests.join(first, "digest")
        .where("page_id is null or page_id <> first")
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
        .distinct()
    )
    total = digests.agg(F.count("*"), F.sum("bytes")).head()
    rows = max(1, int(FILE_BYTES * total[0] / max(total[1] or 1, 1)))
    keyed = source.withColumn("digest", F.sha1(_payload()))
    marked = keyed.join(
        later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left"
    ).select("page_id", "url", _payload().alias("html"), "first", F.col("d").isNotNull().alias("revisit"))

    def compress(batches):
        for batch in batches:
            lines = [
                _row(record(*values))
                for values in zip(
                    batch.column(0).to_pylist(),
                    batch.column(1).to_pylist(),
                    (v.as_py() for v in batch.column(2)),
                    batch.column(3).to_pylist(),
                    batch.column(4).to_pylist(),
                    strict=True,
                )
            ]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])

    (
        marked.mapInArrow(compress, "line binary")
        .select(F.col("line").cast("string").alias("line"))
        .write.option("lineSep", "\x00")
        .option("maxRecordsPerFile", rows)
        .mode("overwrite")
        .text(path)
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`; without `payloads` these are only verified."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                steps = (
                    data.slice(at, min(READ_STEP, data.size - at)).to_pybytes()
                    for at in range(0, data.size, READ_STEP)
                )
                held, size = [], 0
                for item in members(steps):
                    row = parse(item)
                    held.append(row if payloads else (*row[:-1], None))
                    size += len(item)
                    if size > FILE_BYTES or len(held) >= 10_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def round_trip(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Writes the pages as archives in a folder of their own under `folder` and reads them back."""
    path = f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_revisit)
    return read_archives(pages.sparkSession, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
