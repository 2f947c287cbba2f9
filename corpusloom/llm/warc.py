"""WARC archives of pages: written whole, normalised to a gzip member per record, read by index.

``write_archives`` writes one gzip stream per file, as many crawlers and exports do. The
normaliser inflates such a file once, front to back, gives every record a member of its own and
writes a sidecar with the place of each, so that any record can be read alone. ``read_archives``
reads records through the sidecars.

Records with equal payloads of at least 100 bytes: the page of the smallest id is a response,
the others are revisits that refer to it and keep its digest and length in their headers.

Defined results: a null html is an empty payload; a null or unusable url becomes a name made of
the page id; rows without a page id are written, and are never what others refer to; repeated
rows of the page that others refer to are responses too; an empty table gives no archives and no
rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrow import chunks
from corpusloom.llm.stored_files import OutputFile, new_folder, open_input, open_stream, tasks_for

# Smallest payload, in bytes, that another record may refer to.
MIN_REVISIT = 100
# Uncompressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-corpusloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 16 + zlib.MAX_WBITS

ARCHIVES = "part int, seq int, archive string, n_records bigint, n_bytes bigint"
INDEXED = "archive string, sidecar string, n_records bigint, n_bytes bigint"
RECORDS = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, url string, archive string, record_offset bigint, record_length bigint"
)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and ``first_id``: the page that a revisit refers to, else null.

    A payload held by more than a thousandth of all pages is hot; there are at most a thousand
    of them, so they are broadcast and their pages are spread in the join of the others.
    """
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    groups = (
        known.filter(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
        .filter("n > 1 and first_id is not null")
    )
    hot_rows = pages.count() / 1000
    hot = groups.filter(F.col("n") > hot_rows).select(
        F.col("digest"), F.col("first_id").alias("hot_id")
    )
    cold = groups.filter(F.col("n") <= hot_rows).select(
        F.col("digest").alias("key"), F.col("first_id").alias("cold_id")
    )
    joined = known.join(F.broadcast(hot), "digest", "left")
    spread = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    joined = joined.withColumn(
        "key", F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(spread)
    ).join(cold, "key", "left")
    first = F.coalesce("hot_id", "cold_id")
    return joined.select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != first), first).alias("first_id"),
    )


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None,
    name: str, date: str = DATE,
) -> bytes:
    """One WARC/1.1 record; a revisit carries the headers of the exchange alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    identity = f"{_ID}{name if page_id is None else page_id}"
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else identity
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: <{identity}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    block = http + payload
    if first_id is not None:
        head += [f"WARC-Refers-To: <{_ID}{first_id}>", f"WARC-Profile: {_PROFILE}"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes archives of one gzip stream each and returns their manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, archive, number = TaskContext.get().partitionId(), [], None, 0

        def finish():
            out, stream, count, size = archive
            out.write(stream.flush())
            out.close()
            rows.append(
                {"part": part, "seq": len(rows), "archive": out.name, "n_records": count,
                 "n_bytes": size}
            )

        for batch in chunks(batches, "html"):
            for page in batch.to_pylist():
                number += 1
                data = record_bytes(
                    page["page_id"], page["url"], page["html"].encode("utf-8"), page["digest"],
                    page["first_id"], f"none-{part}-{number}",
                )
                if archive is None:
                    out = OutputFile(folder, ".warc.gz")
                    archive = [out, zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0, 0]
                out, stream, _, _ = archive
                out.write(stream.compress(data))
                archive[2] += 1
                archive[3] += len(data)
                if archive[3] >= ARCHIVE_BYTES:
                    finish()
                    archive = None
        if archive:
            finish()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARCHIVES)

    return _stored(marked.mapInArrow(write, ARCHIVES), f"{folder}-written", ARCHIVES)


_ARCHIVES = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("archive", pa.string()),
     ("n_records", pa.int64()), ("n_bytes", pa.int64())]
)
_INDEXED = pa.schema(
    [("archive", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64()),
     ("n_bytes", pa.int64())]
)
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
     ("archive", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64())]
)


def _stored(df: DataFrame, path: str, schema: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def inflated(stream) -> Iterator[bytes]:
    """Pieces of the inflated bytes; a file of several members is read as one."""
    inflate = zlib.decompressobj(_GZIP)
    while data := stream.read(READ_BYTES):
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(_GZIP)
            piece = inflate.decompress(data, READ_BYTES)
            if piece:
                yield piece
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    if not inflate.eof:
        raise EOFError("the gzip stream is cut off")


class _Pieces:
    """Reads lines and counted bytes from pieces, without joining what it passes on."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def head(self) -> bytes:
        """Bytes up to and with the next blank line; empty at the end."""
        while (at := self.rest.find(b"\r\n\r\n")) < 0:
            more = next(self.pieces, b"")
            if not more:
                if self.rest.strip():
                    raise EOFError("a record header is cut off")
                return b""
            self.rest += more
        head, self.rest = self.rest[: at + 4], self.rest[at + 4 :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            self.rest = self.rest or next(self.pieces, b"")
            if not self.rest:
                raise EOFError("a record is cut off")
            piece, self.rest = self.rest[:n], self.rest[n:]
            n -= len(piece)
            yield piece


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def normalise_file(folder: str, name: str) -> dict:
    """Rewrites one archive with a member per record and a sidecar of tab-separated lines
    (offset, length, type, record id); memory holds one piece, never a whole record."""
    out = OutputFile(folder, ".warc.gz")
    lines = []
    with open_stream(folder, name) as stream:
        pieces = _Pieces(inflated(stream))
        while head := pieces.head():
            fields = header_fields(head)
            start = out.size
            member = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
            out.write(member.compress(head))
            for piece in pieces.take(int(fields["content-length"]) + 4):
                out.write(member.compress(piece))
            out.write(member.flush())
            lines.append(
                f"{start}\t{out.size - start}\t{fields['warc-type']}\t{fields['warc-record-id']}\n"
            )
    out.close()
    sidecar = OutputFile(folder, ".idx")
    sidecar.write("".join(lines).encode())
    sidecar.close()
    return {
        "archive": out.name, "sidecar": sidecar.name, "n_records": len(lines), "n_bytes": out.size
    }


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One task per archive; returns the manifest of normalised archives and sidecars."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [normalise_file(folder, name) for name in batch.column("archive").to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEXED)

    spread = manifest.select("archive").repartition(tasks_for(manifest), "archive")
    return _stored(spread.mapInArrow(rewrite, INDEXED), f"{folder}-indexed", INDEXED)


def read_record(data: bytes) -> dict:
    """Fields of one member: the payload's length and digest are taken from the payload itself
    for a response and from the headers for a revisit."""
    raw = zlib.decompress(data, _GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header_fields(head + b"\r\n\r\n")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size = int(header_fields(http + b"\r\n\r\n")["content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_id(fields.get("warc-refers-to", "")),
        "url": fields["warc-target-uri"],
    }


def _page_id(uri: str) -> int | None:
    name = uri.strip("<>").removeprefix(_ID)
    return int(name) if name.lstrip("-").isdigit() else None


def read_archives(indexed: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, found through the sidecars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _records(folder, row["archive"], row["sidecar"])

    files = indexed.select("archive", "sidecar").repartition(tasks_for(indexed), "archive")
    return files.mapInArrow(read, RECORDS)


def _records(folder: str, archive: str, sidecar: str) -> Iterator[pa.RecordBatch]:
    with open_stream(folder, sidecar) as stream:
        lines = stream.read().decode().splitlines()
    rows = []
    with open_input(folder, archive) as file:
        for line in lines:
            offset, length, *_ = line.split("\t")
            file.seek(int(offset))
            record = read_record(file.read(int(length)))
            record |= {
                "archive": archive, "record_offset": int(offset), "record_length": int(length)
            }
            rows.append(record)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back archives of all pages below the shared folder."""
    folder = new_folder(pages.sparkSession, "warc")
    written = write_archives(mark_revisits(pages), folder)
    return read_archives(normalise_archives(written, folder), folder)
