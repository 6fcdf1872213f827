"""WARC archives with revisit records.

Headers (page, digest, size) are shuffled by payload digest and grouped: the record with the largest page_id of a digest
keeps its payload, all others become revisit records that refer to it. Only then are archives written, with fresh headers
and one gzip member a record; payloads never travel by digest, so a payload that a third of all pages share costs nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.common import discard, fresh_path, staged
from lettermill.llm.token_output import _open

#: Bytes of an archive, headers included, after which a task begins a new one, and the compression level of its members.
ARCHIVE_BYTES = 64 << 20
#: Bytes that the reader unpacks at once.
READ_BYTES = 1 << 13
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page-row:{row}')}>"


def one_line(value: str | None) -> str:
    """A header value: line ends would end the header."""
    return " ".join((value or "").split())


def write_record(page: int | None, row: int, url: str | None, digest: str, size: int, payload: bytes | None, original: tuple[int, int] | None) -> bytes:
    """One gzip member. payload is None for a revisit record, whose original is (row, page) of the response."""
    head = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", record_id(row)), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(size))]
    if original is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original[0])), ("X-Refers-To-Page-Id", str(original[1]))]
    block = payload or b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def _members(raw: bytes) -> Iterator[bytes]:
    """Each gzip member of an archive, unpacked. Bytes go in a few at a time, so what a member leaves over is small."""
    view, at = memoryview(raw), 0
    while at < len(view):
        stream, parts = zlib.decompressobj(31), []
        while not stream.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + READ_BYTES]
            parts.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        yield b"".join(parts)


def read_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each member of an archive."""
    for data in _members(raw):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(sha1_hex):
    """Base32 of a SHA-1 in hexadecimal, in DataFrame functions: 160 bits are 32 groups of five."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for part in range(8):  # five hexadecimal digits are four base32 letters
        number = F.conv(F.substring(sha1_hex, 5 * part + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit(letters), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*groups)


def numbered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(row, page_id, url, html, sha1, size), written once: row numbers the rows, and each later scan reads the same numbers."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return staged(rows.withColumns({"sha1": F.lower(F.sha1(payload)), "size": F.octet_length(payload).cast("long")}), "numbered")


def resolve(head: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Revisit records only: (row, response_row, response_page). Of the rows with one digest and at least least_bytes, the one
    with the largest page_id (the latest row, where it repeats) is the response; a null page_id is smaller than any."""
    kept = head.where(F.col("size") >= least_bytes)
    best = kept.groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "best")
    told = kept.join(best, "sha1").where(F.col("row") != F.col("best.row"))
    return told.select("row", F.col("best.row").alias("response_row"), F.col("best.page_id").alias("response_page"))


def _writer(path: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(path)
        where.create_dir(base, recursive=True)
        out, own, name, size, count = None, "", "", 0, 0
        part = TaskContext.get().partitionId()
        number = 0

        def close() -> list[tuple[str, int]]:
            nonlocal out, number
            if out is None:
                return []
            out.close()
            out = None
            number += 1
            where.move(own, f"{base}/{name}")  # a task that runs again gives the same name
            return [(name, count)]

        for batch in batches:
            done: list[tuple[str, int]] = []
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                value = {n: c[i].as_py() for n, c in get.items()}
                revisit = value["response_row"] is not None
                payload = None if revisit else (value["html"] or "").encode()
                if out is None:
                    name = f"pages-{part:06d}-{number:04d}.warc.gz"
                    own = f"{base}/.{name}.{uuid.uuid4().hex}"
                    out, size, count = where.open_output_stream(own, compression=None), 0, 0
                written = write_record(value["page_id"], value["row"], value["url"], value["digest"], value["size"], payload, (value["response_row"], value["response_page"]) if revisit else None)
                out.write(written)
                size += len(written)
                count += 1
                if size >= archive_bytes:
                    done += close()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["name", "records"])
        done = close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["name", "records"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for each row of pages; the manifest (name, records) is returned, already written.

    The payload is the text in UTF-8; a null one is empty. Repeated rows and page ids each have a record; other columns are
    ignored; an empty table writes no archive. The numbered pages are written before anything else, so that revisits and pages
    have the same numbers whatever order a scan of pages gives. The revisit records' headers are written next, so the join that
    brings them to the pages knows their size: Spark sends them to all tasks when they are few and sorts both sides when not.
    """
    rows = numbered(pages, id_col, url_col, payload_col)
    gone = staged(resolve(rows.select("row", "page_id", "sha1", "size"), least_bytes), "revisits")
    told = rows.join(gone, "row", "left")
    slim = told.select("row", "page_id", "url", F.when(F.col("response_row").isNull(), F.col("html")).alias("html"), _base32(F.col("sha1")).alias("digest"), "size", "response_row", "response_page")
    out = staged(slim.mapInArrow(_writer(path, archive_bytes), "name string, records long"), "archives")
    discard(rows, gone)
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for raw in batch.column(0):
            rows: list[tuple] = []
            for head, block in read_records(raw.as_py()):
                kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                if kind == "response" and (digest_of(block), len(block)) != (digest, size):
                    raise ValueError(f"payload of page {head['X-Page-Id']} does not match its header")
                page = head["X-Page-Id"]
                other = head.get("X-Refers-To-Page-Id", "")
                rows.append((int(page) if page else None, size, digest, kind, int(other) if other not in ("", "None") else None, head["WARC-Target-URI"]))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record; responses' payloads are held
    against their headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def deduplicate(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives to a new folder of the shared one and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    if not write_archives(pages, path, least_bytes).take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return read_archives(spark, path)
