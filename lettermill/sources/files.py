"""Mail files, directory listings, path lists and archives."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators.catalog import under


def _listing(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:(//)?(?=/)", "")
    return files.select(path.alias("path"), F.substring_index(path, "/", -1).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def scan_mail_files(spark: SparkSession, roots: list[str], excluded: list[str] = (), pattern: str = "*.pst") -> DataFrame:
    """Mail files below roots, but for those below an excluded folder (by whole path components). The listing never opens a file."""
    found = _listing(spark, roots, pattern)
    return (found.where(~under(F.col("path"), list(excluded))) if excluded else found).withColumn("status", F.lit("New"))


def scan_directory_index(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """All files below a folder but temporary ones and those whose path contains an excluded text."""
    found = _listing(spark, [root], "*").where(~F.col("path").endswith(".tmp"))
    for part in excluded:
        found = found.where(~F.contains("path", F.lit(part)))
    return found


def refresh_directory_index(index: DataFrame, listing: DataFrame) -> DataFrame:
    """The index after a listing: known paths take the new values, vanished ones go, new ones come."""
    known = index.select("path", F.col("status").alias("_status"))
    return listing.join(known, "path", "left").withColumn("status", F.coalesce("_status", F.lit("New"))).drop("_status")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """Archive paths of a text file, one a line; blank lines drop out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def export_file_list(files: DataFrame, path: str) -> None:
    """Found files as lines of path, size and time."""
    files.select(F.concat_ws("\t", "path", F.col("size").cast("string"), F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))).write.mode("overwrite").text(path)


def ingest_nas_hits(hits: DataFrame, prefix: str, mount: str, now: Column) -> DataFrame:
    """Search hits (nas_path, name, size, modified, content_modified) as catalogue rows; hits without a path or a name drop
    out, the size defaults to 0, the time is the first that is not 0, else now."""
    kept = hits.where((F.coalesce("nas_path", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    seconds = F.coalesce(F.nullif(F.col("modified"), F.lit(0)), F.nullif(F.col("content_modified"), F.lit(0)))
    return kept.select(X.remap_path(F.col("nas_path"), prefix, mount).alias("path"), F.col("name").alias("file_name"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce(seconds, now).cast("long").alias("modified_s"), F.lit("New").alias("status"))


MAIL = "path string, message_id string, subject string, sender string, recipients array<string>, cc array<string>, sent string, body string, html string, attachments array<struct<filename:string,content_type:string,content:binary>>, error string"


def _parse(path: str, raw: bytes) -> Iterator[tuple]:
    """Messages of an .eml file or an mbox; one that cannot be read gives a row with an error."""
    parts = [raw]
    if raw.startswith(b"From "):
        parts = [p.split(b"\n", 1)[-1] for p in (b"\n" + raw).split(b"\nFrom ")[1:]]
    for part in parts:
        try:
            m = email.message_from_bytes(part, policy=email.policy.default)
            plain, html = m.get_body(("plain",)), m.get_body(("html",))
            files = [{"filename": a.get_filename() or f"attachment{i}", "content_type": a.get_content_type(), "content": a.get_payload(decode=True) or b""} for i, a in enumerate(m.iter_attachments())]
            people = lambda field: [a.addr_spec for h in m.get_all(field, []) for a in h.addresses]
            yield (path, m["message-id"], m["subject"], (people("from") or [None])[0], people("to"), people("cc"), m["date"], plain.get_content() if plain else None, html.get_content() if html else None, files, None)
        except Exception as e:  # noqa: BLE001  a broken message is a row of its own
            yield (path, None, None, None, [], [], None, None, None, [], f"{type(e).__name__}: {e}")


def read_mail_archives(spark: SparkSession, roots: list[str], pattern: str = "*.{eml,mbox}") -> DataFrame:
    """Messages of .eml and mbox files below roots, with their attachments as an array."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MAIL.split(", ")]
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(_parse(path, bytes(raw))), columns=names)

    return files.mapInPandas(run, MAIL)


def message_attachments(mails: DataFrame) -> DataFrame:
    """One row for each attachment, with its hash."""
    rows = mails.select("path", "message_id", F.posexplode("attachments").alias("position", "a")).select("path", "message_id", "position", "a.*")
    return rows.withColumn("hash", X.content_hash(F.col("content")))


def read_attachment_bytes(attachments: DataFrame) -> DataFrame:
    """Contents of stored attachments (hash, local_path): one read for each hash, of the wanted files only, dealt over the tasks.
    Paths are of a file system that all tasks see; a missing file is an error."""
    wanted = attachments.groupBy("hash").agg(F.min("local_path").alias("local_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, path in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                where, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
                with where.open_input_stream(base) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([f.read()], pa.binary())], names=["hash", "content"])

    return wanted.mapInArrow(run, "hash string, content binary")


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Bytes of a file that a partial hash covers, and that are read at once.
PART_BYTES, READ_BYTES = 1 << 20, 1 << 22


def hash_files(spark: SparkSession, roots: list[str], pattern: str = "*", most: int | None = PART_BYTES) -> DataFrame:
    """(path, new_hash): SHA-256 of the first `most` bytes of each file, of whole files if most is None. Files are listed, then read
    as far as needed and piece by piece, so neither their size nor their number bounds what can be hashed. Paths are of a file
    system that all tasks see; a file that is gone or may not be read has a null hash; empty files
    are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots).select("path")

    def digest(path: str) -> str | None:
        try:
            local = re.sub("^file:(//)?(?=/)", "", path)
            where, base = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
            found, left = hashlib.sha256(), most
            with where.open_input_file(base) as f:
                while left is None or left > 0:
                    piece = f.read(READ_BYTES if left is None else min(READ_BYTES, left))
                    if not piece:
                        return found.hexdigest()
                    found.update(piece)
                    left = None if left is None else left - len(piece)
            return found.hexdigest()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(p) for p in batch.column(0).to_pylist()], pa.string())], names=["path", "new_hash"])

    return files.mapInArrow(run, "path string, new_hash string").select(F.regexp_replace("path", "^[a-z]+:(//)?(?=/)", "").alias("path"), "new_hash")
