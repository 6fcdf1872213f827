"""Attachments: content-addressed storage, duplicates, context, conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators.mail import contains, sort_allowed


def attachment_duplicate_stats(attachments: DataFrame) -> DataFrame:
    """One row: records, distinct hashes, copies within a mail, hashes that several mails share. One pass to (email, hash),
    one to hash."""
    pairs = attachments.groupBy("email_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    hashes = pairs.groupBy("hash").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("copies"), F.count(F.lit(1)).alias("mails"))
    named = F.col("hash").isNotNull()
    return hashes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("hash").alias("unique_hashes"),
        F.coalesce(F.sum(F.when(named, F.col("copies"))), F.lit(0)).alias("copies_within_mail"),
        F.count_if(named & (F.col("mails") > 1)).alias("shared_hashes"),
    )


def group_by_content(attachments: DataFrame) -> DataFrame:
    """One row for each hash: a representative (smallest id) and all mails that have it."""
    kept = attachments.where(X.blank_to_null(F.col("hash")).isNotNull())
    return kept.groupBy("hash").agg(F.min("id").alias("id"), F.min_by("filename", "id").alias("filename"), F.array_sort(F.collect_set("email_id")).alias("email_ids"))


def content_members(attachments: DataFrame) -> DataFrame:
    """(hash, email_id): every mail that has a content, once. Rows instead of a list, so a content of a third of all mails is
    no value that one task must hold."""
    return attachments.where(X.blank_to_null(F.col("hash")).isNotNull()).select("hash", "email_id").distinct()


def content_representatives(attachments: DataFrame) -> DataFrame:
    """(hash, id, filename, n_mails): for each content the smallest id with its name, and how many mails have it. Members stay
    in content_members; only partial minima and counts meet at a hash."""
    kept = attachments.where(X.blank_to_null(F.col("hash")).isNotNull())
    pairs = kept.groupBy("hash", "email_id").agg(F.min(F.struct("id", "filename")).alias("first"))
    # mails without an id count for nothing, as in a list of members
    groups = pairs.groupBy("hash").agg(F.min("first").alias("first"), F.count("email_id").alias("n_mails"))
    return groups.select("hash", "first.id", "first.filename", "n_mails")


def dedupe_attachments(attachments: DataFrame) -> DataFrame:
    """One row for each mail and hash, the smallest id; rows without a hash stay."""
    w = Window.partitionBy("email_id", "hash").orderBy("id")
    kept = attachments.where("hash is not null").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return kept.unionByName(attachments.where("hash is null"))


def new_attachments_only(groups: DataFrame, indexed: DataFrame) -> DataFrame:
    return groups.join(indexed.select("hash"), "hash", "left_anti")


def attachments_of_emails(attachments: DataFrame, mails: DataFrame) -> DataFrame:
    return attachments.join(mails.select(F.col("id").alias("email_id")), "email_id", "left_semi")


def with_email_context(attachments: DataFrame, mails: DataFrame) -> DataFrame:
    """Attachments with subject, sender and time of their mail."""
    m = mails.select(F.col("id").alias("email_id"), F.col("subject").alias("email_subject"), "sender_name", "received", "pst_file")
    return attachments.join(m, "email_id", "left")


def search_attachments(attachments: DataFrame, q=None, filename=None, extension=None, min_size=None, max_size=None, subject=None, sender=None, pst_file=None, first=None, last=None, sort_by="received", descending=True, limit=1000) -> DataFrame:
    """Attachments with context that meet all given criteria."""
    out = attachments
    if q:
        out = out.where(contains(F.col("filename"), q) | contains(F.col("email_subject"), q) | contains(F.col("sender_name"), q) | contains(F.col("pst_file"), q))
    if filename:
        out = out.where(contains(F.col("filename"), filename))
    if extension:
        out = out.where(F.lower("filename").endswith("." + extension.lower()))
    if min_size is not None:
        out = out.where(F.col("size") >= min_size)
    if max_size is not None:
        out = out.where(F.col("size") <= max_size)
    for column, part in (("email_subject", subject), ("sender_name", sender), ("pst_file", pst_file)):
        if part:
            out = out.where(contains(F.col(column), part))
    if first or last:
        out = out.where(X.in_days(F.col("received"), first, last))
    return sort_allowed(out, sort_by, descending, limit, allowed=("received", "filename", "size", "email_subject", "sender_name"))


def store_blobs(contents: DataFrame, stored: DataFrame) -> DataFrame:
    """New blobs (hash, content) of contents (id, content): one for each hash that is not stored yet."""
    hashed = contents.withColumn("hash", X.content_hash(F.col("content")))
    return hashed.groupBy("hash").agg(F.first("content").alias("content")).join(stored.select("hash"), "hash", "left_anti")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Blobs in folders by the first two signs of their hash."""
    blobs.withColumn("prefix", F.substring("hash", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def write_attachment_index(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Index rows: content groups with their converted text."""
    return groups.join(texts.select("hash", "markdown"), "hash").select("hash", "filename", "email_ids", "markdown")


def plain_converter(name: str, content: bytes) -> str:
    """Text of a text or HTML file."""
    out = content.decode("utf-8", "replace")
    if name.lower().endswith((".html", ".htm")):
        import html
        import re

        out = html.unescape(re.sub(r"<[^>]+>", " ", out))
    return " ".join(out.split())


def convert_documents(documents: DataFrame, convert: Callable[[str, bytes], str] = plain_converter) -> DataFrame:
    """(hash, markdown, error) of documents (hash, filename, content), one row for each hash. A converter that raises gives an
    error in place of a text, so one bad file does not stop the job; batches keep memory bounded."""
    unique = documents.groupBy("hash").agg(F.min_by(F.struct("filename", "content"), "filename").alias("d")).select("hash", "d.filename", "d.content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, name, content in zip(batch["hash"], batch["filename"], batch["content"], strict=True):
                try:
                    rows.append((h, convert(name, bytes(content)), None))
                except Exception as e:  # noqa: BLE001  any converter failure is a row of the dead letters
                    rows.append((h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["hash", "markdown", "error"])

    return unique.mapInPandas(run, "hash string, markdown string, error string")


def process_attachments(attachments: DataFrame, indexed: DataFrame, blobs: DataFrame, convert=plain_converter) -> tuple[DataFrame, DataFrame]:
    """Index rows of new contents, and dead letters of those that failed: duplicates go before the conversion, and lists of
    members join the converted texts only."""
    groups = new_attachments_only(group_by_content(attachments), indexed)
    narrow = new_attachments_only(content_representatives(attachments), indexed)
    converted = convert_documents(narrow.join(blobs, "hash").select("hash", "filename", "content"), convert)
    failed = converted.where("error is not null").join(narrow, "hash").select("hash", "filename", F.lit("ATTACHMENT_CONVERT").alias("failure_type"), "error")
    return write_attachment_index(groups, converted.where("error is null")), failed
