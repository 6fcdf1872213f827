"""Catalogues of mail files: reconciling scans, plans of work, duplicates, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.operators.mail import contains, sort_allowed

GB = 1024.0**3


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path lies below one of the roots, by whole path components."""
    return reduce(Column.__or__, [path.startswith(r.rstrip("/") + "/") for r in roots], F.lit(False))


def merge_file_catalog(catalog: DataFrame, scan: DataFrame, roots: list[str]) -> DataFrame:
    """The catalogue after a scan of roots: path, size, last_modified, content_hash, status, action.

    A known path whose time or size changed, or that was Deleted, is Modified and takes the new hash; a catalogue row below a
    root that was not found is Deleted; a new path is New unless a file with its hash is there already (in the catalogue, not
    Deleted by this scan, or earlier in the scan by path): such copies are skipped.
    """
    c = catalog.select("path", F.col("size").alias("c_size"), F.col("last_modified").alias("c_time"), F.col("content_hash").alias("c_hash"), F.col("status").alias("c_status"))
    s = scan.select("path", F.col("size").alias("s_size"), F.col("last_modified").alias("s_time"), F.col("content_hash").alias("s_hash"), F.lit(True).alias("found"))
    both = c.join(s, "path", "full_outer")
    changed = (F.col("c_size") != F.col("s_size")) | (F.col("c_time") != F.col("s_time")) | (F.col("c_status") == "Deleted")
    known = both.where("c_status is not null").select(
        "path",
        F.when(F.col("found"), F.col("s_size")).otherwise(F.col("c_size")).alias("size"),
        F.when(F.col("found"), F.col("s_time")).otherwise(F.col("c_time")).alias("last_modified"),
        F.when(F.col("found") & changed, F.col("s_hash")).otherwise(F.col("c_hash")).alias("content_hash"),
        F.when(F.col("found") & changed, F.lit("Modified")).when(F.col("found").isNull() & under(F.col("path"), roots), F.lit("Deleted")).otherwise(F.col("c_status")).alias("status"),
    )
    new = both.where("c_status is null").select("path", F.col("s_size").alias("size"), F.col("s_time").alias("last_modified"), F.col("s_hash").alias("content_hash"))
    there = known.where("content_hash is not null and status <> 'Deleted'").select("content_hash").distinct()
    fresh = first_in_batch(new, "content_hash", "path").where("first").drop("first").join(there, "content_hash", "left_anti")
    return known.unionByName(fresh.withColumn("status", F.lit("New")).select(*known.columns))


def first_in_batch(files: DataFrame, key: str = "content_hash", order: str = "path") -> DataFrame:
    """files with a column first: of the rows with one hash only the first by `order`, which no two rows share, counts; rows without a
    hash always do."""
    # a minimum meets partial minima before the exchange, and the join that brings it back may be split where a hash is hot
    least = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_least"))
    return files.join(least, key, "left").withColumn("first", F.col(key).isNull() | (F.col(order) == F.col("_least"))).select(*files.columns, "first")


def refresh_catalog(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Every known path again: changed ones are Modified (the hash stays), vanished ones Deleted."""
    now = listing.select("path", F.col("size").alias("n_size"), F.col("last_modified").alias("n_time"))
    both = catalog.join(now, "path", "left")
    changed = (F.col("n_size") != F.col("size")) | (F.col("n_time") != F.col("last_modified"))
    return both.select(
        "id", "path",
        F.coalesce("n_size", "size").alias("size"), F.coalesce("n_time", "last_modified").alias("last_modified"), "content_hash",
        F.when(F.col("n_size").isNull(), "Deleted").when(changed, "Modified").otherwise(F.col("status")).alias("status"),
    )


def plan_unprocessed(catalog: DataFrame) -> DataFrame:
    """New and Modified files with an action: process, or mark where a processed file has the same content (hash and size)."""
    done = catalog.where("status = 'Processed' and content_hash is not null").select("content_hash", "size").distinct().withColumn("_done", F.lit(True))
    todo = catalog.where(F.col("status").isin("New", "Modified"))
    return todo.join(done, ["content_hash", "size"], "left").select("id", "path", F.when(F.col("_done"), "mark").otherwise("process").alias("action"))


def plan_selected(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, save_attachments) with what is to be done: process, backfill attachments, or skip; unknown ids drop out."""
    joined = catalog.join(requests, "id")
    return joined.select("id", F.when(F.col("status") != "Processed", "process").when(F.col("save_attachments") & ~F.col("attachments_saved"), "backfill").otherwise("skip").alias("action"))


def plan_attachment_backfill(catalog: DataFrame, mails: DataFrame, attachments: DataFrame) -> DataFrame:
    """Mails of processed files whose attachments are not saved, that have attachments but no stored one."""
    files = catalog.where("status = 'Processed' and not attachments_saved").select("pst_file").distinct()
    owing = attachments.groupBy("email_id").agg(F.count(F.lit(1)).alias("n"), F.count("hash").alias("stored")).where("stored = 0").select(F.col("email_id").alias("id"))
    return mails.join(files, "pst_file", "left_semi").join(owing, "id", "left_semi")


def union_scans(*scans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, scans)


def missing_paths(catalog: DataFrame, scan: DataFrame, roots: list[str]) -> DataFrame:
    """Catalogue paths below the roots that the scan has not found."""
    return catalog.where(under(F.col("path"), roots)).select("path").join(scan.select("path"), "path", "left_anti")


def known_paths(catalog: DataFrame, scan: DataFrame) -> DataFrame:
    return scan.select("path").join(catalog.select("path"), "path", "left_semi").distinct()


def distinct_sets(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def duplicate_files(catalog: DataFrame) -> DataFrame:
    """Groups of files with equal hash and size, above 0 bytes, largest files first."""
    groups = catalog.where("content_hash is not null and size > 0").groupBy("content_hash", "size").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return groups.where("n > 1").orderBy(F.desc("size"), "content_hash")


def duplicate_members(catalog: DataFrame) -> DataFrame:
    """(content_hash, size, id, n, first): a row for each file of duplicate_files' groups, the smallest id of a group marked. The
    groups come from partial counts; the join that brings them back may be split where a hash is hot."""
    files = catalog.where("content_hash is not null and size > 0").select("content_hash", "size", "id")
    groups = files.groupBy("content_hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_least")).where("n > 1")
    return files.join(groups, ["content_hash", "size"]).select("content_hash", "size", "id", "n", (F.col("id") == F.col("_least")).alias("first"))


def dedupe_files(catalog: DataFrame) -> DataFrame:
    """One row for each hash and size, a processed one first; files without a hash stay."""
    w = Window.partitionBy("content_hash", "size").orderBy((F.col("status") == "Processed").desc(), "id")
    kept = catalog.where("content_hash is not null").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return kept.unionByName(catalog.where("content_hash is null"))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("New", "Modified")).alias("pending"), F.count_if(F.col("status") == "Processed").alias("processed"))


def status_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def wasted_bytes(catalog: DataFrame) -> DataFrame:
    """Number of duplicate groups, and the bytes of all members but the first."""
    groups = catalog.where("content_hash is not null and size > 0").groupBy("content_hash", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).cast("long").alias("wasted"))


def size_totals(catalog: DataFrame, visible: Column) -> DataFrame:
    """Gigabytes of all and of the visible files."""
    gb = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / F.lit(GB), 6)
    return catalog.agg(gb(F.col("size")).alias("total_gb"), gb(F.when(visible, F.col("size"))).alias("visible_gb"))


def duplicate_groups_by_hash_or_name(files: DataFrame) -> DataFrame:
    """Groups by hash, or by name and size where there is no hash."""
    key = F.coalesce(F.col("content_hash"), F.concat(F.col("file_name"), F.lit("|"), F.col("size").cast("string")))
    return files.groupBy(key.alias("group_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")


def nas_save_result(catalog: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts of a batch of found files (path, content_hash): found, saved, duplicates. A new path is a duplicate if its hash is
    in the catalogue or earlier in the batch."""
    new = hits.join(catalog.select("path"), "path", "left_anti")
    known = catalog.where("content_hash is not null").select("content_hash").distinct().withColumn("_known", F.lit(True))
    judged = first_in_batch(new, "content_hash", "path").join(known, "content_hash", "left").withColumn("dup", F.col("_known").isNotNull() | ~F.col("first"))
    counts = judged.agg(F.count_if(~F.col("dup")).alias("saved"), F.count_if("dup").alias("duplicates"))
    return hits.agg(F.count(F.lit(1)).alias("found")).join(F.broadcast(counts))  # two rows of counts


def filter_catalog(catalog: DataFrame, q=None, status=None, name=None, sort_by="file_name", descending=False, limit=None) -> DataFrame:
    """Rows that match a free text over name, path and status, an exact status and a part of the name."""
    out = catalog
    if q:
        out = out.where(contains(F.col("file_name"), q) | contains(F.col("path"), q) | contains(F.col("status"), q))
    if status:
        out = out.where(F.col("status") == status)
    if name:
        out = out.where(contains(F.col("file_name"), name))
    return sort_allowed(out, sort_by, descending, limit, allowed=("file_name", "path", "size", "last_modified", "status"), default="file_name")


def files_by_status(catalog: DataFrame, statuses: list[str], unsaved_only: bool = False) -> DataFrame:
    out = catalog.where(F.col("status").isin(statuses))
    return out.where(~F.col("attachments_saved")) if unsaved_only else out


def classify_file_error(message: Column, archive_error: Column, status: Column) -> Column:
    """Status after a failure: Missing where the file cannot be read, Invalid where the archive is broken, else unchanged."""
    return F.when(message.contains("does not exist") | message.contains("cannot be read"), "Missing").when(archive_error | message.contains("Invalid"), "Invalid").otherwise(status)


def fill_missing_hashes(catalog: DataFrame, hashed: DataFrame) -> DataFrame:
    """Catalogue rows without a hash take that of their path in hashed (path, new_hash), which holds files that still exist."""
    return catalog.join(hashed, "path", "left").withColumn("content_hash", F.coalesce("content_hash", "new_hash")).drop("new_hash")
