"""Metadata of mails: projection, search, access and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import text as X

SORT_FIELDS = ("received", "subject", "sender_name", "sender_address", "pst_file", "folder_path")


def contains(c: Column, part: str) -> Column:
    """Literal, case-insensitive containment; null does not contain anything."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def any_contains(array: Column, part: str) -> Column:
    return F.coalesce(F.exists(array, lambda a: F.contains(F.lower(a), F.lit(part.lower()))), F.lit(False))


def map_message_metadata(messages: DataFrame) -> DataFrame:
    """Raw messages as mails: addresses split and trimmed, message key, source owner."""
    return messages.select(
        "id", "seq", "unique_entry_id", "pst_file", "folder_path", "message_class", "sender_address", "sender_name", "subject", "received", "body",
        X.split_addresses(F.col("display_to")).alias("recipients"),
        X.split_addresses(F.col("display_cc")).alias("cc"),
        "message_id", "conversation_id", "is_read",
        X.normalize_message_id(F.col("message_id"), F.col("unique_entry_id"), F.col("id")).alias("message_key"),
        X.source_owner(F.col("pst_file")).alias("owner"),
        X.address_key(F.col("sender_address")).alias("sender_key"),
    )


def supported_message(messages: DataFrame) -> DataFrame:
    """Messages whose class starts with IPM.Note."""
    return messages.where(F.col("message_class").startswith("IPM.Note"))


def any_field_contains(part: str) -> Column:
    """Free text over the fields of a mail, recipients included."""
    fields = ["subject", "body", "sender_name", "sender_address", "pst_file", "folder_path"]
    return reduce(Column.__or__, [contains(F.col(f), part) for f in fields]) | any_contains(F.col("recipients"), part)


def recipient_contains(part: str) -> Column:
    return any_contains(F.col("recipients"), part)


def sort_allowed(df: DataFrame, field: str, descending: bool, limit: int | None, allowed=SORT_FIELDS, default: str = "received", key: str = "id") -> DataFrame:
    """Ordered by a field of the list (else the default), ties by the key, and cut after `limit` rows."""
    field = field if field in allowed else default
    order = F.col(field).desc_nulls_last() if descending else F.col(field).asc_nulls_first()
    out = df.orderBy(order, key)
    return out if limit is None else out.limit(limit)


def search_emails(mails: DataFrame, q=None, subject=None, sender=None, recipient=None, pst_file=None, folder=None, importance=None, is_read=None, first=None, last=None, sort_by="received", descending=True, limit=100) -> DataFrame:
    """Mails that meet all given criteria; those not given do not count."""
    tests = []
    if q:
        tests.append(any_field_contains(q))
    if subject:
        tests.append(contains(F.col("subject"), subject))
    if sender:
        tests.append(contains(F.col("sender_name"), sender) | contains(F.col("sender_address"), sender))
    if recipient:
        tests.append(recipient_contains(recipient))
    if pst_file:
        tests.append(contains(F.col("pst_file"), pst_file))
    if folder:
        tests.append(contains(F.col("folder_path"), folder))
    if importance is not None and "importance" in mails.columns:
        tests.append(F.col("importance") == importance)
    if is_read is not None:
        tests.append(F.col("is_read") == F.lit(is_read))
    if first or last:
        tests.append(X.in_days(F.col("received"), first, last))
    found = reduce(DataFrame.where, tests, mails)
    return sort_allowed(found, sort_by, descending, limit)


def latest(df: DataFrame, by: str, limit: int = 1000, key: str = "id") -> DataFrame:
    """The newest rows."""
    return df.orderBy(F.col(by).desc_nulls_last(), key).limit(limit)


def sort_locale(df: DataFrame, column: str, locale: str = "hu", key: str = "id") -> DataFrame:
    """Ordered by a text column under the rules of a language; null as empty."""
    return df.orderBy(F.collate(F.coalesce(F.col(column), F.lit("")), locale), key)


def page(df: DataFrame, order: list, number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 0) of a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int = 50) -> DataFrame:
    """The page behind the row with the values `after` of the order's columns, or the first. order: (column, rising), the last of
    them unique; null comes first when rising and last when falling. The bound on the first column is a predicate of its own, so
    it reaches the scan, and a deep page costs no more than the first."""
    columns = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (c, up), v in zip(order, after, strict=True):
            col, v = F.col(c), F.lit(v)
            later = (col.isNotNull() & v.isNull()) | (col > v) if up else v.isNotNull() & (col.isNull() | (col < v))
            beyond, same = beyond | (same & F.coalesce(later, F.lit(False))), same & col.eqNullSafe(v)
        (first, up), bound = order[0], after[0]
        lead = F.lit(True) if up and bound is None else F.col(first) >= F.lit(bound) if up else F.col(first).isNull() if bound is None else F.col(first).isNull() | (F.col(first) <= F.lit(bound))
        df = df.where(lead).where(beyond)
    return df.orderBy(*columns).limit(size)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a user has chosen and that exist, in their order."""
    return df.select(*[c for c in columns if c in df.columns])


def upsert_emails(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Stored and loaded mails by unique_entry_id: of a known mail only the folder may change, a new one is inserted. One loaded
    row counts for each id, the one with the largest seq."""
    fresh = latest_by(loaded, "unique_entry_id", "seq")
    moved = fresh.select("unique_entry_id", F.col("folder_path").alias("_folder"))
    known = stored.join(moved, "unique_entry_id", "left").withColumn("folder_path", F.coalesce("_folder", "folder_path")).drop("_folder")
    new = fresh.join(stored.select("unique_entry_id"), "unique_entry_id", "left_anti")
    return known.unionByName(new.select(*known.columns))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last by `order`; the ranking is cut before the exchange."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that came first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def email_count(mails: DataFrame) -> DataFrame:
    return mails.agg(F.count(F.lit(1)).alias("n"))
