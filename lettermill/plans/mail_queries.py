"""Queries over mails: metadata search, access, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators import access, attach, mail, ops
from lettermill.plans.registry import query
from lettermill.sources.fixtures import duckdb, table


def mails(spark, sf):
    return mail.map_message_metadata(table(spark, sf, "emails"))


RECIPIENTS = "list_filter(list_transform(string_split(display_to,';'), lambda x: trim(x)), lambda x: x<>'')"
KEY = "coalesce(nullif(regexp_replace(lower(trim(message_id)),'[<>\\s]','','g'),''), unique_entry_id, id)"
TRIM_BODY = "regexp_replace(body,'^\\s+|\\s+$','','g')"
ALL = f"m as (select *, {RECIPIENTS} as recipients, {KEY} as message_key, coalesce(regexp_replace(pst_file,'^(.+)\\.[^.]*$','\\1'),'') as owner, lower(trim(sender_address)) as sender_key from emails)"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def m_sql(body: str, *names: str, more: str = "") -> str:
    return duckdb(body, "emails", *names, more=ALL + (", " + more if more else ""))


@query("p1_map_message_metadata", m_sql("select id, message_key, owner, sender_key, array_to_string(recipients,'|') as recipients, is_read, conversation_id from m"))
def p1(spark, sf):
    return mails(spark, sf).select("id", "message_key", "owner", "sender_key", F.array_join("recipients", "|").alias("recipients"), "is_read", "conversation_id")


@query("p2_supported_message", m_sql("select id from m where starts_with(message_class,'IPM.Note')"))
def p2(spark, sf):
    return mail.supported_message(mails(spark, sf)).select("id")


@query(
    "p3_search_emails",
    m_sql("select id, subject, sender_name from m where contains(lower(subject),'th') and (contains(lower(sender_name),'user 1') or contains(lower(sender_address),'user 1')) and contains(lower(pst_file),'src') and contains(lower(folder_path),'inbox') and is_read and received >= date '2024-01-02' and received < date '2024-01-29' order by subject desc, id limit 100"),
)
def p3(spark, sf):
    found = mail.search_emails(mails(spark, sf), subject="th", sender="user 1", pst_file="src", folder="INBOX", is_read=True, first="2024-01-02", last="2024-01-28", sort_by="subject", descending=True)
    return found.select("id", "subject", "sender_name")


ANY = " or ".join(f"contains(lower({c}),'user1')" for c in ("subject", "body", "sender_name", "sender_address", "pst_file", "folder_path"))


@query("p4_any_field_contains", m_sql(f"select id from m where {ANY} or len(list_filter(recipients, lambda x: contains(lower(x),'user1')))>0"))
def p4(spark, sf):
    return mails(spark, sf).where(mail.any_field_contains("User1")).select("id")


@query("p5_recipient_contains", m_sql("select id from m where len(list_filter(recipients, lambda x: contains(lower(x),'@org3')))>0"))
def p5(spark, sf):
    return mails(spark, sf).where(mail.recipient_contains("@ORG3")).select("id")


CONTEXT = "c as (select a.*, m.subject as email_subject, m.sender_name, m.received, m.pst_file from attachments a left join m on a.email_id = m.id)"


@query("p6_search_attachments", m_sql("select id, filename, size from c where contains(lower(filename),'widget') and ends_with(lower(filename),'.xlsx') and size between 5000 and 40000 and contains(lower(email_subject),'a') order by size desc, id limit 1000", "attachments", more=CONTEXT))
def p6(spark, sf):
    a = attach.with_email_context(table(spark, sf, "attachments"), mails(spark, sf))
    return attach.search_attachments(a, filename="Widget", extension="xlsx", min_size=5000, max_size=40000, subject="A", sort_by="size").select("id", "filename", "size")


@query("p7_query_logs", duckdb("select seq, level, message from log_entries where level='ERROR' and ts >= timestamp '2024-01-03 00:00:00' and ts <= timestamp '2024-01-20 12:00:00' order by ts desc, seq limit 300", "log_entries"))
def p7(spark, sf):
    return ops.query_logs(table(spark, sf, "log_entries"), "ERROR", "2024-01-03 00:00:00", "2024-01-20 12:00:00").select("seq", "level", "message")


@query("s12_read_log_table", duckdb("select level, count(*) as n from log_entries group by level", "log_entries"))
def s12(spark, sf):
    return table(spark, sf, "log_entries").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def access_sql(user: str) -> str:
    free = f"exists(select 1 from user_access where username='{user}' and is_admin) or not exists(select 1 from allowed_files where username='{user}')"
    return m_sql(f"select id from m where {free} or pst_file in (select f.pst_file from allowed_files a join file_catalog f on a.file_id=f.id where a.username='{user}')", "user_access", "allowed_files", "file_catalog")


def access_query(user: str):
    def run(spark, sf):
        users, allowed, files = (table(spark, sf, n) for n in ("user_access", "allowed_files", "file_catalog"))
        return access.apply_file_access(mails(spark, sf), users, allowed, files, user).select("id")

    return run


for _name, _user in (("p9_apply_file_access", "Customer#000000001"), ("p9_apply_file_access_admin", "Customer#000000010"), ("p9_apply_file_access_no_list", "Customer#000000007"), ("p9_apply_file_access_unknown", "nobody")):
    query(_name, access_sql(_user))(access_query(_user))


@query("p10_project_columns", m_sql("select subject, sender_name from m"))
def p10(spark, sf):
    return mail.project_columns(mails(spark, sf), ["subject", "not_there", "sender_name"])


@query("p12_filter_failures", duckdb("select id, email_id from failed_conversions where failure_type='ATTACHMENT_CONVERT' and not resolved", "failed_conversions"))
def p12(spark, sf):
    return ops.filter_failures(table(spark, sf, "failed_conversions"), "ATTACHMENT_CONVERT", False).select("id", "email_id")


@query("p16_email_by_id", m_sql("select id, subject from m where id='e7'"))
def p16(spark, sf):
    return mail.by_key(mails(spark, sf), "id", "e7").select("id", "subject")


@query("p16_by_key", m_sql("select id from m where sender_key='user7@org0.example'"))
def p16b(spark, sf):
    return mail.by_key(mails(spark, sf), "sender_key", "user7@org0.example").select("id")


@query("a7_email_count", m_sql("select count(*) as n from m where pst_file in (select f.pst_file from allowed_files a join file_catalog f on a.file_id=f.id where a.username='Customer#000000001')", "allowed_files", "file_catalog"))
def a7(spark, sf):
    users, allowed, files = (table(spark, sf, n) for n in ("user_access", "allowed_files", "file_catalog"))
    return mail.email_count(access.apply_file_access(mails(spark, sf), users, allowed, files, "Customer#000000001"))


@query("a7_attachment_count", duckdb("select count(*) as n from attachments", "attachments"))
def a7b(spark, sf):
    return mail.email_count(table(spark, sf, "attachments"))


@query("j28_allowed_files_of_user", duckdb("select a.username, f.id as file_id, f.path from allowed_files a join file_catalog f on a.file_id=f.id", "allowed_files", "file_catalog"))
def j28(spark, sf):
    out = access.allowed_files_of_user(table(spark, sf, "allowed_files"), table(spark, sf, "file_catalog"))
    return out.select("username", F.col("id").alias("file_id"), "path")


UPSERT = "stored as (select * from m where seq % 3 <> 0), loaded as (select * replace (concat(folder_path,' / moved') as folder_path) from m where seq % 2 = 0)"


@query("j4_upsert_emails", m_sql("select s.id, coalesce(l.folder_path, s.folder_path) as folder_path from stored s left join loaded l using(unique_entry_id) union all select id, folder_path from loaded where unique_entry_id not in (select unique_entry_id from stored)", more=UPSERT))
def j4(spark, sf):
    m = mails(spark, sf)
    loaded = m.where("seq % 2 = 0").withColumn("folder_path", F.concat("folder_path", F.lit(" / moved")))
    return mail.upsert_emails(m.where("seq % 3 <> 0"), loaded).select("id", "folder_path")


@query("w1_latest_per_message", m_sql("select message_key, id from m qualify row_number() over(partition by message_key order by seq desc)=1"))
def w1(spark, sf):
    return mail.latest_by(mails(spark, sf), "message_key", "seq").select("message_key", "id")


@query("w2_first_seen", m_sql("select sender_key, id from m qualify row_number() over(partition by sender_key order by received, id)=1"))
def w2(spark, sf):
    return mail.first_by(mails(spark, sf), "sender_key", "received", "id").select("sender_key", "id")


@query("t1_sort_allowed", m_sql("select id, subject from m order by subject, id limit 200"))
def t1(spark, sf):
    return mail.sort_allowed(mails(spark, sf), "subject", False, 200).select("id", "subject")


@query("t2_latest_emails", m_sql(f"select id, {TS.format('received')} as received from m order by m.received desc, id limit 1000"))
def t2(spark, sf):
    return mail.latest(mails(spark, sf), "received").select("id", ts("received").alias("received"))


@query("t2_latest_attachments", duckdb("select id from attachments order by created desc, id limit 1000", "attachments"))
def t2b(spark, sf):
    return mail.latest(table(spark, sf, "attachments"), "created").select("id")


@query("t3_sort_locale")
def t3(spark, sf):
    return mail.sort_locale(mails(spark, sf), "subject").select("id", "subject")


@query("t4_page", m_sql("select id from m order by received, id limit 50 offset 100"))
def t4(spark, sf):
    return mail.page(mails(spark, sf), ["received", "id"], 2).select("id")


@query("t4_page_after", m_sql("select id from m order by owner desc nulls last, received nulls first, id limit 50 offset 50"))
def t4b(spark, sf):
    """The second page by the last row of the first."""
    order = [("owner", False), ("received", True), ("id", True)]
    last = mail.page_after(mails(spark, sf), order, None).select(*[c for c, _ in order]).collect()[-1:]  # a page
    return mail.page_after(mails(spark, sf), order, tuple(last[0]) if last else None).select("id")


@query("a19_failed_email_ids", duckdb("select distinct email_id from failed_conversions where not resolved", "failed_conversions"))
def a19(spark, sf):
    return ops.failed_email_ids(table(spark, sf, "failed_conversions"))


@query("j27_retry_failures", duckdb("select id, email_id, failure_type, resolved or failure_type='REPLY_STRIP' as resolved, case when resolved or failure_type='REPLY_STRIP' then retry_count else retry_count+1 end as retry_count from failed_conversions", "failed_conversions"))
def j27(spark, sf):
    f = table(spark, sf, "failed_conversions")
    return ops.retry_failures(f, f.where("failure_type = 'REPLY_STRIP'"))


# ---- attachments


@query(
    "a1_attachment_duplicate_stats",
    duckdb(
        "select count(*) as total, count(distinct hash) as unique_hashes, (select cast(coalesce(sum(n-1),0) as bigint) from (select count(*) n from attachments where hash is not null group by email_id, hash)) as copies_within_mail, (select count(*) from (select hash from attachments where hash is not null group by hash having count(distinct email_id)>1)) as shared_hashes from attachments",
        "attachments",
    ),
)
def a1(spark, sf):
    return attach.attachment_duplicate_stats(table(spark, sf, "attachments"))


GROUPS = "g as (select hash, min(id) as id, arg_min(filename,id) as filename, array_to_string(list_sort(list(distinct email_id)),',') as email_ids from attachments where hash is not null group by hash)"


@query("a2_group_by_content", duckdb("select * from g", "attachments", more=GROUPS))
def a2(spark, sf):
    return attach.group_by_content(table(spark, sf, "attachments")).withColumn("email_ids", F.array_join("email_ids", ","))


@query("a2_content_members", duckdb("select distinct hash, email_id from attachments where hash is not null", "attachments"))
def a2b(spark, sf):
    return attach.content_members(table(spark, sf, "attachments"))


@query("a2_content_representatives", duckdb("select hash, min(id) as id, arg_min(filename, id) as filename, count(distinct email_id) as n_mails from attachments where hash is not null group by hash", "attachments"))
def a2c(spark, sf):
    return attach.content_representatives(table(spark, sf, "attachments"))


@query("a3_dedupe_attachments", duckdb("select id from attachments where hash is null union all (select id from attachments where hash is not null qualify row_number() over(partition by email_id, hash order by id)=1)", "attachments"))
def a3(spark, sf):
    return attach.dedupe_attachments(table(spark, sf, "attachments")).select("id")


@query("j7_new_attachments_only", duckdb("select hash, id from g where hash not in (select hash from attachments where hash is not null and part_key % 2 = 0)", "attachments", more=GROUPS))
def j7(spark, sf):
    a = table(spark, sf, "attachments")
    return attach.new_attachments_only(attach.group_by_content(a), a.where("part_key % 2 = 0 and hash is not null")).select("hash", "id")


@query("j9_attachments_of_email", m_sql("select a.id from attachments a where a.email_id in (select id from m where not is_read)", "attachments"))
def j9(spark, sf):
    return attach.attachments_of_emails(table(spark, sf, "attachments"), mails(spark, sf).where("not is_read")).select("id")


@query("j10_with_email_context", m_sql(f"select id, email_subject, sender_name, {TS.format('received')} as received from c", "attachments", more=CONTEXT))
def j10(spark, sf):
    return attach.with_email_context(table(spark, sf, "attachments"), mails(spark, sf)).select("id", "email_subject", "sender_name", ts("received").alias("received"))


def contents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content"), F.concat("doc_id", F.lit(".txt")).alias("filename"))


@query("s7_store_blobs", "select sha256(text) as hash, cast(max(octet_length(encode(text))) as int) as bytes from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 4 = 0) group by 1")
def s7(spark, sf):
    c = contents(spark, sf)
    stored = c.where("cast(id as bigint) % 4 = 0").select(X.content_hash(F.col("content")).alias("hash"))
    return attach.store_blobs(c, stored).select("hash", F.octet_length("content").alias("bytes"))


@query(
    "d2_convert_documents",
    "select sha256(text) as hash, any_value(array_to_string(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>''),' ')) as markdown, cast(null as varchar) as error from documents group by 1",
)
def d2(spark, sf):
    return attach.convert_documents(contents(spark, sf).withColumn("hash", X.content_hash(F.col("content"))))


def document_attachments(spark, sf):
    return contents(spark, sf).select("id", F.concat(F.lit("e"), "id").alias("email_id"), X.content_hash(F.col("content")).alias("hash"), "filename", "content")


@query(
    "s9_write_attachment_index",
    "select sha256(text) as hash, arg_min(concat(doc_id,'.txt'), cast(doc_id as varchar)) as filename, array_to_string(list_sort(list(distinct concat('e',doc_id))),',') as email_ids, any_value(array_to_string(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>''),' ')) as markdown from documents group by 1",
)
def s9(spark, sf):
    a = document_attachments(spark, sf)
    index, _ = attach.process_attachments(a, spark.createDataFrame([], "hash string"), a.groupBy("hash").agg(F.first("content").alias("content")))
    return index.withColumn("email_ids", F.array_join("email_ids", ","))


@query(
    "d6_process_attachments",
    """select hash, filename, 'ATTACHMENT_CONVERT' as failure_type, 'ValueError: odd file' as error from
        (select sha256(text) as hash, arg_min(concat(doc_id,'.txt'), cast(doc_id as varchar)) as filename from documents group by 1) where cast(split_part(filename,'.',1) as bigint) % 2 = 1""",
)
def d6(spark, sf):
    a = document_attachments(spark, sf)

    def picky(name, content):
        if int(name.split(".")[0]) % 2:
            raise ValueError("odd file")
        return attach.plain_converter(name, content)

    _, failed = attach.process_attachments(a, spark.createDataFrame([], "hash string"), a.groupBy("hash").agg(F.first("content").alias("content")), picky)
    return failed
