"""Queries over catalogues of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.operators import catalog as C
from lettermill.plans.mail_queries import TS, mails, ts
from lettermill.plans.registry import query
from lettermill.sources.fixtures import duckdb, table
from lettermill.sources import files as files_
from lettermill.sources.files import ingest_nas_hits
from lettermill.sources.stored import fresh_path

ROOTS = ["/mnt/nas"]


def files(spark, sf):
    return table(spark, sf, "file_catalog")


def sql(body: str, more: str = "", *names: str) -> str:
    return duckdb(body, "file_catalog", *names, more=more)


PATH = "case when starts_with(nas_path,'/volume1/shared') then concat('/mnt/nas',substr(nas_path,16)) else concat('/mnt/nas',nas_path) end"
HITS = f"h as (select seq, {PATH} as path, name as file_name, coalesce(size,0) as size, coalesce(nullif(modified,0), nullif(content_modified,0), 1800000000) as modified_s, 'New' as status, content_hash from nas_hits where nas_path<>'' and name<>'')"


@query("s4_ingest_nas_hits", duckdb("select path, file_name, size, cast(modified_s as bigint) as modified_s, status from h", "nas_hits", more=HITS))
def s4(spark, sf):
    return ingest_nas_hits(table(spark, sf, "nas_hits"), "/volume1/shared", "/mnt/nas", F.lit(1800000000))


MERGED = """b as (select coalesce(c.path, s.path) as path, c.status as c_status, c.size as c_size, c.content_hash as c_hash, s.path is not null as found, s.size as s_size, s.content_hash as s_hash,
  c.size <> s.size or c.last_modified <> s.last_modified or c.status = 'Deleted' as changed from file_catalog c full outer join file_scan s on c.path = s.path),
 known as (select path, case when found then s_size else c_size end as size, case when found and changed then s_hash else c_hash end as content_hash,
  case when found and changed then 'Modified' when not found then 'Deleted' else c_status end as status from b where c_status is not null),
 fresh as (select path, s_size as size, s_hash as content_hash from b where c_status is null qualify s_hash is null or row_number() over(partition by s_hash order by path)=1)"""


@query("j1_merge_file_catalog", sql("select path, size, content_hash, status from known union all select path, size, content_hash, 'New' from fresh where content_hash is null or content_hash not in (select content_hash from known where content_hash is not null and status<>'Deleted')", MERGED, "file_scan"))
def j1(spark, sf):
    return C.merge_file_catalog(files(spark, sf), table(spark, sf, "file_scan"), ROOTS).select("path", "size", "content_hash", "status")


@query("j2_refresh_catalog", sql("select c.id, c.path, coalesce(s.size,c.size) as size, c.content_hash, case when s.path is null then 'Deleted' when s.size<>c.size or s.last_modified<>c.last_modified then 'Modified' else c.status end as status from file_catalog c left join file_scan s on c.path=s.path", "", "file_scan"))
def j2(spark, sf):
    return C.refresh_catalog(files(spark, sf), table(spark, sf, "file_scan")).select("id", "path", "size", "content_hash", "status")


@query("j3_plan_unprocessed", sql("select id, path, case when exists(select 1 from file_catalog p where p.status='Processed' and p.content_hash=c.content_hash and p.size=c.size) then 'mark' else 'process' end as action from file_catalog c where status in ('New','Modified')"))
def j3(spark, sf):
    return C.plan_unprocessed(files(spark, sf))


@query("j5_plan_attachment_backfill", duckdb("select id from emails where pst_file in (select pst_file from file_catalog where status='Processed' and not attachments_saved) and id in (select email_id from attachments group by email_id having count(case when size > 30000 then hash end)=0)", "emails", "file_catalog", "attachments"))
def j5(spark, sf):
    return C.plan_attachment_backfill(files(spark, sf), mails(spark, sf), table(spark, sf, "attachments").withColumn("hash", F.when(F.col("size") > 30000, F.col("hash")))).select("id")


@query("j6_plan_selected", sql("select id, case when status<>'Processed' then 'process' when seq%3=0 and not attachments_saved then 'backfill' else 'skip' end as action from file_catalog"))
def j6(spark, sf):
    f = files(spark, sf)
    requests = f.select("id", (F.col("seq") % 3 == 0).alias("save_attachments")).unionByName(spark.createDataFrame([("gone", True)], "id string, save_attachments boolean"))
    return C.plan_selected(f, requests)


@query("u1_union_scans", sql("select path, size from file_scan union all select path, size from file_catalog", "", "file_scan"))
def u1(spark, sf):
    return C.union_scans(table(spark, sf, "file_scan").select("path", "size"), files(spark, sf).select("path", "size"))


@query("u2_missing_paths", sql("select path from file_catalog where path not in (select path from file_scan)", "", "file_scan"))
def u2(spark, sf):
    return C.missing_paths(files(spark, sf), table(spark, sf, "file_scan"), ROOTS)


@query("u3_known_paths", sql("select distinct path from file_scan where path in (select path from file_catalog)", "", "file_scan"))
def u3(spark, sf):
    return C.known_paths(files(spark, sf), table(spark, sf, "file_scan"))


@query("u4_distinct_sets", sql("select distinct pst_file from file_catalog where pst_file is not null"))
def u4(spark, sf):
    return C.distinct_sets(files(spark, sf), "pst_file")


@query("a4_duplicate_files", sql("select content_hash, size, count(*) as n, array_to_string(list_sort(list(id)),',') as ids from file_catalog where content_hash is not null and size>0 group by 1,2 having count(*)>1 order by size desc, content_hash"))
def a4(spark, sf):
    return C.duplicate_files(files(spark, sf))


@query("a4_duplicate_members", sql("select content_hash, size, id, count(*) over g as n, id = min(id) over g as first from file_catalog where content_hash is not null and size>0 window g as (partition by content_hash, size) qualify count(*) over g > 1"))
def a4b(spark, sf):
    return C.duplicate_members(files(spark, sf))


@query("a5_dedupe_files", sql("select id from file_catalog where content_hash is null union all (select id from file_catalog where content_hash is not null qualify row_number() over(partition by content_hash, size order by status='Processed' desc, id)=1)"))
def a5(spark, sf):
    return C.dedupe_files(files(spark, sf)).select("id")


@query("a6_catalog_counts", sql("select count(*) as total, count(*) filter(status in ('New','Modified')) as pending, count(*) filter(status='Processed') as processed from file_catalog"))
def a6(spark, sf):
    return C.catalog_counts(files(spark, sf))


@query("a8_status_histogram", sql("select status, count(*) as n from file_catalog group by status"))
def a8(spark, sf):
    return C.status_histogram(files(spark, sf))


@query("a9_wasted_bytes", sql("select count(*) as groups, cast(coalesce(sum(size*(n-1)),0) as bigint) as wasted from (select size, count(*) n from file_catalog where content_hash is not null and size>0 group by content_hash, size having count(*)>1)"))
def a9(spark, sf):
    return C.wasted_bytes(files(spark, sf))


@query("a10_size_totals", sql("select round(sum(size)/1073741824.0::double,6) as total_gb, round(sum(case when status='New' then size end)/1073741824.0::double,6) as visible_gb from file_catalog"))
def a10(spark, sf):
    return C.size_totals(files(spark, sf), F.col("status") == "New")


@query("a11_duplicate_groups_by_hash_or_name", sql("select coalesce(content_hash, concat(file_name,'|',size)) as group_key, count(*) as n, cast(sum(size) as bigint) as bytes from file_catalog group by 1 having count(*)>1"))
def a11(spark, sf):
    return C.duplicate_groups_by_hash_or_name(files(spark, sf))


NAS = "n as (select *, content_hash is not null and row_number() over(partition by content_hash order by path)>1 as again from (select path, content_hash from h where path not in (select path from file_catalog)))"


@query("a20_nas_save_result", sql("select (select count(*) from h) as found, count(*) filter(not (again or coalesce(content_hash in (select content_hash from file_catalog where content_hash is not null),false))) as saved, count(*) filter(again or coalesce(content_hash in (select content_hash from file_catalog where content_hash is not null),false)) as duplicates from n", HITS + ", " + NAS, "nas_hits"))
def a20(spark, sf):
    hits = table(spark, sf, "nas_hits")
    kept = ingest_nas_hits(hits, "/volume1/shared", "/mnt/nas", F.lit(0)).select("path", "file_name")
    hashes = hits.select(F.col("name").alias("file_name"), "content_hash", "nas_path").where("nas_path <> ''").drop("nas_path")
    return C.nas_save_result(files(spark, sf), kept.join(hashes, "file_name").select("path", "content_hash"))


@query("w7_first_in_batch", sql("select path, content_hash is null or row_number() over(partition by content_hash order by path)=1 as first from file_scan", "", "file_scan"))
def w7(spark, sf):
    return C.first_in_batch(table(spark, sf, "file_scan")).select("path", "first")


@query("p8_filter_catalog", sql("select id, file_name, size from file_catalog where (contains(lower(file_name),'src1') or contains(lower(path),'src1') or contains(lower(status),'src1')) and status='Processed' and contains(lower(file_name),'1') order by size desc, id"))
def p8(spark, sf):
    return C.filter_catalog(files(spark, sf), q="SRC1", status="Processed", name="1", sort_by="size", descending=True).select("id", "file_name", "size")


@query("p14_files_by_status", sql("select id from file_catalog where status in ('Processed','Invalid') and not attachments_saved"))
def p14(spark, sf):
    return C.files_by_status(files(spark, sf), ["Processed", "Invalid"], True).select("id")


@query("p15_classify_file_error", sql("select id, case seq%4 when 0 then 'Missing' when 1 then 'Missing' when 2 then 'Invalid' else status end as status from file_catalog"))
def p15(spark, sf):
    k = F.col("seq") % 4
    message = F.when(k == 0, "File does not exist").when(k == 1, "File cannot be read").when(k == 2, "Invalid header").otherwise("timeout")
    return files(spark, sf).select("id", C.classify_file_error(message, F.lit(False), F.col("status")).alias("status"))


@query("j29_fill_missing_hashes", sql("select id, coalesce(content_hash, case when seq%2=0 then sha256(path) end) as content_hash from file_catalog"))
def j29(spark, sf):
    f = files(spark, sf)
    return C.fill_missing_hashes(f, f.where("seq % 2 = 0").select("path", F.sha2("path", 256).alias("new_hash"))).select("id", "content_hash")


@query("file_catalog_newest", sql(f"select id, {TS.format('last_modified')} as last_modified from file_catalog order by file_catalog.last_modified desc, id limit 1000"))
def newest(spark, sf):
    return files(spark, sf).orderBy(F.desc("last_modified"), "id").limit(1000).select("id", ts("last_modified").alias("last_modified"))


# ---- files: the documents' texts, written as a file for each source and language, then listed and read

FILES = "f as (select source, lang, cast(sum(octet_length(encode(coalesce(text,'')))+1) as bigint) as size from documents group by 1,2)"


def written_files(spark, sf) -> str:
    root = fresh_path(spark, "files")
    texts = table(spark, sf, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition("source", "lang").write.partitionBy("source", "lang").text(root)
    return root


def _named(found):
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return found.groupBy(part("source"), part("lang")).agg(F.sum("size").alias("size"))


@query("s1_scan_mail_files", duckdb("select source, lang, size, 'New' as status from f where source<>'src1'", more=FILES))
def s1(spark, sf):
    root = written_files(spark, sf)
    bare = root.removeprefix("file://").removeprefix("file:")
    found = files_.scan_mail_files(spark, [root], [f"{bare}/source=src1", f"{bare}/source=src"], "*.txt")
    return _named(found.where("status = 'New'")).withColumn("status", F.lit("New"))


@query("s2_scan_directory_index", duckdb("select source, lang, size from f where lang<>'de'", more=FILES))
def s2(spark, sf):
    return _named(files_.scan_directory_index(spark, written_files(spark, sf), ["lang=de"]))


@query("s3_read_path_list", duckdb("select path from file_catalog", "file_catalog"))
def s3(spark, sf):
    path = fresh_path(spark, "list")
    files(spark, sf).select(F.explode(F.array(F.concat(F.lit("  "), "path", F.lit(" ")), F.lit("   "))).alias("value")).write.text(path)
    return files_.read_path_list(spark, path)


@query("s6_read_attachment_bytes", duckdb("select concat(source,'/',lang) as hash, size from f", more=FILES))
def s6(spark, sf):
    found = files_.scan_mail_files(spark, [written_files(spark, sf)], pattern="*.txt")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    wanted = found.select(F.concat_ws("/", part("source"), part("lang")).alias("hash"), F.col("path").alias("local_path"))
    # a file with many names is read once
    read = files_.read_attachment_bytes(wanted.unionByName(wanted))
    return read.select("hash", F.octet_length("content").cast("long").alias("size"))


@query("s11_export_file_list", duckdb("select concat_ws(chr(9), path, size, strftime(last_modified,'%Y-%m-%d %H:%M:%S')) as line from file_catalog", "file_catalog"))
def s11(spark, sf):
    path = fresh_path(spark, "export")
    files_.export_file_list(files(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
