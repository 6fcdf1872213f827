"""Mail tables derived from the driver's tables, one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["documents", "events", "pages", "conversations", "lineitem", "part", "customer", "orders"]

_ADDRESS = "concat('user',(e.user_id*7+1)%150,'@org',((e.user_id*7+1)%150)%7,'.example; User',d.doc_id%20,'@org',(d.doc_id%20)%7,'.example')"

#: Tables in the order of their dependencies; {name} stands for a driver table.
TABLES: dict[str, str] = {
    "n_docs": "select count(*) as n from {documents}",
    "emails": f"""select concat('e', d.doc_id) as id, d.doc_id as seq, sha2(concat(d.source,'.pst-',d.doc_id), 256) as unique_entry_id,
        concat(d.source,'.pst') as pst_file, concat('Inbox / ', d.lang) as folder_path,
        case when d.doc_id % 17 = 0 then 'IPM.Appointment' else 'IPM.Note' end as message_class,
        concat('User',e.user_id,'@Org',e.user_id%7,'.example') as sender_address, concat('User ',e.user_id) as sender_name,
        substr(d.text,1,40) as subject, e.ts as received, d.text as plain,
        concat(d.text, case d.doc_id % 5 when 0 then concat(chr(10),chr(10),'On Mon, 1 Jan 2024, A wrote:',chr(10),'> old')
          when 1 then concat(chr(10),chr(10),'-----Original Message-----',chr(10),'From: a@b.example')
          when 2 then concat(chr(10),'--',chr(10),'sig') else '' end) as body,
        {_ADDRESS} as display_to,
        case when d.doc_id % 3 = 0 then concat('Carbon',d.doc_id%30,'@org',d.doc_id%7,'.example') else '' end as display_cc,
        case when d.doc_id % 11 = 0 then null else concat('<M-', substr(sha2(d.text, 256),1,16), '@X.example>') end as message_id,
        case when d.doc_id % 13 = 0 then null else concat('t', e.user_id % 40) end as conversation_id,
        e.value > 100 as is_read, d.doc_id % 3 as importance
        from {{documents}} d join {{events}} e on d.doc_id = e.event_id""",
    "attachments": """select concat(l.l_orderkey,'-',l.l_linenumber,'-',l.l_suppkey,'-',l.l_partkey) as id, concat('e', l.l_orderkey % (select n from n_docs)) as email_id,
        case when l.l_linenumber = 7 then null else sha2(concat('p',l.l_partkey), 256) end as hash,
        concat(p.p_name, case p.p_size % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.XLSX' else '' end) as filename,
        cast(l.l_quantity*1024 as bigint) as size, l.l_shipdate as created, p.p_size % 4 as kind, l.l_quantity as quantity, l.l_partkey as part_key
        from {lineitem} l join {part} p on l.l_partkey = p.p_partkey""",
    "file_catalog": """select concat('f',d.doc_id) as id, d.doc_id as seq, concat('/mnt/nas/',d.source,'/',d.lang,'/',d.doc_id,'.pst') as path, concat(d.doc_id,'.pst') as file_name,
        d.n_chars as size, e.ts as last_modified,
        case e.event_type when 'signup' then 'New' when 'click' then 'Modified' when 'error' then 'Invalid' else 'Processed' end as status,
        e.user_id % 2 = 0 as attachments_saved, case when d.doc_id % 19 = 0 then null else sha2(d.text, 256) end as content_hash,
        concat(d.source,'.pst') as pst_file
        from {documents} d join {events} e on d.doc_id = e.event_id""",
    "file_scan": """select path, file_name, case when seq % 10 = 1 then size + 1 else size end as size, last_modified,
        case when seq % 10 = 1 then sha2(concat('changed',seq), 256) else content_hash end as content_hash from file_catalog where seq % 10 <> 0
        union all select concat(path,'.copy'), concat(file_name,'.copy'), size, last_modified, content_hash from file_catalog where seq % 10 = 2
        union all select concat(path,'.new'), concat(file_name,'.new'), size, last_modified, sha2(concat('new',seq), 256) from file_catalog where seq % 10 = 3""",
    "mail_entities": """select distinct concat('e', l.l_orderkey % (select n from n_docs)) as email_id, p.p_name as name,
        case p.p_size % 3 when 0 then 'TOPIC' when 1 then 'ORG' else 'LOCATION' end as type
        from {lineitem} l join {part} p on l.l_partkey = p.p_partkey""",
    "k1_raw": """select concat('e', d.doc_id) as email_id, d.doc_id as seq, case when d.doc_id % 9 = 0 then 'no json here' else
        concat(case when d.doc_id % 4 = 0 then concat('```json',chr(10)) else '' end,
        '{lb}"entities":[{lb}"name":" Acme ', d.doc_id % 7, '","type":"ORG"{rb},{lb}"name":"Topic ', d.lang, '"{rb},{lb}"name":"ab","type":"ORG"{rb}],"claims":[{lb}"text":"Claim ', d.doc_id % 25,
        '","claimType":"', case d.doc_id % 2 when 0 then 'CAUSAL' else 'FACTUAL' end, '","confidence":0.', 1 + d.doc_id % 9, '{rb},{lb}"text":" "{rb}],"evidence":[{lb}"text":"Evidence ', d.doc_id % 5, '","sourceRef":"r', d.doc_id % 3,
        '"{rb}],"mechanisms":[{lb}"name":"Mechanism ', d.doc_id % 4, '","description":"d"{rb}],"relations":[{lb}"subject":"e', d.doc_id, '","predicate":"', case d.doc_id % 3 when 0 then 'CONTRADICTS' else 'PROVES' end, '","object":"Claim ', d.doc_id % 25, '"{rb},{lb}"subject":"x","predicate":"","object":"y"{rb}]{rb}',
        case when d.doc_id % 4 = 0 then concat(chr(10),'```') else '' end) end as raw from {documents} d""",
    "user_access": """select c_name as username, c_custkey as user_key, c_custkey % 10 = 0 as is_admin from {customer}""",
    "allowed_files": """select username, concat('f', user_key % (select n from n_docs)) as file_id from user_access where user_key % 7 <> 0
        union all select username, concat('f', (user_key * 3 + 1) % (select n from n_docs)) from user_access where user_key % 7 <> 0""",
    "log_entries": """select event_id as seq, ts, case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'INFO' else 'DEBUG' end as level, props as message from {events}""",
    "failed_conversions": """select concat('f',a.id) as id, a.email_id, a.hash, a.filename, case when a.kind = 3 then 'ATTACHMENT_CONVERT' else 'REPLY_STRIP' end as failure_type,
        a.quantity > 25 as resolved, cast(0 as int) as retry_count from attachments a where a.kind = 3 or a.part_key % 50 = 0""",
    "markdown_docs": """select d.doc_id as seq, concat('# ', d.lang, chr(10), chr(10), d.text, chr(10), chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| 1 | ', d.doc_id, ' |', chr(10), chr(10),
        '![fig](f.png) ![](g', d.doc_id % 3, '.png) [', d.doc_id % 9, '] [', d.doc_id % 9, ']') as markdown from {documents} d""",
    "questions": """select conv_id, min(turn) as turn, min(text) as question from {conversations} where role = 'user' group by conv_id""",
    "nas_hits": """select d.doc_id as seq, case when d.doc_id % 7 = 0 then '' when d.doc_id % 5 = 0 then concat('/other/',d.doc_id,'.pst') else concat('/volume1/shared/',d.source,'/',d.doc_id,'.pst') end as nas_path,
        case when d.doc_id % 11 = 0 then '' else concat(d.doc_id,'.pst') end as name, case when d.doc_id % 3 = 0 then null else d.n_chars end as size,
        case when d.doc_id % 2 = 0 then 0 else 1700000000 + d.doc_id end as modified, case when d.doc_id % 4 = 0 then 0 else 1600000000 + d.doc_id end as content_modified,
        case when d.doc_id % 19 = 0 then null else sha2(d.text, 256) end as content_hash from {documents} d""",
}

_NEEDS: dict[str, list[str]] = {
    "attachments": ["n_docs"],
    "mail_entities": ["n_docs"],
    "file_scan": ["file_catalog"],
    "allowed_files": ["n_docs", "user_access"],
    "failed_conversions": ["n_docs", "attachments"],
}


def _with(names: list[str]) -> list[str]:
    wanted = {m for n in names for m in [*_NEEDS.get(n, []), n]}
    return [n for n in TABLES if n in wanted]


def _text(name: str) -> str:
    return TABLES[name].replace("{lb}", "{{").replace("{rb}", "}}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived mail table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = ", ".join(f"{n} as ({_text(n)})" for n in _with([name]))
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if "{" + b + "}" in parts}
    return spark.sql(f"with {parts} select * from {name}", **used)


def duckdb_ctes(*names: str) -> list[str]:
    """The derived tables that names need, as DuckDB common table expressions."""
    base = {b: b for b in BASE}
    return [f"{n} as ({_text(n).format(**base).replace('sha2(', 'sha256(').replace(', 256)', ')')})" for n in _with(list(names))]


def duckdb(body: str, *names: str, more: str = "") -> str:
    """A DuckDB query over derived tables; more holds further common table expressions."""
    parts = duckdb_ctes(*names) + ([more] if more else [])
    return (f"with {', '.join(parts)} " if parts else "") + body
