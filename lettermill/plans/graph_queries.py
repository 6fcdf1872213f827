"""Queries of the communication and knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.operators import graph as G
from lettermill.operators import rag as R
from lettermill.plans.mail_queries import TS, m_sql, mails, ts
from lettermill.plans.registry import query
from lettermill.sources.fixtures import duckdb, table
from lettermill.sources.stored import fresh_path
from lettermill.functions import text as X


def entities(spark, sf):
    return table(spark, sf, "mail_entities")


def knowledge(spark, sf):
    return G.knowledge(table(spark, sf, "k1_raw"))


TO = "unnest(list_filter(list_transform(string_split(display_to,';'), lambda x: lower(trim(x))), lambda x: x<>''))"
CC = "unnest(list_filter(list_transform(string_split(display_cc,';'), lambda x: lower(trim(x))), lambda x: x<>''))"
COMM = f"cw as (select source, target, count(*) as count, max(received) as last_date from (select sender_key as source, {TO} as target, received from m) group by 1,2)"
EDGES = f"ae as (select distinct person, email_id, kind from (select sender_key as person, id as email_id, 'SENT' as kind from m union all select {TO}, id, 'TO' from m union all select {CC}, id, 'CC' from m))"
CONCEPTS = "cs as (select lower(name) as concept_key, arg_min(name, concat(email_id,chr(1),name,chr(1),type)) as name, arg_min(type, concat(email_id,chr(1),name,chr(1),type)) as type from mail_entities group by 1)"
K = """kk as (select email_id, seq from k1_raw where seq % 9 <> 0),
 cl as (select email_id, sha256(concat(email_id,'|claim|0')) as claim_id, concat('Claim ',seq%25) as text, case seq%2 when 0 then 'CAUSAL' else 'FACTUAL' end as claim_type, (1+seq%9)/10.0::double as confidence from kk),
 ev as (select email_id, sha256(concat(email_id,'|evidence|0')) as evidence_id, concat('Evidence ',seq%5) as text, 'INFERENCE' as evidence_type, concat('r',seq%3) as source_ref from kk),
 me as (select email_id, sha256(concat(email_id,'|mechanism|0')) as mechanism_id, concat('Mechanism ',seq%4) as name, 'd' as description, 'ORGANIZATIONAL' as mechanism_type from kk),
 ke as (select email_id, concat('Acme ',seq%7) as name, 'ORG' as type from kk union all select email_id, concat('Topic ',lang), 'TOPIC' from kk join documents d on kk.seq=d.doc_id)"""


def k_sql(body: str, *names: str) -> str:
    return m_sql(body, "k1_raw", *names, more=K)


@query("a12_persons", m_sql(f"select email, coalesce(arg_min(nm, concat(strftime(received,'%Y%m%d%H%M%S%f'),id)) filter(nm<>''),'') as name, split_part(email,'@',2) as organization from (select sender_key as email, sender_name as nm, received, id from m union all select {TO}, '', received, id from m union all select {CC}, '', received, id from m) group by email"))
def a12(spark, sf):
    return G.persons(mails(spark, sf))


@query("a13_threads", m_sql(f"select conversation_id as thread_id, arg_min(subject, concat(strftime(received,'%Y%m%d%H%M%S%f'),id)) as subject, {TS.format('max(received)')} as last_activity from m where conversation_id is not null group by 1"))
def a13(spark, sf):
    return G.threads(mails(spark, sf)).withColumn("last_activity", ts("last_activity"))


@query("a14_concepts", duckdb("select * from cs", "mail_entities", more=CONCEPTS))
def a14(spark, sf):
    return G.concepts(entities(spark, sf))


@query("a15_relink_concepts", duckdb("select distinct email_id, lower(name) as concept_key from mail_entities where email_id not in (select email_id from k1_raw where seq%9<>0) union all select email_id, concat('acme ',seq%7) from k1_raw where seq%9<>0 union all select email_id, concat('topic ',lang) from k1_raw join documents on seq=doc_id where seq%9<>0", "mail_entities", "k1_raw"))
def a15(spark, sf):
    return G.relink_concepts(G.mentions_edges(entities(spark, sf)), G.entities_of(knowledge(spark, sf)))


@query("a16_communicates_with", m_sql(f"select source, target, count, {TS.format('last_date')} as last_date from cw", more=COMM))
def a16(spark, sf):
    return G.communicates_with(mails(spark, sf)).withColumn("last_date", ts("last_date"))


STATS = "cnt as (select cs.type as kind, cs.name, count(distinct e.email_id) as n from mail_entities e join cs on lower(e.name)=cs.concept_key group by 1,2)"


@query("a17_graph_stats", m_sql("(select 'TOPIC' as list, name, n from cnt where kind='TOPIC' order by n desc, name limit 10) union all (select 'ORG', name, n from cnt where kind='ORG' order by n desc, name limit 10) union all (select 'SENDER', sender_key, count(*) as n from m group by sender_key order by n desc, sender_key limit 10)", "mail_entities", more=CONCEPTS + ", " + STATS))
def a17(spark, sf):
    return G.graph_stats(entities(spark, sf), mails(spark, sf))


@query("a18_node_counts", m_sql("select 'Email' as label, count(*) as n from m union all select 'Concept', (select count(distinct lower(name)) from mail_entities) union all select 'Thread', (select count(distinct conversation_id) from m)", "mail_entities"))
def a18(spark, sf):
    m = mails(spark, sf)
    return G.node_counts(Email=m, Concept=G.concepts(entities(spark, sf)), Thread=G.threads(m))


@query("j8_new_emails_for_graph", m_sql("select id from m where message_key not in (select message_key from m where seq%2=0)"))
def j8(spark, sf):
    m = mails(spark, sf)
    return G.new_emails(m, m.where("seq % 2 = 0")).select("id")


@query("j8_known_emails_for_graph", m_sql("select id from m where message_key in (select message_key from m where seq%2=0)"))
def j8b(spark, sf):
    m = mails(spark, sf)
    return G.known_emails(m, m.where("seq % 2 = 0")).select("id")


@query("j11_has_attachment_edges", m_sql("select distinct email_id, hash from attachments where hash is not null and email_id in (select id from m)", "attachments"))
def j11(spark, sf):
    return G.has_attachment_edges(table(spark, sf, "attachments"), mails(spark, sf))


@query("j12_address_edges", m_sql("select * from ae", more=EDGES))
def j12(spark, sf):
    return G.address_edges(mails(spark, sf))


@query("j13_belongs_to_edges", m_sql("select id as email_id, conversation_id as thread_id from m where conversation_id is not null"))
def j13(spark, sf):
    return G.belongs_to_edges(mails(spark, sf))


@query("j14_reply_to_edges", m_sql("select id as email_id, p as parent from (select id, first_value(id) over(partition by conversation_id order by received, id) as p from m where conversation_id is not null) where id<>p"))
def j14(spark, sf):
    return G.reply_to_edges(mails(spark, sf))


@query("w3_thread_position", m_sql("select id, conversation_id, cast(row_number() over(partition by conversation_id order by received, id) as int) as position from m where conversation_id is not null"))
def w3(spark, sf):
    return G.thread_position(mails(spark, sf))


@query("j15_mentions_edges", duckdb("select distinct email_id, lower(name) as concept_key from mail_entities", "mail_entities"))
def j15(spark, sf):
    return G.mentions_edges(entities(spark, sf))


CLAIM_EDGES = "select 'PROVES' as kind, email_id as source, claim_id as target from cl union all select 'SUPPORTED_BY', claim_id, evidence_id from cl join ev using(email_id) union all select 'INVOLVES', claim_id, mechanism_id from cl join me using(email_id)"


@query("j16_claim_edges", k_sql(CLAIM_EDGES))
def j16(spark, sf):
    return G.claim_edges(knowledge(spark, sf))


@query("j17_communication_partners", m_sql(f"select target, count, {TS.format('last_date')} as last_date from cw where source='user13@org6.example' order by target", more=COMM))
def j17(spark, sf):
    return G.communication_partners(G.communicates_with(mails(spark, sf)), "User13@org6.example ").withColumn("last_date", ts("last_date"))


@query("j17_communication_partners_in_range", m_sql(f"select target, count, {TS.format('last_date')} as last_date from cw where source='user13@org6.example' and last_date >= date '2024-01-03' order by count desc, target", more=COMM))
def j17b(spark, sf):
    return G.communication_partners(G.communicates_with(mails(spark, sf)), "user13@org6.example", first="2024-01-03").withColumn("last_date", ts("last_date"))


@query("j18_thread_emails", m_sql("select id, subject from m where conversation_id='t7' order by received, id"))
def j18(spark, sf):
    return G.thread_emails(mails(spark, sf), "t7").select("id", "subject")


@query("j19_emails_near_concept", m_sql("select id from m where id in (select email_id from mail_entities where lower(name) in (select concept_key from cs where contains(name,'widget'))) order by received desc, id limit 25", "mail_entities", more=CONCEPTS))
def j19(spark, sf):
    e = entities(spark, sf)
    return G.emails_near_concept(mails(spark, sf), G.mentions_edges(e), G.concepts(e), "widget", 25).select("id")


@query("j21_claim_resolution", k_sql("select cl.text as claim, coalesce(array_to_string(list_sort(list(distinct ev.text)),'; '),'') as evidence, coalesce(array_to_string(list_sort(list(distinct me.name)),'; '),'') as mechanism from cl left join ev using(email_id) left join me using(email_id) where contains(cl.text,'1') group by 1"))
def j21(spark, sf):
    return G.claim_resolution(knowledge(spark, sf), "1")


@query("j22_claim_sources", k_sql("select m.id, m.sender_key, cl.text as claim from cl join m on cl.email_id=m.id where contains(cl.text,'Claim 1') order by m.received desc, m.id, cl.text limit 20"))
def j22(spark, sf):
    return G.claim_sources(mails(spark, sf), knowledge(spark, sf), "Claim 1").select("id", "sender_key", "claim")


@query("j23_thread_contradictions", k_sql("select thread_id, claim, p.n as proved_by, c.n as contradicted_by from (select conversation_id as thread_id, text as claim, count(distinct email_id) n from cl join m on email_id=m.id where conversation_id is not null group by 1,2) p join (select conversation_id as thread_id, concat('Claim ',kk.seq%25) as claim, count(distinct email_id) n from kk join m on email_id=m.id where conversation_id is not null and kk.seq%3=0 group by 1,2) c using(thread_id, claim)"))
def j23(spark, sf):
    return G.thread_contradictions(mails(spark, sf), knowledge(spark, sf))


@query("j24_weighted_network", m_sql(f"select source, target, count, {TS.format('last_date')} as last_date from cw order by count desc, source, target", more=COMM))
def j24(spark, sf):
    return G.weighted_network(G.communicates_with(mails(spark, sf))).withColumn("last_date", ts("last_date"))


@query("j25_register_graph_views", m_sql("select a.source as source, b.target as two_hops, count(*) as paths from cw a join cw b on a.target=b.source where a.source='user13@org6.example' group by 1,2", more=COMM))
def j25(spark, sf):
    G.register_graph_views({"communicates_with": G.communicates_with(mails(spark, sf))})
    return spark.sql("select a.source as source, b.target as two_hops, count(*) as paths from graph_communicates_with a join graph_communicates_with b on a.target = b.source where a.source = 'user13@org6.example' group by 1, 2")


REQUESTS = "rq as (select conversation_id as request, id as email_id from m where conversation_id is not null)"
MINI = """e2 as (select distinct request, concat('person:',person) as source, concat('email:',email_id) as target, kind as type from rq join ae using(email_id) union all select distinct request, concat('email:',email_id), concat('concept:',lower(name)), 'MENTIONS' from rq join mail_entities using(email_id)),
 nd as (select distinct request, concat('email:',email_id) as node_id, 'EMAIL' as type, 0 as pr from rq union all select request, source, 'PERSON', case when bool_or(type='SENT') then 1 else 2 end from e2 where type<>'MENTIONS' group by 1,2 union all select distinct request, target, 'CONCEPT', 3 from e2 where type='MENTIONS'),
 kept as (select request, node_id, type from nd qualify row_number() over(partition by request order by pr, node_id)<=200)"""


def mini(spark, sf):
    m = mails(spark, sf)
    requests = m.where("conversation_id is not null").select(F.col("conversation_id").alias("request"), F.col("id").alias("email_id"))
    return G.mini_graph(requests, m, G.address_edges(m), G.mentions_edges(entities(spark, sf)), 200)


@query("j26_mini_graph", m_sql("select request, source, target, type from e2 where (request, source) in (select request, node_id from kept) and (request, target) in (select request, node_id from kept)", "mail_entities", more=EDGES + ", " + REQUESTS + ", " + MINI))
def j26(spark, sf):
    return mini(spark, sf)[1].select("request", "source", "target", "type")


@query("w6_cap_nodes", m_sql("select request, node_id, type from kept", "mail_entities", more=EDGES + ", " + REQUESTS + ", " + MINI))
def w6(spark, sf):
    return mini(spark, sf)[0].select("request", "node_id", "type")


@query("p13_find_claims", k_sql("select claim_id, text from cl where claim_type='CAUSAL' and confidence>=0.5"))
def p13(spark, sf):
    return G.find_claims(G.claims(knowledge(spark, sf)), "CAUSAL", 0.5).select("claim_id", "text")


@query("p13_find_evidence", k_sql("select evidence_id, text from ev where evidence_type='INFERENCE' and source_ref='r1'"))
def p13b(spark, sf):
    return G.find_evidence(G.evidence(knowledge(spark, sf)), "INFERENCE", "r1").select("evidence_id", "text")


@query("p13_find_mechanisms", k_sql("select mechanism_id, name from me where mechanism_type='ORGANIZATIONAL' and contains(lower(name),'mechanism 2')"))
def p13c(spark, sf):
    return G.find_mechanisms(G.mechanisms(knowledge(spark, sf)), "ORGANIZATIONAL", "MECHANISM 2").select("mechanism_id", "name")


@query("p13_find_lineage", "select p_name as method_name, p_brand as version, count(*) as n from part where p_name='cold widget' and p_brand='Brand#13' group by 1,2")
def p13d(spark, sf):
    lineage = table(spark, sf, "part").select(F.col("p_name").alias("method_name"), F.col("p_brand").alias("version"))
    return G.find_lineage(lineage, "cold widget", "Brand#13").groupBy("method_name", "version").agg(F.count(F.lit(1)).alias("n"))


BUILT = f"""gn as (select * from m where message_key not in (select message_key from m where seq%5=0)), ge as (select * from ke where email_id in (select id from gn)), gc as (select * from cl where email_id in (select id from gn)),
 gt as (select id, {TO} as a from gn union all select id, {CC} from gn)"""


@query(
    "d4_build_graph",
    m_sql(
        """select 'email' as label, count(distinct message_key) as n from gn union all select 'thread', count(distinct conversation_id) from gn union all select 'claim', count(*) from gc union all select 'evidence', count(*) from gc
        union all select 'mechanism', count(*) from gc union all select 'claim_edge', 3*count(*) from gc union all select 'concept', count(distinct lower(name)) from ge union all select 'mentions', count(*) from (select distinct email_id, lower(name) from ge)
        union all select 'belongs_to', count(conversation_id) from gn union all select 'reply_to', count(conversation_id)-count(distinct conversation_id) from gn
        union all select 'person', count(distinct a) from (select a from gt union all select sender_key from gn)
        union all select 'address_edge', count(*) from (select distinct a, id, k from (select sender_key as a, id, 'S' as k from gn union all select """
        + TO
        + ", id, 'T' from gn union all select "
        + CC
        + """, id, 'C' from gn)) union all select 'communicates_with', count(*) from (select distinct sender_key, """
        + TO
        + " as t from gn)",
        "k1_raw",
        more=K + ", " + BUILT,
    ),
)
def d4(spark, sf):
    """The graph after two batches that split the mails of threads and pairs, counted."""
    path = fresh_path(spark, "graph")
    m, raw = mails(spark, sf), table(spark, sf, "k1_raw")
    known = m.where("seq % 5 = 0").select("message_key")
    half = F.pmod(F.xxhash64("message_key"), F.lit(2)) == 0
    G.write_graph(path, G.build_graph(m.where(half), raw, known), "first")
    stored_keys = spark.read.parquet(f"{path}/email").select("message_key")
    G.write_graph(path, G.build_graph(m, raw, known.unionByName(stored_keys)), "second")
    return G.node_counts(**G.read_graph(spark, path))


@query("s10_write_graph", m_sql(f"select source, target, count, {TS.format('last_date')} as last_date from cw", more=COMM))
def s10(spark, sf):
    path = fresh_path(spark, "graph")
    for k in range(3):  # the mails of a pair lie in all batches
        G.write_graph(path, {"communicates_with": G.communicates_with(mails(spark, sf).where(F.col("seq") % 3 == k))}, str(k))
    G.write_graph(f"{path}-whole", G.read_parts(spark, path, ["communicates_with"]), "whole")
    return G.read_parts(spark, f"{path}-whole", ["communicates_with"])["communicates_with"].select("source", "target", "count", ts("last_date").alias("last_date"))


@query("w3_thread_parent", m_sql("select id, nullif(first_value(id) over(partition by conversation_id order by received, id), id) as parent from m where conversation_id is not null"))
def w3b(spark, sf):
    return G.thread_parent(mails(spark, sf))


@query("d5_refresh_concepts", m_sql("select distinct email_id, lower(name) as concept_key from mail_entities where email_id not in (select ke.email_id from ke join m on ke.email_id=m.id where m.message_key in (select message_key from m where seq%2=0)) union all select distinct email_id, lower(name) from ke where email_id in (select id from m where message_key in (select message_key from m where seq%2=0))", "mail_entities", "k1_raw", more=K))
def d5(spark, sf):
    m = mails(spark, sf)
    return G.refresh_concepts(m, table(spark, sf, "k1_raw"), m.where("seq % 2 = 0"), G.mentions_edges(entities(spark, sf)))


# ---- retrieval


def question_entities(spark, sf):
    """Entities of each question: two part names by its number."""
    names = entities(spark, sf).select("name").distinct()
    q = table(spark, sf, "questions").select(F.col("conv_id").alias("question"))
    words = F.array(*[F.lit(w) for w in NAMES])
    return q.select("question", F.posexplode(F.array(F.element_at(words, (F.col("question") % len(NAMES) + 1).cast("int")), F.element_at(words, (F.col("question") * 3 % len(NAMES) + 1).cast("int")))).alias("place", "name")).join(names.limit(1).select(F.lit(1).alias("_")), F.lit(True), "left_semi")


NAMES = ["widget", "cold", "small", "gear", "bolt"]
_ASKED = "qe as (select conv_id as question, p as place, (['widget','cold','small','gear','bolt'])[cast(case p when 0 then conv_id % 5 else conv_id*3 % 5 end as int)+1] as name from questions, (values (0),(1)) t(p))"
_CONTEXT = """hit as (select distinct qn.name, e.email_id as id from (select distinct name from qe) qn join cs on contains(cs.name, qn.name) join mail_entities e on lower(e.name)=cs.concept_key),
 best as (select name, id, row_number() over(partition by name order by received desc, id) as r from hit join m using(id) qualify r<=5),
 ask as (select question, id, min(place*1000+r) as seat from qe join best using(name) group by 1,2),
 ctx as (select question, id, cast(row_number() over(partition by question order by seat, id) as int) as rank from ask qualify rank<=5)"""
CTX = CONCEPTS + ", " + _ASKED + ", " + _CONTEXT


def context(spark, sf):
    e = entities(spark, sf)
    return R.rag_context(question_entities(spark, sf), mails(spark, sf), G.mentions_edges(e), G.concepts(e), 5)


@query("j20_rag_context", m_sql("select question, id from ctx", "mail_entities", "questions", more=CTX))
def j20(spark, sf):
    return context(spark, sf).select("question", "id")


@query("w4_rag_rank", m_sql("select question, id, rank from ctx", "mail_entities", "questions", more=CTX))
def w4(spark, sf):
    return context(spark, sf)


@query("w5_chat_tail", "select conv_id, array_to_string(list(concat(role,': ',text) order by turn, role, text), chr(30)) as history from (select * from conversations qualify row_number() over(partition by conv_id order by turn desc, role desc, text desc)<=4) where role is not null and text is not null group by conv_id")
def w5(spark, sf):
    return R.chat_tail(table(spark, sf, "conversations"), 2).withColumn("history", F.array_join("history", "\x1e"))


def _sql(text: str) -> str:
    return "concat('" + text.replace("'", "''").replace("\n", "', chr(10), '") + "')"


@query(
    "f27_rag_prompt",
    m_sql(
        f"select q.conv_id as question_id, concat({_sql(R.SYSTEM)}, coalesce(string_agg(concat('--- Hit ',rank,' ---',chr(10),'Subject: ',coalesce(subject,''),chr(10),'Date: ',strftime(received,'%Y-%m-%d'),chr(10),'File: ',pst_file,chr(10),'Content: ',substr(plain,1,500),chr(10),chr(10)),'' order by rank), {_sql(R.NOTHING_FOUND)}), chr(10),'Question: ', q.question) as prompt from questions q left join ctx on ctx.question=q.conv_id left join m on m.id=ctx.id group by q.conv_id, q.question",
        "mail_entities",
        "questions",
        more=CTX,
    ),
)
def f27(spark, sf):
    texts = table(spark, sf, "emails").select("id", "subject", "received", "pst_file", F.col("plain").alias("text"))
    return R.rag_prompt(table(spark, sf, "questions").select(F.col("conv_id").alias("question_id"), "question"), context(spark, sf), texts)


@query("f27_rag_sources", m_sql("select question, string_agg(concat(rank,':',id,':',owner), ',' order by rank) as sources from ctx join m using(id) group by question", "mail_entities", "questions", more=CTX))
def f27b(spark, sf):
    s = R.rag_sources(context(spark, sf), mails(spark, sf))
    return s.select("question", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["id"], x["owner"])), ",").alias("sources"))


@query("d1_extract_entities")
def d1(spark, sf):
    match = R.dictionary_matcher({"the": "TOPIC", "und": "TOPIC", "les": "ORG", "para": "LOCATION"})
    return R.extract_entities(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.truncate(F.col("text")).alias("text")), match)
