"""The communication and knowledge graph: vertices, edges, traversals, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.sources.stored import stored

# ---- vertices


def person_parts(mails: DataFrame) -> DataFrame:
    """(email, named, organization): named is the first name that is not empty, with its time and mail."""
    sent = mails.select(F.col("sender_key").alias("email"), "sender_name", "received", "id")
    to = mails.select(F.explode(F.concat("recipients", "cc")).alias("a"), "received", "id").select(X.address_key(F.col("a")).alias("email"), F.lit(None).cast("string").alias("sender_name"), "received", "id")
    seen = sent.unionByName(to).where(X.blank_to_null(F.col("email")).isNotNull())
    name = F.min(F.when(X.blank_to_null(F.col("sender_name")).isNotNull(), F.struct("received", "id", "sender_name")))
    return seen.groupBy("email").agg(name.alias("named")).select("email", "named", X.address_domain(F.col("email")).alias("organization"))


def persons(mails: DataFrame) -> DataFrame:
    """One person for each address key: first name that is not empty, by time and mail, and the domain."""
    return SHOWN["person"](person_parts(mails))


def thread_parts(mails: DataFrame) -> DataFrame:
    """(thread_id, opened, last_activity): opened is the first mail's time, id and subject."""
    named = mails.where(X.blank_to_null(F.col("conversation_id")).isNotNull())
    return named.groupBy(F.col("conversation_id").alias("thread_id")).agg(F.min(F.struct("received", "id", "subject")).alias("opened"), F.max("received").alias("last_activity"))


def threads(mails: DataFrame) -> DataFrame:
    """One thread for each conversation id: subject of its first mail, time of its last."""
    return SHOWN["thread"](thread_parts(mails))


def concept_parts(entities: DataFrame) -> DataFrame:
    """(concept_key, told): told is the first mail that mentions it, with spelling and type."""
    return entities.groupBy(F.lower("name").alias("concept_key")).agg(F.min(F.struct("email_id", "name", "type")).alias("told"))


def concepts(entities: DataFrame) -> DataFrame:
    """One concept for each name without regard to case: the spelling and type of the first mail, by mail, name and type."""
    return SHOWN["concept"](concept_parts(entities))


#: Vertices as they are shown, from parts that may still be merged.
SHOWN = {
    "person": lambda df: df.select("email", F.coalesce("named.sender_name", F.lit("")).alias("name"), "organization"),
    "thread": lambda df: df.select("thread_id", F.col("opened.subject").alias("subject"), "last_activity"),
    "concept": lambda df: df.select("concept_key", F.col("told.name").alias("name"), F.col("told.type").alias("type")),
}


def node_counts(**vertices: DataFrame) -> DataFrame:
    """Vertices of each label."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, df in vertices.items()])


# ---- edges


def address_edges(mails: DataFrame) -> DataFrame:
    """(person, email_id, kind): who sent a mail (SENT) and who got it (TO, CC); blank addresses drop out."""
    sent = mails.select(F.col("sender_key").alias("person"), F.col("id").alias("email_id"), F.lit("SENT").alias("kind"))
    got = [mails.select(F.explode(column).alias("a"), "id").select(X.address_key(F.col("a")).alias("person"), F.col("id").alias("email_id"), F.lit(kind).alias("kind")) for column, kind in (("recipients", "TO"), ("cc", "CC"))]
    return reduce(DataFrame.unionByName, [sent, *got]).where(X.blank_to_null(F.col("person")).isNotNull()).distinct()


def belongs_to_edges(mails: DataFrame) -> DataFrame:
    return mails.where(X.blank_to_null(F.col("conversation_id")).isNotNull()).select(F.col("id").alias("email_id"), F.col("conversation_id").alias("thread_id"))


def reply_to_edges(mails: DataFrame) -> DataFrame:
    """Each mail but the first of its thread replies to the first; the first mail comes from an aggregate, so a hot thread is
    never sorted in one task."""
    named = mails.where(X.blank_to_null(F.col("conversation_id")).isNotNull())
    first = named.groupBy("conversation_id").agg(F.min(F.struct("received", "id")).alias("m")).select("conversation_id", F.col("m.id").alias("parent"))
    return named.join(first, "conversation_id").where("id <> parent").select(F.col("id").alias("email_id"), "parent")


def thread_parent(mails: DataFrame) -> DataFrame:
    """(id, parent) of every mail with a thread: the thread's earliest mail, null for that mail itself."""
    named = mails.where(X.blank_to_null(F.col("conversation_id")).isNotNull()).select("id")
    return named.join(reply_to_edges(mails).withColumnRenamed("email_id", "id"), "id", "left")


def thread_position(mails: DataFrame) -> DataFrame:
    """Place of each mail in its thread, from 1. Mails are dealt by ranges of thread, time and id, so a hot thread lies in many
    parts; each numbers its own rows and begins after what the parts before it hold."""
    named = mails.where(X.blank_to_null(F.col("conversation_id")).isNotNull()).select("id", "conversation_id", "received")
    rows = stored(named.repartitionByRange("conversation_id", "received", "id").withColumn("part", F.spark_partition_id()), "thread-parts")
    place = F.row_number().over(Window.partitionBy("conversation_id", "part").orderBy("received", "id"))
    earlier = Window.partitionBy("conversation_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conversation_id", "part").agg(F.count(F.lit(1)).alias("n")).select("conversation_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.withColumn("place", place).join(before, ["conversation_id", "part"]).select("id", "conversation_id", (F.col("place") + F.col("before")).cast("int").alias("position"))


def has_attachment_edges(attachments: DataFrame, mails: DataFrame) -> DataFrame:
    named = attachments.where(X.blank_to_null(F.col("hash")).isNotNull()).select("email_id", "hash")
    return named.join(mails.select(F.col("id").alias("email_id")), "email_id", "left_semi").distinct()


def mentions_edges(entities: DataFrame) -> DataFrame:
    return entities.select("email_id", F.lower("name").alias("concept_key")).distinct()


def communicates_with(mails: DataFrame) -> DataFrame:
    """(source, target, count, last_date): mails from a sender to each recipient. Partial sums go before the exchange."""
    pairs = mails.select(F.col("sender_key").alias("source"), F.explode("recipients").alias("a"), "received").select("source", X.address_key(F.col("a")).alias("target"), "received")
    kept = pairs.where(X.blank_to_null(F.col("target")).isNotNull() & X.blank_to_null(F.col("source")).isNotNull())
    return kept.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"), F.max("received").alias("last_date"))


def knowledge(raw: DataFrame) -> DataFrame:
    """Model answers (email_id, raw) parsed into the five arrays."""
    return raw.select("email_id", X.parse_k1(F.col("raw")).alias("k1")).select("email_id", "k1.*")


def entities_of(k: DataFrame) -> DataFrame:
    return k.select("email_id", F.explode("entities").alias("e")).select("email_id", "e.name", "e.type")


def _items(k: DataFrame, field: str, kind: str) -> DataFrame:
    rows = k.select("email_id", F.posexplode(field).alias("pos", "x"))
    return rows.select("email_id", F.sha2(F.concat_ws("|", "email_id", F.lit(kind), "pos"), 256).alias("item_id"), "x.*")


def claims(k: DataFrame) -> DataFrame:
    """(email_id, claim_id, text, claim_type, confidence)."""
    return _items(k, "claims", "claim").select("email_id", F.col("item_id").alias("claim_id"), "text", F.col("claimType").alias("claim_type"), "confidence")


def evidence(k: DataFrame) -> DataFrame:
    return _items(k, "evidence", "evidence").select("email_id", F.col("item_id").alias("evidence_id"), "text", F.col("evidenceType").alias("evidence_type"), F.col("sourceRef").alias("source_ref"))


def mechanisms(k: DataFrame) -> DataFrame:
    return _items(k, "mechanisms", "mechanism").select("email_id", F.col("item_id").alias("mechanism_id"), "name", "description", F.col("mechanismType").alias("mechanism_type"))


def claim_edges(k: DataFrame) -> DataFrame:
    """(kind, source, target): a mail PROVES its claims; each claim is SUPPORTED_BY all evidence and INVOLVES all mechanisms of
    its mail. The pairs stay within a mail's arrays."""
    c = claims(k).select("email_id", "claim_id")
    proves = c.select(F.lit("PROVES").alias("kind"), F.col("email_id").alias("source"), F.col("claim_id").alias("target"))
    supported = c.join(evidence(k).select("email_id", "evidence_id"), "email_id").select(F.lit("SUPPORTED_BY").alias("kind"), F.col("claim_id").alias("source"), F.col("evidence_id").alias("target"))
    involves = c.join(mechanisms(k).select("email_id", "mechanism_id"), "email_id").select(F.lit("INVOLVES").alias("kind"), F.col("claim_id").alias("source"), F.col("mechanism_id").alias("target"))
    return proves.unionByName(supported).unionByName(involves)


def relation_edges(k: DataFrame, predicate: str = "CONTRADICTS") -> DataFrame:
    """(email_id, claim text) of relations whose object is a claim's text."""
    rows = k.select("email_id", F.explode("relations").alias("r")).where(F.col("r.predicate") == predicate).select("email_id", F.col("r.object").alias("text"))
    return rows.join(claims(k).select("text").distinct(), "text", "left_semi").distinct()


def new_emails(mails: DataFrame, known: DataFrame, key: str = "message_key") -> DataFrame:
    return mails.join(known.select(key), key, "left_anti")


def known_emails(mails: DataFrame, known: DataFrame, key: str = "message_key") -> DataFrame:
    return mails.join(known.select(key), key, "left_semi")


def relink_concepts(old: DataFrame, extracted: DataFrame) -> DataFrame:
    """MENTIONS after a new extraction: mails with new entities get only those, others keep their links."""
    fresh = mentions_edges(extracted)
    return old.join(fresh.select("email_id").distinct(), "email_id", "left_anti").unionByName(fresh)


#: Keys of each stored table, and how the other columns of a key's rows from several batches become one. Columns that are not
#: named come from the smallest row.
KEYS = {
    "person": ["email"], "thread": ["thread_id"], "email": ["message_key"], "concept": ["concept_key"], "claim": ["claim_id"], "evidence": ["evidence_id"], "mechanism": ["mechanism_id"],
    "address_edge": ["person", "email_id", "kind"], "belongs_to": ["email_id", "thread_id"], "mentions": ["email_id", "concept_key"], "claim_edge": ["kind", "source", "target"], "communicates_with": ["source", "target"],
}
MERGED = {
    "person": {"named": F.min, "organization": F.min},
    "thread": {"opened": F.min, "last_activity": F.max},
    "concept": {"told": F.min},
    "communicates_with": {"count": F.sum, "last_date": F.max},
}


def write_graph(path: str, tables: dict[str, DataFrame], batch: str) -> None:
    """Store the vertices and edges of one batch of mails, a Parquet table for each name with a folder for each batch. Nothing
    stored is read or rewritten, so a batch costs what it holds; a batch that is written again takes its own place. Its mark in the
    manifest goes first and comes back last, so a run that is cut shows none of the batch."""
    spark = next(iter(tables.values())).sparkSession
    mark = spark.createDataFrame([(batch,)], "done string").coalesce(1)
    mark.limit(0).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    mark.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def stored_batches(spark: SparkSession, path: str) -> list[str]:
    """Batches that were written to their end."""
    return sorted(r["done"] for r in spark.read.schema("done string").parquet(f"{path}/manifest").collect())  # a row a batch


def merge_parts(name: str, rows: DataFrame) -> DataFrame:
    """Rows of one key from several batches as one row: counts add up, dates and activity are the latest, names, subjects and
    spellings those of the first mail; what repeats is there once."""
    key = KEYS[name]
    rest = [c for c in rows.columns if c not in key]
    if name in MERGED:
        return rows.groupBy(*key).agg(*[MERGED[name][c](c).alias(c) for c in rest])
    if not rest:
        return rows.distinct()
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_m")).select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def read_parts(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Stored tables over all batches, merged by key, still in parts: what write_graph of another folder takes to compact them."""
    among = stored_batches(spark, path)
    if not among:
        raise ValueError(f"no batch in {path} was written to its end")
    return {n: merge_parts(n, spark.read.parquet(*[f"{path}/{n}/batch={b}" for b in among])) for n in names or KEYS}


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All vertices and edges as they stand after every batch. reply_to follows from the threads' first mails of all batches, so a
    reply to a stored thread, or an earlier mail that comes later, has the right parent."""
    parts = read_parts(spark, path)
    first = parts["thread"].select("thread_id", F.col("opened.id").alias("parent"))
    replies = parts["belongs_to"].join(first, "thread_id").where("email_id <> parent").select("email_id", "parent")
    return {n: SHOWN[n](df) if n in SHOWN else df for n, df in parts.items()} | {"reply_to": replies}


# ---- traversals


def communication_partners(edges: DataFrame, address: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Partners that an address wrote to: by name without a range; with either bound those last written to in it, by count."""
    mine = edges.where(F.col("source") == address.strip().lower())
    if first or last:
        return mine.where(X.in_days(F.col("last_date"), first, last)).select("target", "count", "last_date").orderBy(F.desc("count"), "target")
    return mine.select("target", "count", "last_date").orderBy("target")


def weighted_network(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "count", "last_date").orderBy(F.desc("count"), "source", "target")


def thread_emails(mails: DataFrame, thread: str) -> DataFrame:
    return mails.where(F.col("conversation_id") == thread).orderBy("received", "id")


def emails_near_concept(mails: DataFrame, mentions: DataFrame, concept_table: DataFrame, part: str, k: int) -> DataFrame:
    """The newest k mails that mention a concept whose name contains a text, each once."""
    wanted = concept_table.where(F.contains("name", F.lit(part))).select("concept_key")
    hit = mentions.join(wanted, "concept_key", "left_semi").select(F.col("email_id").alias("id")).distinct()
    return mails.join(hit, "id", "left_semi").orderBy(F.desc("received"), "id").limit(k)


def claim_resolution(k: DataFrame, part: str) -> DataFrame:
    """Claims whose text contains a word, with the texts of their evidence and the names of their mechanisms."""
    c = claims(k).where(F.contains("text", F.lit(part))).select("email_id", F.col("text").alias("claim"))
    e = evidence(k).select("email_id", F.col("text").alias("evidence"))
    m = mechanisms(k).select("email_id", F.col("name").alias("mechanism"))
    # evidence and mechanisms meet the claims apart, so a mail's many never multiply
    lists = [c.join(x, "email_id").select("claim", name).distinct().groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set(name)), "; ").alias(name)) for x, name in ((e, "evidence"), (m, "mechanism"))]
    out = c.select("claim").distinct()
    for listed in lists:
        out = out.join(listed, "claim", "left")
    return out.select("claim", *[F.coalesce(n, F.lit("")).alias(n) for n in ("evidence", "mechanism")])


def claim_sources(mails: DataFrame, k: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """Who asserts claims that contain a text, newest mails first."""
    c = claims(k).where(F.contains("text", F.lit(part))).select(F.col("email_id").alias("id"), F.col("text").alias("claim"))
    return mails.select("id", "sender_key", "received").join(c, "id").orderBy(F.desc("received"), "id", "claim").limit(limit)


def thread_contradictions(mails: DataFrame, k: DataFrame) -> DataFrame:
    """(thread_id, claim, proved_by, contradicted_by) numbers of mails: a claim that some mails of a thread prove and others
    contradict. Counts for each side are joined, so a hot claim does not multiply."""
    where = mails.where("conversation_id is not null").select(F.col("id").alias("email_id"), F.col("conversation_id").alias("thread_id"))
    proves = claims(k).select("email_id", F.col("text").alias("claim")).distinct().join(where, "email_id").groupBy("thread_id", "claim").agg(F.countDistinct("email_id").alias("proved_by"))
    against = relation_edges(k).select("email_id", F.col("text").alias("claim")).join(where, "email_id").groupBy("thread_id", "claim").agg(F.countDistinct("email_id").alias("contradicted_by"))
    return proves.join(against, ["thread_id", "claim"])


def graph_stats(entities: DataFrame, mails: DataFrame, top: int = 10) -> DataFrame:
    """(list, name, n): the concepts of the types TOPIC and ORG that most mails mention, and the busiest senders."""
    named = entities.join(concepts(entities).select("concept_key", F.col("name").alias("shown"), F.col("type").alias("kind")), F.lower(entities["name"]) == F.col("concept_key"))
    counted = named.groupBy("kind", "shown").agg(F.countDistinct("email_id").alias("n"))
    lists = [counted.where(F.col("kind") == t).select(F.lit(t).alias("list"), F.col("shown").alias("name"), "n").orderBy(F.desc("n"), "name").limit(top) for t in ("TOPIC", "ORG")]
    senders = mails.groupBy(F.col("sender_key").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("SENDER").alias("list"), "name", "n").orderBy(F.desc("n"), "name").limit(top)
    return reduce(DataFrame.unionByName, [*lists, senders])


def find(df: DataFrame, **equal) -> DataFrame:
    """Vertices whose columns equal the given values; those not given (None) do not count."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def find_claims(c: DataFrame, claim_type: str | None = None, least: float | None = None) -> DataFrame:
    out = find(c, claim_type=claim_type)
    return out if least is None else out.where(F.col("confidence") >= least)


def find_evidence(e: DataFrame, evidence_type: str | None = None, source_ref: str | None = None) -> DataFrame:
    return find(e, evidence_type=evidence_type, source_ref=source_ref)


def find_mechanisms(m: DataFrame, mechanism_type: str | None = None, part: str | None = None) -> DataFrame:
    out = find(m, mechanism_type=mechanism_type)
    return out if part is None else out.where(F.contains(F.lower("name"), F.lit(part.lower())))


def find_lineage(lineage: DataFrame, method: str, version: str | None = None) -> DataFrame:
    return find(lineage, method_name=method, version=version)


def cap_nodes(nodes: DataFrame, most: int = 200, group: str | None = None) -> DataFrame:
    """At most so many nodes of a request, mails and senders first, then TO and CC persons, concepts last."""
    priority = F.when(F.col("type") == "EMAIL", 0).when(F.col("role") == "SENT", 1).when(F.col("type") == "PERSON", 2).otherwise(3)
    if group is None:
        return nodes.orderBy(priority, "node_id").limit(most)
    w = Window.partitionBy(group).orderBy(priority, "node_id")
    return nodes.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def mini_graph(requests: DataFrame, mails: DataFrame, edges: DataFrame, mentions: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the mails of each request (request, email_id): no repeats, at most `most` nodes a request."""
    wanted = requests.select("request", "email_id").distinct()
    e = wanted.join(edges, "email_id").select("request", F.concat(F.lit("person:"), "person").alias("source"), F.concat(F.lit("email:"), "email_id").alias("target"), F.col("kind").alias("type"))
    m = wanted.join(mentions, "email_id").select("request", F.concat(F.lit("email:"), "email_id").alias("source"), F.concat(F.lit("concept:"), "concept_key").alias("target"), F.lit("MENTIONS").alias("type"))
    mail_nodes = wanted.join(mails.select(F.col("id").alias("email_id")), "email_id", "left_semi").select("request", F.concat(F.lit("email:"), "email_id").alias("node_id"), F.lit("EMAIL").alias("type"), F.lit("").alias("role"))
    person_nodes = e.groupBy("request", F.col("source").alias("node_id")).agg(F.max("type").alias("k"), F.max(F.col("type") == "SENT").alias("sent")).select("request", "node_id", F.lit("PERSON").alias("type"), F.when(F.col("sent"), "SENT").otherwise("TO").alias("role"))
    concept_nodes = m.select("request", F.col("target").alias("node_id"), F.lit("CONCEPT").alias("type"), F.lit("").alias("role")).distinct()
    nodes = cap_nodes(mail_nodes.unionByName(person_nodes).unionByName(concept_nodes), most, "request")
    kept = nodes.select("request", "node_id")
    both = e.unionByName(m).distinct()
    both = both.join(kept.withColumnRenamed("node_id", "source"), ["request", "source"], "left_semi").join(kept.withColumnRenamed("node_id", "target"), ["request", "target"], "left_semi")
    return nodes, both


def register_graph_views(tables: dict[str, DataFrame], prefix: str = "graph_") -> list[str]:
    """A temporary view for each table, for read-only SQL by analysts."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in tables]


def build_graph(mails: DataFrame, raw: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """All vertices and edges of the mails that are not known yet, in parts, for write_graph. The new mails, without their bodies,
    and the parsed answers are written once, since twelve tables read them."""
    new = stored(new_emails(mails, known).drop("body"), "graph-mails")
    k = stored(knowledge(raw.join(new.select(F.col("id").alias("email_id")), "email_id", "left_semi")), "graph-knowledge")
    entities = entities_of(k)
    return {
        "person": person_parts(new),
        "thread": thread_parts(new),
        "email": new.select("message_key", "id", "subject", "received", "pst_file", "owner"),
        "concept": concept_parts(entities),
        "claim": claims(k),
        "evidence": evidence(k),
        "mechanism": mechanisms(k),
        "address_edge": address_edges(new),
        "belongs_to": belongs_to_edges(new),
        "mentions": mentions_edges(entities),
        "claim_edge": claim_edges(k),
        "communicates_with": communicates_with(new),
    }


def refresh_concepts(mails: DataFrame, raw: DataFrame, known: DataFrame, old: DataFrame) -> DataFrame:
    """MENTIONS after the mails in the graph were extracted anew."""
    again = known_emails(mails, known)
    k = knowledge(raw.join(again.select(F.col("id").alias("email_id")), "email_id", "left_semi"))
    return relink_concepts(old, entities_of(k))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects."""
    return df.select(F.to_json(F.struct("*")).alias("row"))

