"""A stored inverted index that follows its documents, and ranked search that reads the part of it that can matter.

A batch of changes adds a folder to each table: postings of the new rows, tombstones of the rows that they replace, and what
both change in the counts. Nothing stored is rewritten; counts are signed and added up when read. A manifest is written last,
and only batches that have one are read, so a batch that was cut short is invisible and its replay takes its place.

Postings are clustered by term and fall in impact within a term: a row group's statistics are the block's terms and its largest
impact level. A search first scores the highest levels of its terms, which gives a score that k documents reach; then only
levels are read that can still reach it.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import search as S
from lettermill.sources.stored import discard, fresh_path, written

#: Impact levels: the weight of a posting without its term's rarity, below K1 + 1, in so many steps.
LEVELS = 64
STEP = (S.K1 + 1) / LEVELS
#: Postings from which a search looks for its least score first.
PRUNE_FROM = 50_000
#: Terms and their levels are written into the predicate up to this number; more are joined.
LITERALS = 500
#: Bytes of a row group of postings: small, since a group is what a search can skip.
ROW_GROUP = 1 << 20

SCHEMAS = {
    "versions": "doc string, seq long, op string, batch long",
    "postings": "doc string, field string, term string, tf long, len long, level int, batch long",
    "gone": "doc string, of long, batch long",
    "terms": "field string, term string, level int, n long, batch long",
    "views": "field string, docs long, words long, batch long",
    "keys": "key string, term string, batch long",
}


def batches(spark: SparkSession, path: str) -> dict[int, dict[str, float]]:
    """Batches with a manifest, and each view's mean length when they were written."""
    try:
        rows = spark.read.schema("avg map<string,double>, batch long").parquet(f"{path}/manifest").collect()  # a row a batch
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["batch"]: r["avg"] for r in rows}


def read(spark: SparkSession, path: str, table: str, among: list[int]) -> DataFrame:
    if not among:
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}").where(F.col("batch").isin(sorted(among)))


def live_versions(spark: SparkSession, path: str, among: list[int]) -> DataFrame:
    """(doc, seq, op, batch): the version with the largest seq of each document, the later batch's of equals."""
    rows = read(spark, path, "versions", among)
    return rows.groupBy("doc").agg(F.max_by(F.struct("seq", "op", "batch"), F.struct("seq", "batch")).alias("v")).select("doc", "v.*")


def _level(avg: dict[str, float]) -> Column:
    impact = _impact(F.element_at(F.create_map(*[F.lit(x) for p in avg.items() for x in p]), F.col("field")))
    return F.least(F.floor(impact / STEP), F.lit(LEVELS - 1)).cast("int")


def _impact(avg: Column) -> Column:
    return F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("len") / avg))


def _counts(posts: DataFrame) -> DataFrame:
    """(field, docs, words) of postings."""
    by_doc = posts.groupBy("field", "doc").agg(F.sum("tf").alias("words"))
    return by_doc.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"))


def add_batch(changes: DataFrame, path: str, batch: int, stop: list[str]) -> None:
    """Store a batch of changes (doc, seq, op, subject, body_delta, sender_name). The largest seq of a document counts, whenever it
    comes; an op 'delete' takes the document out. A batch number that is stored already is replaced."""
    spark = changes.sparkSession
    stage = lambda df, label: written(df, fresh_path(spark, label))
    known = batches(spark, path)
    before = [b for b in known if b < batch]
    if batch in known:  # a replay: the batch is not there until it is whole again
        spark.createDataFrame([], "avg map<string,double>").write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")

    def store(df: DataFrame, table: str, **options: str) -> None:
        df.write.mode("overwrite").options(**options).parquet(f"{path}/{table}/batch={batch}")

    columns = ["seq", "op", "subject", "body_delta", "sender_name"]
    latest = changes.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.max_by(F.struct(*columns), F.struct("seq", F.xxhash64(*columns))).alias("c")).select("doc", "c.*")
    old = live_versions(spark, path, before).toDF("doc", "old_seq", "old_op", "of")
    fresh = stage(latest.join(old, "doc", "left").where("old_seq is null or seq >= old_seq"), "fresh")
    store(fresh.select("doc", "seq", "op"), "versions")
    gone = stage(fresh.where("old_op <> 'delete'").select("doc", "of"), "gone")
    store(gone, "gone")
    base = stage(S.postings(fresh.where("op <> 'delete'"), stop, "doc", unique=True), "base")
    lost = read(spark, path, "postings", before).withColumnRenamed("batch", "of").join(gone, ["doc", "of"], "left_semi")
    lost = stage(lost, "lost")
    signed = _counts(base).unionByName(_counts(lost).select("field", (-F.col("docs")).alias("docs"), (-F.col("words")).alias("words")))
    store(signed.groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).coalesce(1), "views")
    totals = spark.read.schema(SCHEMAS["views"]).parquet(f"{path}/views").where(F.col("batch").isin([*before, batch]))
    avg = {r["field"]: r["words"] / r["docs"] for r in totals.groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect() if r["docs"]}
    posts = base.withColumn("level", _level(avg) if avg else F.lit(0))
    clustered = posts.select("doc", "field", "term", "tf", "len", "level").repartitionByRange("term", "field", F.desc("level")).sortWithinPartitions("term", "field", F.desc("level"), "doc")
    store(clustered, "postings", **{"parquet.block.size": str(ROW_GROUP)})
    one = posts.select("field", "term", "level", F.lit(1).alias("n")).unionByName(lost.select("field", "term", "level", F.lit(-1).alias("n")))
    counts = one.groupBy("field", "term", "level").agg(F.sum("n").alias("n")).where("n <> 0")
    store(counts.repartitionByRange("term").sortWithinPartitions("term"), "terms", **{"parquet.block.size": str(ROW_GROUP)})
    keys = S.keyed_terms(base.select("term").distinct())
    store(keys.repartitionByRange("key").sortWithinPartitions("key"), "keys", **{"parquet.block.size": str(ROW_GROUP)})
    discard(fresh, gone, base, lost)
    spark.createDataFrame([(avg,)], "avg map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def as_changes(index: DataFrame) -> DataFrame:
    """Rows of search.index_rows() as insertions."""
    return index.select(F.col("message_key").alias("doc"), "seq", F.lit("insert").alias("op"), "subject", "body_delta", "sender_name")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The live postings and counts of an index as the one batch -1 of another folder, deletions included as versions. Impact levels
    follow the mean lengths of now."""
    own = list(batches(spark, path))
    avg = {f: words / docs for f, (docs, words) in view_counts(spark, path, own).items()}
    posts = live_postings(spark, path, own).withColumn("level", _level(avg) if avg else F.lit(0))
    posts = posts.select("doc", "field", "term", "tf", "len", "level").repartitionByRange("term", "field", F.desc("level")).sortWithinPartitions("term", "field", F.desc("level"), "doc")
    group = {"parquet.block.size": str(ROW_GROUP)}
    posts.write.mode("overwrite").options(**group).parquet(f"{to}/postings/batch=-1")
    posts = spark.read.parquet(f"{to}/postings/batch=-1")
    live_versions(spark, path, own).select("doc", "seq", "op").write.mode("overwrite").parquet(f"{to}/versions/batch=-1")
    read(spark, path, "gone", []).drop("batch").write.mode("overwrite").parquet(f"{to}/gone/batch=-1")
    posts.groupBy("field", "term", "level").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").options(**group).parquet(f"{to}/terms/batch=-1")
    _counts(posts).write.mode("overwrite").parquet(f"{to}/views/batch=-1")
    S.keyed_terms(posts.select("term").distinct()).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").options(**group).parquet(f"{to}/keys/batch=-1")
    spark.createDataFrame([(avg,)], "avg map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{to}/manifest/batch=-1")


def view_counts(spark: SparkSession, path: str, among: list[int]) -> dict[str, tuple[int, int]]:
    """(documents, words) of each view: a row a view and batch is read."""
    rows = read(spark, path, "views", among).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).where("docs > 0").collect()
    return {r["field"]: (r["docs"], r["words"]) for r in rows}


def live_postings(spark: SparkSession, path: str, among: list[int], where: Column | None = None) -> DataFrame:
    """Postings but those of versions that a later batch replaced."""
    posts = read(spark, path, "postings", among)
    posts = posts if where is None else posts.where(where)
    gone = read(spark, path, "gone", among).select("doc", F.col("of").alias("batch"))
    return posts.join(gone, ["doc", "batch"], "left_anti") if len(among) > 1 else posts


def query_terms(spark: SparkSession, path: str, among: list[int], text: str, stop: list[str], fuzzy: bool) -> dict[str, list[str]]:
    """The index terms that a query asks for, by kind of view: its own, and with fuzzy their near ones."""
    asked = S.analyse(spark, text, stop)
    every = sorted({*asked["main"], *asked["ascii"]})
    if not fuzzy or not every:
        return asked
    keys = read(spark, path, "keys", among).select("key", "term")
    near = S.fuzzy_terms(keys, every, keys=keys).collect()  # neighbours of a few words
    return {kind: sorted({r["term"] for r in near if r["query_term"] in own}) for kind, own in asked.items()}


def _cuts(levels: dict[tuple[str, str], dict[int, int]], gain: dict[tuple[str, str], float], least: float, stretch: dict[str, float]) -> dict[tuple[str, str], int]:
    """The lowest level of each (view, term) whose postings can be part of a view's score of `least`: what the level gives at most
    and the best levels of the view's other terms together."""
    top = {key: gain[key] * (max(n) + 1) * STEP * stretch[key[0]] for key, n in levels.items()}
    whole: dict[str, float] = {}
    for (field, _), best in top.items():
        whole[field] = whole.get(field, 0.0) + best
    out = {}
    for key, n in levels.items():
        need = (least - (whole[key[0]] - top[key])) / (gain[key] * STEP * stretch[key[0]]) - 1
        lowest = max(0, math.ceil(need - 1e-9))
        if lowest <= max(n):
            out[key] = lowest
    return out


def _among(spark: SparkSession, posts: DataFrame, cuts: dict[tuple[str, str], int]) -> DataFrame:
    """Postings of the (view, term) in cuts from their level on. The terms and the lowest level reach the scan."""
    if not cuts:
        return posts.limit(0)
    if len(cuts) > LITERALS:
        table = spark.createDataFrame([(f, t, n) for (f, t), n in cuts.items()], "field string, term string, lowest int")
        return posts.join(F.broadcast(table), ["field", "term"]).where("level >= lowest").drop("lowest")  # the query's terms
    by: dict[tuple[str, int], list[str]] = {}
    for (field, term), lowest in cuts.items():
        by.setdefault((field, lowest), []).append(term)
    either = None
    for (field, lowest), terms in sorted(by.items()):
        one = (F.col("field") == field) & F.col("term").isin(sorted(terms)) & (F.col("level") >= lowest)
        either = one if either is None else either | one
    return posts.where(F.col("term").isin(sorted({t for _, t in cuts})) & (F.col("level") >= min(cuts.values())) & either)


def rank(spark: SparkSession, path: str, query: str, stop: list[str], k: int = 10, fuzzy: bool = True, index: DataFrame | None = None, where: Column | None = None, weights: dict[str, float] = S.WEIGHTS) -> DataFrame:
    """(doc, score) of the k best documents of a stored index, as search.rank_text() gives them: BM25 of each view times its weight,
    the best view counts, ties by document. A filter `where` over index (message_key, ...) does not change scores.

    The vocabulary's part that is near the query, the counts of its terms, then postings are read, each by a predicate on the
    column that its table is clustered by.
    """
    own = batches(spark, path)
    among = list(own)
    terms = query_terms(spark, path, among, query, stop, fuzzy)
    every = sorted({*terms["main"], *terms["ascii"]})
    empty = spark.createDataFrame([], "doc string, score double")
    if not every:
        return empty
    views = view_counts(spark, path, among)
    ascii_view = F.col("field").endswith(".ascii")
    stored = read(spark, path, "terms", among).where(F.col("term").isin(every)).where(F.when(ascii_view, F.col("term").isin(terms["ascii"])).otherwise(F.col("term").isin(terms["main"])))
    levels: dict[tuple[str, str], dict[int, int]] = {}
    for r in stored.groupBy("field", "term", "level").agg(F.sum("n").alias("n")).where("n > 0").collect():  # LEVELS rows a term and view
        levels.setdefault((r["field"], r["term"]), {})[r["level"]] = r["n"]
    levels = {key: n for key, n in levels.items() if key[0] in views and key[0] in weights}
    if not levels:
        return empty
    df = {key: sum(n.values()) for key, n in levels.items()}
    idf = {(f, t): math.log(1 + (views[f][0] - n + 0.5) / (n + 0.5)) for (f, t), n in df.items()}
    gain = {key: idf[key] * weights[key[0]] for key in levels}
    avg = {f: words / docs for f, (docs, words) in views.items()}
    # levels were made with the mean lengths of their time; a longer mean since lets an impact grow by their ratio at most
    stretch = {f: max([1.0, *(avg[f] / then[f] for then in own.values() if f in then)]) for f in avg}
    facts = spark.createDataFrame([(f, t, df[f, t], views[f][0], avg[f], weights[f]) for f, t in levels], "field string, term string, df long, docs long, avg_len double, boost double")

    def scored(cuts: dict[tuple[str, str], int]) -> DataFrame:
        hits = _among(spark, live_postings(spark, path, among, F.col("term").isin(every) if len(every) <= LITERALS else None), cuts)
        if where is not None:
            hits = hits.join(index.where(where).select(F.col("message_key").alias("doc")), "doc", "left_semi")
        rows = hits.join(F.broadcast(facts), ["field", "term"])  # a row a view and term
        rarity = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        per_view = rows.groupBy("doc", "field").agg(F.sum(rarity * _impact(F.col("avg_len")) * F.col("boost")).alias("s"))
        return per_view.groupBy("doc").agg(F.round(F.max("s"), 6).alias("score")).orderBy(F.desc("score"), "doc").limit(k)

    cuts = dict.fromkeys(levels, 0)
    if sum(df.values()) > PRUNE_FROM:
        head = {}
        for key, n in levels.items():
            seen = 0
            for level in sorted(n, reverse=True):
                head[key] = level
                seen += n[level]
                if seen >= k:
                    break
        best = [r["score"] for r in scored(head).collect()]  # k rows; a part of a score is never more than the score
        if len(best) == k:
            cuts = _cuts(levels, gain, best[-1] - 2e-6, stretch)
    return scored(cuts)
