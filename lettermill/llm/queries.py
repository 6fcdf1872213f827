"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, centroids, chat, decontam, embedding_dedup, oracles, packing, quality, secret_scan, simhash, token_output, toxicity, warc, whitening


def _rest(mod: int):
    return F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(mod))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from labelled rows whose remainder is not 2."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, _rest(4) != 2)
    return toxicity.score_toxicity(docs, model).select(F.col("id").alias("doc_id"), (_rest(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from labelled rows whose remainder is not 1."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, _rest(3) != 1)
    return quality.score_quality(docs, model).select(F.col("id").alias("doc_id"), (_rest(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.simhash_components(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False, control=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride shards in training order, read back from the shards."""
    out = token_output.materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), control=True)
    return out.select("doc_id", "start", "length", "slot", "offset", "shard", F.crc32("ids").alias("ids_crc32"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    out = embedding_dedup.link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    rows = secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("all_spans")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, read back from the archives."""
    out = warc.deduplicate(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A conversation whose texts hold the template's own control strings.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted with loss masks, read back from the output."""
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document overlaps with."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.flagged(docs, items).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading components of all embeddings, whitened."""
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary), vocabulary)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after five rounds from forty vectors."""
    out = centroids.cluster_report(*centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return out.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_packing, op3_quality, op4_token_output, op5_embedding_dedup, op6_secret_scan, op7_simhash, op8_warc, op9_chat, op10_decontam, op11_whitening, op12_byte_bpe, op13_centroids)
}

#: SQL, where it can express the query.
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
