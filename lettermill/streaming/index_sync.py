"""The search index kept in step with a change stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.functions import text as X
from lettermill.operators import ranked_index

CHANGE = "id string, seq long, op string, subject string, body string"


def change_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Change events from files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The change with the largest seq of each id: an aggregate, so the many changes of one id meet before the exchange."""
    return changes.groupBy("id").agg(F.max_by(F.struct(*changes.columns), "seq").alias("c")).select("c.*")


def live(index: DataFrame) -> DataFrame:
    """Index rows without tombstones."""
    return index.where("op <> 'delete'")


def apply_changes(changes: DataFrame, path: str, batch: int) -> None:
    """Store a batch's latest changes in a folder of its own. Nothing stored is read or rewritten, so a batch costs what it
    holds; one that is replayed after a failure takes its own place."""
    latest_changes(changes).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_index(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Index rows (id, seq, op, ...) after all stored batches. The largest seq of an id wins, whenever it arrived; a delete stays
    as a tombstone, so an older change that comes late cannot bring the row back. Without a batch there are none."""
    try:
        rows = spark.read.schema(schema).parquet(path).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return latest_changes(rows)


def compact_index(spark: SparkSession, path: str, to: str, schema: str | T.StructType) -> None:
    """The index as one batch of another folder, tombstones included; later batches may go on there."""
    read_index(spark, path, schema).write.mode("overwrite").parquet(f"{to}/batch=-1")


def sync_index(changes: DataFrame, index_path: str, checkpoint: str):
    """Start the sync over what has arrived; a later start with the same checkpoint goes on after the last batch."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: apply_changes(df, index_path, batch)).start()


def sync_ranked(changes: DataFrame, path: str, checkpoint: str, stop: list[str]):
    """Start the sync of a ranked index with changes (id, seq, op, subject, body, sender_name): each batch derives the searchable
    rows anew and adds its postings, tombstones and counts (see ranked_index). A batch that is replayed takes its own place."""
    rows = changes.select(F.col("id").alias("doc"), "seq", "op", "subject", X.best_text(F.col("body")).alias("body_delta"), "sender_name")
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: ranked_index.add_batch(df, path, batch, stop)).start()


def tail_logs(logs: DataFrame, level: str | None = None, since=None, until=None, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Live log rows of a level, and of a range of event time (since included, until excluded). With a range the stream has a watermark,
    so that counts by time over it end; rows that come later than `late` are still shown."""
    rows = logs if level is None else logs.where(F.col("level") == level)
    if since is not None:
        rows = rows.where(F.col(time_col) >= F.lit(since).cast(logs.schema[time_col].dataType))
    if until is not None:
        rows = rows.where(F.col(time_col) < F.lit(until).cast(logs.schema[time_col].dataType))
    if since is None and until is None:
        return rows
    # a watermark needs a time with zone: one without counts in the session's
    return rows.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def observed(stream: DataFrame, name: str = "progress") -> DataFrame:
    """A stream that counts its rows; see lastProgress.observedMetrics."""
    return stream.observe(name, F.count(F.lit(1)).alias("processed"))
