"""Dead letters, logs, stage counters and the staged run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query_logs(logs: DataFrame, level: str | None = None, first: str | None = None, last: str | None = None, descending: bool = True, limit: int = 300) -> DataFrame:
    """Log rows of a level between two times, both included."""
    out = logs
    if level:
        out = out.where(F.col("level") == level)
    if first:
        out = out.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        out = out.where(F.col("ts") <= F.lit(last).cast("timestamp_ntz"))
    return out.orderBy(F.desc("ts") if descending else F.asc("ts"), "seq").limit(limit)


def filter_failures(failures: DataFrame, failure_type: str | None = None, resolved: bool | None = None) -> DataFrame:
    out = failures
    if failure_type:
        out = out.where(F.col("failure_type") == failure_type)
    return out if resolved is None else out.where(F.col("resolved") == F.lit(resolved))


def failed_email_ids(failures: DataFrame) -> DataFrame:
    """Mails with unresolved failures, once each."""
    return failures.where("not resolved").select("email_id").distinct()


def retry_failures(failures: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Dead letters after a retry: unresolved ones whose id is in succeeded are resolved, the others count a retry more."""
    ok = succeeded.select("id").distinct().withColumn("_ok", F.lit(True))
    done = F.col("_ok").isNotNull()
    out = failures.join(ok, "id", "left")
    return out.select(
        "id", "email_id", "failure_type",
        (F.col("resolved") | done).alias("resolved"),
        F.when(F.col("resolved") | done, F.col("retry_count")).otherwise(F.col("retry_count") + 1).alias("retry_count"),
    )


def stage_metrics(spark: SparkSession, rows: list[tuple[str, str, int, int, int, float]]) -> DataFrame:
    """Counters of stages (name, state, total, processed, failed, seconds) with percent (floor), rate a minute and seconds left."""
    df = spark.createDataFrame(rows, "name string, state string, total long, processed long, failed long, seconds double")
    done = F.col("processed") + F.col("failed")
    rate = F.when(F.col("seconds") > 0, done * 60 / F.col("seconds"))
    return df.withColumns(
        {
            "percent": F.when(F.col("total") > 0, F.floor(done * 100 / F.col("total"))).otherwise(F.lit(0)),
            "rate_per_minute": F.coalesce(rate, F.lit(0.0)),
            "eta_seconds": F.when(rate > 0, F.ceil((F.col("total") - done) * 60 / rate)),
        }
    )


def run_pipeline(stages: list[tuple[str, Callable[[], int]]], skip: set[str] = frozenset()) -> list[tuple[str, str, int, int, int, float]]:
    """Run stages in order; each returns the rows it processed. A failing stage stops the run: it is FAILED, later ones stay
    PENDING. Returns rows for stage_metrics."""
    out, stopped = [], False
    for name, stage in stages:
        if name in skip:
            out.append((name, "SKIPPED", 0, 0, 0, 0.0))
            continue
        if stopped:
            out.append((name, "PENDING", 0, 0, 0, 0.0))
            continue
        began = time.time()
        try:
            n = stage()
            out.append((name, "DONE", n, n, 0, time.time() - began))
        except Exception:  # noqa: BLE001  the state of the run is the result
            stopped = True
            out.append((name, "FAILED", 0, 0, 1, time.time() - began))
    return out
