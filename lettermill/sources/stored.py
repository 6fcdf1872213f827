"""Tables that a job writes once to read them several times."""

from __future__ import annotations

import tempfile
import uuid
import warnings
import weakref

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where that is unset, a local session gets a new
    folder for this application; any other is an error, since its executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dirs.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='lettermill-')}"
        _own_dirs[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """df written to path as Parquet and read back."""
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stored(df: DataFrame, label: str, cluster_by: str | None = None) -> DataFrame:
    """df written as Parquet and read back, sorted by a column if later filters are on it, so that they skip row groups."""
    out = df if cluster_by is None else df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    return written(out, fresh_path(df.sparkSession, label))


def hand_over(frame: DataFrame, to: DataFrame) -> None:
    """From now on discard(to) deletes the table of frame, which `to` reads."""
    path = _paths.pop(frame, None)
    if path is not None:
        _paths[to] = path


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables from stored() that nothing will read any more; other frames are left alone. Where the
    folder's file system has no driver here, the files stay."""
    for frame in frames:
        path = _paths.pop(frame, None)
        if path is not None:
            try:
                where, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                where.delete_dir(base)
            except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                warnings.warn(f"{path} is left: {e}", stacklevel=2)
