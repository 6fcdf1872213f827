"""Centroid clustering by dimension-sharded Lloyd rounds on whole-number vectors.

Vectors lie in chunks of rows, each chunk cut into blocks of columns. A task of the assigning step reads blocks and the slice
of the centroids over their columns, and gives the exact partial squared distances of the block's rows; the partial sums of a
chunk's blocks are added by key and the nearest centroid is taken. In the updating step a block meets its chunk's
assignment, and each column shard sums and replaces its own slice. Whole centroids never meet in one place but for their digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import discard, staged
from lettermill.llm.vectors import matrix, whole_vectors

DIMS, CENTROIDS, ROUNDS = 64, 40, 5
#: Columns of a block and rows of a chunk.
COLUMNS, ROWS = 16, 1024
#: Largest component: 64 squared differences add up without overflow.
LARGEST = 1 << 26
#: Numbers of all centroids together up to which their slices are broadcast, about 40 MB.
BROADCAST_NUMBERS = 1 << 20


def _chunker(dims: int):
    """Rows in chunks: a block of columns each, and one row (shard -1) that holds their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(1), dims)
                if len(x) and max(-int(x.min()), int(x.max())) >= LARGEST:
                    raise ValueError(f"components must be below {LARGEST} once scaled")
                blocks = [np.ascontiguousarray(x[:, c : c + COLUMNS]).astype("<i4").tobytes() for c in range(0, dims, COLUMNS)]
                n = len(blocks) + 1
                chunk = pa.array([(task << 32) + seen] * n, pa.int64())
                ids = pa.array([part.column(0).to_pylist(), *[None] * len(blocks)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([chunk, pa.array(range(-1, len(blocks)), pa.int32()), ids, pa.array([None, *blocks], pa.binary())], names=["chunk", "shard", "ids", "x"])
                seen += 1

    return run


def _width(dims: int, shard: int) -> int:
    return min(COLUMNS, dims - shard * COLUMNS)


def _partial(dims: int, k: int):
    """Partial squared distances of a block's rows to all slices, four bytes each where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                shard = get["shard"][i].as_py()
                c = np.array([v["value"] for v in get["slice"][i].as_py()], dtype=np.int64).reshape(k, _width(dims, shard))
                x = np.frombuffer(get["x"][i].as_py(), dtype="<i4").reshape(-1, c.shape[1]).astype(np.int64)
                d = np.zeros((len(x), k), dtype=np.int64)
                for j in range(c.shape[1]):
                    d += np.square(x[:, j, None] - c[None, :, j])
                small = d.max(initial=0) < 2**31
                yield pa.RecordBatch.from_arrays([get["chunk"].slice(i, 1), pa.array([small]), pa.array([d.astype("<i4" if small else "<i8").tobytes()], pa.binary())], names=["chunk", "small", "part"])

    return run


def _nearest(k: int):
    """Adds a chunk's blocks and takes the nearest centroid, the smallest number of equals."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), dtype="<i4" if s.as_py() else "<i8").reshape(-1, k).astype(np.int64) for p, s in zip(table["part"], table["small"], strict=True))
        best = total.argmin(axis=1)
        least = total[np.arange(len(total)), best]
        return pa.table({"chunk": table["chunk"].slice(0, 1), "cluster": pa.array([best.astype("<i4").tobytes()], pa.binary()), "distance": pa.array([least.astype("<i8").tobytes()], pa.binary())})

    return run


def _slice_sums(dims: int, k: int):
    """Sums and counts by (shard, cluster, column) of all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                shard, cluster = get["shard"][i].as_py(), np.frombuffer(get["cluster"][i].as_py(), dtype="<i4")
                x = np.frombuffer(get["x"][i].as_py(), dtype="<i4").reshape(len(cluster), -1).astype(np.int64)
                total = sums.setdefault(shard, np.zeros((k, _width(dims, shard)), dtype=np.int64))
                np.add.at(total, cluster, x)
                counts.setdefault(shard, np.zeros(k, dtype=np.int64))
                counts[shard] += np.bincount(cluster, minlength=k)
        for shard, total in sums.items():
            c, j = np.divmod(np.arange(total.size), total.shape[1])
            some = counts[shard][c] > 0
            columns = [np.full(some.sum(), shard, dtype=np.int32), c[some].astype(np.int32), j[some].astype(np.int32), total.ravel()[some], counts[shard][c][some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "cluster", "column", "s", "n"])

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            cluster, distance = np.frombuffer(get["cluster"][i].as_py(), dtype="<i4"), np.frombuffer(get["distance"][i].as_py(), dtype="<i8")
            yield pa.RecordBatch.from_arrays([get["ids"][i].values, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centroids as rows (shard, cluster, column, value)."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[i].as_py(), dtype="<i8")
            at = np.arange(len(x))
            yield pa.RecordBatch.from_arrays([pa.array((at // COLUMNS).astype(np.int32)), pa.array(np.full(len(x), batch.column(0)[i].as_py(), dtype=np.int32)), pa.array((at % COLUMNS).astype(np.int32)), pa.array(x)], names=["shard", "cluster", "column", "value"])


NUMBERS = "shard int, cluster int, column int, value long"


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, cluster, distance) for each vector with exactly dims components, none null or non-finite, each taken as
    floor(256 * component); and the final centroids (shard, cluster, column, value), their columns counted within a shard.

    Centroids start as the k vectors with the smallest SHA-256 of `<seed>:<id>`; vectors with equal ids come by their numbers, those
    without an id last. A round assigns every vector to the nearest centroid (squared Euclidean distance, the smaller number of
    equals), then moves each centroid that has vectors to the exact floor of their mean. After the rounds vectors are assigned once
    more. With fewer than k vectors there are fewer centroids; without any both tables are empty. All arithmetic is in whole
    numbers; scaled components of 2 ** 26 or more are an error. Null and repeated ids stay; other columns are ignored.

    Each step is written to the shared folder. Partial distances (rows x centroids a shard) and the blocks are shuffled by chunk,
    so no key is hot; sums are added within tasks before they are shuffled.
    """
    whole = staged(whole_vectors(vectors, id_col, vector_col, dims), "whole")
    named = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    first = named.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()  # k vectors, a parameter
    spark = whole.sparkSession
    empty = spark.createDataFrame([], "id long, cluster int, distance long")
    if not first:
        return empty, spark.createDataFrame([], NUMBERS)
    k = len(first)
    blocks = staged(whole.mapInArrow(_chunker(dims), "chunk long, shard int, ids array<long>, x binary").repartitionByRange("shard", "chunk"), "blocks")
    discard(whole)
    columns = blocks.where("shard >= 0").select("chunk", "shard", "x")
    start = spark.createDataFrame([(i, bytes(r["x"])) for i, r in enumerate(first)], "cluster int, x binary")
    centres = staged(start.mapInArrow(_starts, NUMBERS), "centres")

    def assign() -> DataFrame:
        slices = centres.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("cluster", "column", "value"))).alias("slice"))
        slices = F.broadcast(slices) if k * dims <= BROADCAST_NUMBERS else slices
        partial = columns.join(slices, "shard").mapInArrow(_partial(dims, k), "chunk long, small boolean, part binary")
        return staged(partial.groupBy("chunk").applyInArrow(_nearest(k), "chunk long, cluster binary, distance binary"), "assigned")

    for _ in range(rounds):
        assigned, old = assign(), centres
        sums = columns.join(assigned.select("chunk", "cluster"), "chunk").mapInArrow(_slice_sums(dims, k), "shard int, cluster int, column int, s long, n long")
        means = sums.groupBy("shard", "cluster", "column").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select("shard", "cluster", "column", F.expr("(s - pmod(s, n)) div n").alias("mean"))
        centres = staged(old.join(means, ["shard", "cluster", "column"], "left").select("shard", "cluster", "column", F.coalesce("mean", "value").alias("value")), "centres")
        discard(assigned, old)
    assigned = assign()
    told = staged(blocks.where("shard = -1").select("chunk", "ids").join(assigned, "chunk").mapInArrow(_told, "id long, cluster int, distance long"), "clusters")
    discard(blocks, assigned)
    return told, centres


def cluster_report(told: DataFrame, centres: DataFrame) -> DataFrame:
    """told with cluster_inertia and inertia (sums of distances over its cluster and over all) and the digest of its centroid:
    SHA-256 of the components, comma-joined. What is joined has a row a centroid."""
    digest = centres.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("shard", "column", "value"))).alias("v"))
    digest = digest.select("cluster", F.sha2(F.array_join(F.transform("v", lambda v: v["value"].cast("string")), ","), 256).alias("centroid_sha256"))
    own = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia")).first()[0]
    return told.join(F.broadcast(own.join(digest, "cluster")), "cluster").select("id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
