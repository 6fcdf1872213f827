"""Pieces that several training-data operators share: staged tables, bounded bucket joins, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.sources.stored import discard, fresh_path, hand_over, written

#: Rows of one bucket that one task compares with each other at once; larger buckets are cut into blocks of this size.
BLOCK_ROWS = 1024


#: Rows of whole texts that travel to Python at once while a table is staged; batches also end at Spark's own limit of bytes.
TEXT_ROWS = 1500


def staged(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.
    discard() deletes it when nothing reads it any more. The session's settings are as before afterwards."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name, None)
    few = before is None or not 0 < int(before) <= TEXT_ROWS
    if few:
        conf.set(name, str(TEXT_ROWS))
    try:
        return written(df, fresh_path(df.sparkSession, label), codec)
    finally:
        if few:
            conf.unset(name) if before is None else conf.set(name, before)


def release_memory() -> None:
    """Give a finished task's memory back to the system: Python workers are kept for later tasks of other stages, and what each
    stage leaves to the allocators would add up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType) -> DataFrame:
    """Arrow batches through a function that each task builds once with make()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out
        del step
        release_memory()

    return df.mapInArrow(run, schema)


def blocked(rows: DataFrame, bucket: list[str], member: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of the buckets with two members or more, dealt so that one group of (bucket, lo, hi) holds about 2 * block_rows
    rows at most and any two members of a bucket meet in a group. Adds own (block of the row), lo and hi (blocks compared).

    Bucket sizes are counted with map-side partial sums; the inner join that brings them back may be split where a bucket
    is hot, and every larger bucket becomes a triangle of block pairs, so no bucket is ever gathered in one task.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return dealt(rows.join(sizes, bucket), bucket, member, "_n", block_rows)


def dealt(rows: DataFrame, bucket: list[str], member: Column, size_col: str, block_rows: int | None = None) -> DataFrame:
    """blocked() of rows that already have their bucket's size in size_col, which is dropped."""
    block_rows = BLOCK_ROWS if block_rows is None else block_rows
    many = F.ceil(F.col(size_col) / F.lit(block_rows)).cast("int")
    out = (
        rows.withColumn("own", F.when(F.col(size_col) <= block_rows, F.lit(0)).otherwise(F.pmod(F.xxhash64(member), many).cast("int")))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), many - 1)))
        .withColumn("lo", F.least("own", "_x"))
        .withColumn("hi", F.greatest("own", "_x"))
        .drop(size_col, "_x")
    )
    keys = [*bucket, "lo", "hi"]
    return out.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches again as tables that never cut a group of equal keys; a group is bounded by blocked()."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = {k: table[k][-1] for k in keys}
        same = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            same &= table[k].to_numpy() == last[k].as_py()
        cut = table.num_rows - int(same.sum())
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def group_ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each run of equal keys in a sorted table."""
    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def paired(group: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) of rows in one group, by growing d; in a pair of different blocks only those across."""
    n = len(group)
    i = np.arange(n - 1)
    d = 1
    while len(i):
        i = i[i + d < n]
        i = i[group[i] == group[i + d]]
        if len(i):
            keep = (lo[i] == hi[i]) | (own[i] != own[i + d])
            yield i[keep], i[keep] + d
        d += 1


def smallest_linked(a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the smallest node that links between rows a[i] and b[i] lead to, its own included."""
    label = node.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if np.array_equal(new, label):
            return label
        label = new


def spanning(a: np.ndarray, b: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows a[i] and b[i] as a star for each group of linked rows: (node, smallest linked node), so that a
    dense group leaves a task as one link a row."""
    label = smallest_linked(a, b, node)
    touched = np.unique(np.concatenate([a, b]))
    touched = touched[label[touched] != node[touched]]
    return node[touched], label[touched]


#: Links that a task of contracted() joins at once.
LINK_ROWS = 1 << 20


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def out():
        a, b = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = spanning(at[: len(a)], at[len(a) :], node)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LINK_ROWS:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links that join the same nodes as links (a long, b long). A node of a dense group has a star from nearly every
    task; the stars of a node meet in one task, which gives one link for each node that it reads."""
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.repartition("a").mapInArrow(_joiner, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): a row (node, root) for each node that is not the smallest of its
    component; root is the smallest. Alternating large-star and small-star steps, each a few joins and partial
    aggregations; every step is written to the shared folder. No nulls may be in links; an empty table gives an empty one.
    """
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = staged(links.select(hi, lo).where("a <> b").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            hand_over(edges, out)  # discard() of the result deletes the table
            return out
        before, old = mark, edges
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        large = staged(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(old, large)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, rows: dict[int, int], chars: dict[int, int]) -> tuple[list[str], list[int]]:
    """Whole texts and labels of a bounded sample: at most rows[y] documents and chars[y] characters of label y, by the order
    of a hash of the id, among the documents where `learn` (over a column id) holds.

    Ids and lengths choose the sample; only its texts are collected, and only its ids, rows[0] + rows[1] at most, are
    broadcast. A document that is labelled twice counts with the larger label, one that is there twice with its smallest
    text; null ids and labels other than 0 and 1 do not count.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(learn & F.col("id").isNotNull())
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = named.groupBy("id").agg(F.min(F.char_length("text")).alias("n"))
    pool = staged(sizes.join(marked, "id"), "labelled")
    chosen: list[tuple[int, int]] = []
    for y in (0, 1):
        left = chars[y]
        for r in pool.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows[y]).collect():
            if r["n"] <= left:
                left -= r["n"]
                chosen.append((r["id"], y))
    discard(pool)
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame(chosen, "id long, y int")
    found = named.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min(F.struct(F.char_length("text").alias("n"), "text")).alias("m")).select("id", "m.text")
    picked = {r["id"]: r["text"] for r in found.collect()}
    return [picked[i] for i, _ in chosen], [y for _, y in chosen]
