"""Token ids in training order: fixed-stride binary shards.

The ids of a task's documents, each with its end id, are one stream that is cut into sequences of SEQUENCE ids; only a
task's last sequence is padded. Sequences are numbered without gaps in the order of the written pieces; a keyed Feistel
network permutes these numbers, walking the cycle while it leaves the range, so each sequence has a slot of its own in the
training order without any sort of the whole. A range of slots is a shard: a file of ids of one stride, so the ids of any
slot are found by arithmetic and a reader may go on anywhere. Beside each shard lies an index of what its sequences hold.

Ids travel in blobs of many sequences, compressed once a blob, both in the staged table and in the shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.common import discard, fresh_path, staged
from lettermill.llm.packing import CONTROL, default_vocabulary, load_encoder

SEQUENCE = 512
END_ID = 1
PAD_ID = 0
#: Sequences of a shard.
SHARD_RECORDS = 8192
KEY = 20_240_117
ROUNDS = 6
#: Sequences of a staged blob, and staged blobs that are dealt to shards together.
BLOB_RECORDS, BLOBS_AT_ONCE = 512, 32
LEVEL = 7
#: Sequences that a reader takes at once, and how many such chunks a task reads.
CHUNK, CHUNKS_A_TASK = 2048, 8
#: What a place in a sequence begins: a document's ids from `start` on, of a null id (flag 1), or padding (flag 2). What an entry
#: covers ends where the sequence's next one begins.
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("offset", "<u2"), ("flags", "u1")])
#: An entry with its sequence's place in a blob.
LOOSE = np.dtype([("record", "<u4"), *((n, ENTRY[n]) for n in ENTRY.names)])
NULL_ID, PADDING = 1, 2


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, at x. Halves of equal width cover at most 4 n numbers; what falls outside the range
    is permuted again until it falls inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, ROUNDS, dtype=np.uint64) | np.uint64(1)
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
            mixed *= k
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ (mixed & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _entries(ends: np.ndarray, docs: pa.Array, sequence: int) -> np.ndarray:
    """Entries of documents that end at the places ends[1:] of the stream, the first one beginning at ends[0]."""
    first, last = ends[:-1] // sequence, (ends[1:] - 1) // sequence
    n = last - first + 1
    doc = np.repeat(np.arange(len(n)), n)
    record = first[doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.maximum(ends[:-1][doc], record * sequence)
    out = np.zeros(len(doc), dtype=[("record", "<i8"), *((c, ENTRY[c]) for c in ENTRY.names)])
    out["record"], out["offset"], out["start"] = record, at - record * sequence, at - ends[:-1][doc]
    out["doc_id"] = docs.fill_null(0).to_numpy(zero_copy_only=False)[doc]
    out["flags"] = docs.is_null().to_numpy(zero_copy_only=False)[doc] * NULL_ID
    return out


def _cutter(vocabulary: str, sequence: int, end_id: int, control: bool):
    names = ["part", "place", "records", "ids", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, allowed = load_encoder(vocabulary, control).encode_to_numpy, set(CONTROL) if control else set()
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        part = TaskContext.get().partitionId()
        place, end = 0, 0  # sequences given out, and where the stream ends
        ids: list[np.ndarray] = []
        entries: list[np.ndarray] = []
        fresh: list[tuple[int, object]] = []  # documents whose entries are to be made

        def made() -> None:
            if fresh:
                ends = np.cumsum([end - sum(n for n, _ in fresh), *(n for n, _ in fresh)])
                entries.append(_entries(ends, pa.array([d for _, d in fresh], pa.int64()), sequence))
                fresh.clear()

        def blobs(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal place, ids, entries
            made()
            stream = np.concatenate(ids)
            told = np.concatenate(entries)
            count = len(stream) // sequence
            if not whole:
                count -= count % BLOB_RECORDS
            if whole and len(stream) % sequence:
                pad = np.zeros(1, dtype=told.dtype)
                pad["record"], pad["offset"], pad["flags"] = place + count, len(stream) % sequence, PADDING
                told, count = np.concatenate([told, pad]), count + 1
                stream = np.concatenate([stream, np.full(count * sequence - len(stream), PAD_ID, dtype="<u2")])
            for i in range(0, count, BLOB_RECORDS):
                k = min(BLOB_RECORDS, count - i)
                lo, hi = np.searchsorted(told["record"], [place + i, place + i + k])
                loose = np.zeros(hi - lo, dtype=LOOSE)
                for c in ENTRY.names:
                    loose[c] = told[c][lo:hi]
                loose["record"] = told["record"][lo:hi] - place - i
                row = (part, place + i, k, pack(stream[i * sequence : (i + k) * sequence].tobytes()), pack(loose.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)
            place += count
            ids, entries = [stream[count * sequence :]], [told[np.searchsorted(told["record"], place) :]]

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                got = encode(text.as_py() or "", allowed_special=allowed, disallowed_special=())
                if len(got) and got.max() > 0xFFFF:
                    raise ValueError("16-bit ids are below 65536")
                ids.append(np.append(got, end_id).astype("<u2"))
                end += len(got) + 1
                fresh.append((len(got) + 1, doc.as_py()))
                if end - place * sequence >= BLOB_RECORDS * sequence:
                    yield from blobs(False)
        if end > place * sequence:
            yield from blobs(True)

    return run


def cut_sequences(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", control: bool = False) -> DataFrame:
    """(part, place, records, ids, entries): blobs of sequences, place counting the sequences of a task before them; ids are 16-bit
    numbers, entries LOOSE records, both compressed with zstd. Must be written before use, since part and place hold for one
    run only. A null text is empty and gives the end_id alone, null ids stay null. `control` as in packing.cut_documents."""
    if not 0 < sequence < 1 << 16:
        raise ValueError("offsets are 16-bit numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cutter(vocabulary or default_vocabulary(), sequence, end_id, control), "part long, place long, records long, ids binary, entries binary")


def _dealer(n: int, key: int, sequence: int, shard_records: int, shared):
    """Blobs with sequences of one shard each: (shard, slots, ids, entries). shared: the first number of each part, eight bytes
    a task of the cutting pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, BLOBS_AT_ONCE):
                rows = batch.slice(at, BLOBS_AT_ONCE).to_pylist()
                ids = np.concatenate([np.frombuffer(unpack(r["ids"]), dtype="<u2") for r in rows]).reshape(-1, sequence)
                before = np.cumsum([0, *(r["records"] for r in rows)])
                loose = [np.frombuffer(unpack(r["entries"]), dtype=LOOSE) for r in rows]
                number = np.concatenate([first[r["part"]] + r["place"] + np.arange(r["records"]) for r in rows])
                owner = np.concatenate([e["record"].astype(np.int64) + b for e, b in zip(loose, before, strict=False)])
                loose = np.concatenate(loose)
                slot = feistel(number, n, key)
                order = np.argsort(slot)
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                by = np.argsort(place[owner], kind="stable")
                loose, owner = loose[by], place[owner][by]
                slot, ids = slot[order], ids[order]
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(slot // shard_records) > 0, [True]]))
                out = []
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    x, y = np.searchsorted(owner, [lo, hi])
                    mine = loose[x:y].copy()
                    mine["record"] = owner[x:y] - lo
                    out.append((int(slot[lo]) // shard_records, slot[lo:hi].tobytes(), pack(ids[lo:hi].tobytes()), pack(mine.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "slots", "ids", "entries"])

    return run


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(where, base: str, name: str, *parts: bytes) -> None:
    """A file under a name of its own, then moved into place: a task that runs twice leaves the same file."""
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    where.move(own, f"{base}/{name}")


def _writer(path: str, n: int, sequence: int, shard_records: int):
    """Write each shard of the rows sorted by shard, and its index: how many entries come before each sequence, then the entries.
    A task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(path)
        where.create_dir(base, recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress
        shard, ids, filled, loose = -1, np.zeros(0, dtype="<u2"), np.zeros(0, dtype=bool), []

        def flush() -> list[tuple]:
            if shard < 0:
                return []
            if not filled.all():
                raise ValueError(f"shard {shard} lacks {(~filled).sum()} sequences")
            entries = np.concatenate(loose)
            entries = entries[np.lexsort((entries["offset"], entries["record"]))]
            before = np.searchsorted(entries["record"], np.arange(len(ids) + 1)).astype("<u4")
            told = np.zeros(len(entries), dtype=ENTRY)
            for c in ENTRY.names:
                told[c] = entries[c]
            name = f"shard-{shard:08d}.bin"
            _write(where, base, f"{name}.idx", before.tobytes(), told.tobytes())
            _write(where, base, name, ids.tobytes())
            return [(shard, name, len(ids))]

        for batch in batches:
            done: list[tuple] = []
            for own, slots, packed, packed_entries in zip(*(batch.column(i) for i in range(4)), strict=True):
                if own.as_py() != shard:
                    done += flush()
                    shard = own.as_py()
                    size = min(shard_records, n - shard * shard_records)
                    ids, filled, loose = np.full((size, sequence), PAD_ID, dtype="<u2"), np.zeros(size, dtype=bool), []
                at = np.frombuffer(slots.as_py(), dtype="<i8") - shard * shard_records
                ids[at] = np.frombuffer(unpack(packed.as_py()), dtype="<u2").reshape(-1, sequence)
                filled[at] = True
                mine = np.frombuffer(unpack(packed_entries.as_py()), dtype=LOOSE).copy()
                mine["record"] = at[mine["record"]]
                loose.append(mine)
            if done:
                yield _manifest(done)
        done = flush()
        if done:
            yield _manifest(done)

    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["shard", "name", "records"])


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, sequence: int = SEQUENCE, shard_records: int = SHARD_RECORDS, key: int = KEY, control: bool = False) -> DataFrame:
    """Write the sequences of all documents to shards in training order; the manifest (shard, name, records) is returned,
    already written. Each slot from 0 to the number of sequences less one is taken once. The first numbers of the tasks'
    parts come from a sum a part. layout.json in the folder has what a reader must know. An empty table writes no shard."""
    pieces = staged(cut_sequences(docs, vocabulary, sequence, control=control), "sequences", "uncompressed")
    parts = pieces.groupBy("part").agg(F.sum("records").alias("n")).orderBy("part").collect()  # a row an input split
    first = np.zeros(max((r["part"] for r in parts), default=0) + 1, dtype=np.int64)
    n = 0
    for r in parts:
        first[r["part"]] = n
        n += r["n"]
    where, base = _open(path)
    where.create_dir(base, recursive=True)
    _write(where, base, "layout.json", json.dumps({"sequence": sequence, "shard_records": shard_records, "records": n, "key": key}).encode())
    shared = docs.sparkSession.sparkContext.broadcast(first)
    dealt = pieces.mapInArrow(_dealer(max(n, 1), key, sequence, shard_records, shared), "shard long, slots binary, ids binary, entries binary")
    # neighbouring shards go to one task, as many to each; the number is the partition, so no task gets more than its share
    shards = max(1, -(-n // shard_records))
    each = -(-shards // 100_000)
    ranged = dealt.repartitionById(-(-shards // each), F.floor(F.col("shard") / F.lit(each)).cast("int")).sortWithinPartitions("shard")
    out = staged(ranged.mapInArrow(_writer(path, n, sequence, shard_records), "shard long, name string, records long"), "manifest")
    discard(pieces)
    return out


def _reader(path: str, sequence: int, shard_records: int, first_slot: int, records: int):
    names = ["doc_id", "start", "length", "slot", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(path)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                # chunks never cross a shard's end
                shard, at = divmod(chunk, -(-shard_records // CHUNK))
                lo, hi = max(at * CHUNK, first_slot - shard * shard_records), min((at + 1) * CHUNK, shard_records, records - shard * shard_records)
                if lo >= hi:
                    continue
                name = f"{base}/shard-{shard:08d}.bin"
                with where.open_input_file(name) as f:
                    f.seek(2 * sequence * lo)
                    ids = np.frombuffer(f.read(2 * sequence * (hi - lo)), dtype="<u2").astype("<u4")
                with where.open_input_file(f"{name}.idx") as f:
                    f.seek(4 * lo)
                    before = np.frombuffer(f.read(4 * (hi - lo + 1)), dtype="<u4").astype(np.int64)
                    f.seek(4 * (min(shard_records, records - shard * shard_records) + 1) + ENTRY.itemsize * int(before[0]))
                    entries = np.frombuffer(f.read(ENTRY.itemsize * int(before[-1] - before[0])), dtype=ENTRY)
                record = np.repeat(np.arange(hi - lo), np.diff(before))
                begins = np.append(record * sequence + entries["offset"], len(ids))
                pieces = pa.Array.from_buffers(pa.binary(), len(entries), [None, pa.py_buffer((4 * begins).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                docs = pa.array(entries["doc_id"], mask=(entries["flags"] & NULL_ID) > 0)
                arrays = [docs, pa.array(entries["start"]), pa.array(np.diff(begins)), pa.array(record + shard * shard_records + lo), pa.array(entries["offset"].astype(np.int64)), pieces]
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array((entries["flags"] & PADDING) == 0))

    return run


def read_shards(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """(doc_id, start, length, slot, offset, ids) of what the sequences from first_slot on hold, in pieces of one document each; ids
    are little-endian unsigned 32-bit numbers. Shards before first_slot are not opened and a shard is read from the very slot
    on. Where to read follows from layout.json by arithmetic; tasks read CHUNK sequences at a time."""
    where, base = _open(path)
    with where.open_input_stream(f"{base}/layout.json") as f:
        layout = json.loads(f.read())
    records, shard_records = layout["records"], layout["shard_records"]
    each = -(-shard_records // CHUNK)
    first, last = first_slot // shard_records * each + first_slot % shard_records // CHUNK, -(-records // shard_records) * each
    chunks = spark.range(first, max(first, last), numPartitions=max(1, -(-(last - first) // CHUNKS_A_TASK)))
    return chunks.mapInArrow(_reader(path, layout["sequence"], shard_records, first_slot, records), "doc_id long, start long, length long, slot long, offset long, ids binary")


def materialise(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, shard_records: int = SHARD_RECORDS, key: int = KEY, control: bool = False) -> DataFrame:
    """Write shards to a new folder of the shared one and read them back as (doc_id, start, length, slot, offset, shard, ids).
    An empty table gives an empty result."""
    path = fresh_path(docs.sparkSession, "shards")
    write_shards(docs, path, vocabulary, sequence, shard_records, key, control)
    return read_shards(docs.sparkSession, path).withColumn("shard", F.floor(F.col("slot") / F.lit(shard_records)).cast("long"))
