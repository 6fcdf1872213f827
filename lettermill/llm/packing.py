"""Packing documents into sequences: shortest-pack-first over the length histogram.

A document's ids are cut into whole sequences and one rest. Only how many pieces of each length there are matters for the
plan, so the driver sees a histogram of at most max_tokens rows. Lengths are placed longest first, each into the pattern
that is filled the least (or one that it fills exactly), updating the patterns' counts; the patterns then give every
(length, rank) a sequence and an offset, and pieces join them by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import map_batches, staged

MAX_TOKENS = 2048
END_ID = 1
#: Pieces of one length that are ranked together at most, about; and parts of a length of fewer pieces, of FEW_ROWS or more each.
PART_ROWS, LEAST_PARTS, FEW_ROWS = 1 << 16, 64, 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


#: The added token of the tokenizers file, which its plain call recognises in texts.
CONTROL = {"<|endoftext|>": 50256}


def load_encoder(path: str, control: bool = False):
    """A byte-level BPE encoder from a file of ranks (base64 token, rank): the same ids as the tokenizers file of that
    vocabulary. Control strings in texts are ordinary text; with `control` they can be allowed as tokens of their own."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=CONTROL if control else {})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _cutter(vocabulary: str, max_tokens: int, end_id: int, control: bool):
    def make():
        encode, allowed = load_encoder(vocabulary, control).encode_to_numpy, set(CONTROL) if control else set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, texts = batch.column(0), batch.column(1)
            out: list[list] = [[], [], [], [], []]
            for i in range(len(texts)):
                ids = np.append(encode(texts[i].as_py() or "", allowed_special=allowed, disallowed_special=()), end_id).astype("<u4")
                for start in range(0, len(ids), max_tokens):
                    part = ids[start : start + max_tokens]
                    for column, value in zip(out, (docs[i].as_py(), start, len(part), part.tobytes(), len(ids)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])

        return step

    return make


def cut_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", control: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens): a document's ids and end_id, cut after every max_tokens ids; ids are
    little-endian unsigned 32-bit numbers. A null text is empty and gives the end_id alone. Null and repeated ids stay. With `control`,
    <|endoftext|> in a text is its one id, as in the plain call of tokenizers; else it is ordinary text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, _cutter(vocabulary or default_vocabulary(), max_tokens, end_id, control), PIECES)


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, how many sequences) for a histogram {length: pieces}.

    Lengths go longest first. Packs that a length fills exactly take it first, then the packs filled the least, as long as
    the counts of both last; what finds no pack opens new ones. Work depends on the number of lengths and patterns, never on the number of pieces.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def add(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room == 0:
            done.append((pattern, count))
            return
        if not packs[room]:
            insort(rooms, room)
        packs[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            exact = bisect_left(rooms, length)
            if exact == len(rooms):
                add(max_tokens - length, (length,), left)
                break
            room = rooms[exact] if rooms[exact] == length else rooms[-1]
            pattern, count = packs[room].pop()
            if not packs[room]:
                rooms.remove(room)
            used = min(count, left)
            if count > used:
                add(room, pattern, count - used)
            add(room - length, (*pattern, length), used)
            left -= used
    return done + [p for room in sorted(packs) for p in packs[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: first rank, first sequence and offset, sorted by (length, first rank)."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {name: table[:, k] for k, name in enumerate(("length", "rank", "sequence", "offset"))}


def _placer(shared, rank_col: str):
    def make():
        s = shared.value
        keys = (s["length"] << 44) + s["rank"]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", rank_col))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            kept = [i for i, n in enumerate(batch.schema.names) if n != rank_col]
            arrays = [batch.column(i) for i in kept] + [pa.array(s["sequence"][at] + rank - s["rank"][at]), pa.array(s["offset"][at])]
            return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"])

        return step

    return make


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces with sequence_id and offset added: sequences from 0 on, each gapless from offset 0 and of max_tokens at most.

    pieces needs doc_id, start and a length of 1 to max_tokens; other columns stay, so it should be a written table, read
    twice here. The histogram (max_tokens rows) is all that reaches the driver; what goes back out are the patterns' slots,
    whose number depends on the lengths, not on the pieces. Ranks are taken in parts of each length, more for a length that
    more pieces share (PART_ROWS pieces a part at most, about), so that it is ranked in parallel; the parts' first ranks come from counts.
    Input columns named sequence_id or offset are replaced. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    salt_col, rank_col = (_free(f"_lm_{n}", pieces.columns) for n in ("part", "rank"))
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # max_tokens rows
    histogram: dict[int, int] = {r["length"]: r["n"] for r in lengths}
    if any(not 1 <= n <= max_tokens for n in histogram):
        raise ValueError("lengths must be between 1 and max_tokens")
    parts = {n: max(1, -(-count // PART_ROWS), min(LEAST_PARTS, count // FEW_ROWS)) for n, count in histogram.items()}
    many = F.element_at(F.create_map(*[F.lit(x) for p in sorted(parts.items()) if p[1] > 1 for x in p]), F.col("length").cast("int")) if max(parts.values(), default=1) > 1 else F.lit(1)
    salted = pieces.withColumn(salt_col, F.pmod(F.xxhash64("doc_id", "start"), F.coalesce(many, F.lit(1)).cast("long")))
    # the first rank of each part, by (length, part): a number a part, one for PART_ROWS pieces
    before = np.zeros(max_tokens + 2, dtype=np.int64)
    before[1:] = np.cumsum([parts.get(n, 0) for n in range(max_tokens + 1)])
    first = np.zeros(before[-1], dtype=np.int64)
    for r in salted.groupBy("length", salt_col).agg(F.count(F.lit(1)).alias("n")).collect():
        first[before[r["length"]] + r[salt_col]] = r["n"]
    first = np.cumsum(first) - first
    if len(first):
        first -= np.repeat(first[np.minimum(before[:-1], len(first) - 1)], np.diff(before))
    spark = pieces.sparkSession
    placed = spark.sparkContext.broadcast(slots(plan(histogram, max_tokens)) | {"first": first, "before": before})
    keys = ["length", salt_col]
    sorted_rows = salted.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "start")
    ranked = map_batches(sorted_rows, _ranker(placed, salt_col, rank_col), f"{_ddl(pieces)}, `{rank_col}` long")
    return map_batches(ranked, _placer(placed, rank_col), f"{_ddl(pieces)}, sequence_id long, offset long")


def _free(name: str, taken: list[str]) -> str:
    """The name, with signs added as long as a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _ranker(shared, salt_col: str, rank_col: str):
    """Ranks of rows sorted by (length, salt): the part's first rank plus the place within the part. A part may go on in the
    next batch."""

    def make():
        first, before = shared.value["first"], shared.value["before"]
        last, seen = -1, 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last, seen
            names = batch.schema.names
            part = before[batch.column(names.index("length")).to_numpy()] + batch.column(names.index(salt_col)).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            place = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
            if part[0] == last:
                place[: starts[1] if len(starts) > 1 else len(part)] += seen
            last, seen = int(part[-1]), int(place[-1]) + 1
            kept = [i for i, n in enumerate(names) if n != salt_col]
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(first[part] + place)], names=[names[i] for i in kept] + [rank_col])

        return step

    return make


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, keep_ids: bool = True, control: bool = False) -> DataFrame:
    """Documents cut and packed: (doc_id, start, length, ids, doc_tokens, sequence_id, offset). With keep_ids False the
    column ids_crc32 (CRC-32 of the piece's ids) takes the place of ids, so that no token travels through a shuffle. `control` as in cut_documents."""
    pieces = cut_documents(docs, vocabulary, max_tokens, control=control)
    if not keep_ids:
        pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(staged(pieces, "pieces"), max_tokens)
