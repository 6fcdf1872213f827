"""Benchmark decontamination by spaced-seed hashing.

A mask of ones and zeros is laid over a run of words; the words under ones are hashed together, those under zeros are
ignored, so a hash survives substituted words at the zeros. Hashes of the test items meet those of the documents in a
join of hashes and places; each document, item and shift between them that comes out once or more is verified once: the
words of the item and the document are compared along the shift over their whole length, and the longest stretch in which
at least SIMILARITY of the words agree is what counts.

A phrase that many items share ("what is the correct answer") would pair each of them with every document that has it. A hash
of more than HOT places of items is therefore never joined: the windows of LEAST words around it, in items and documents alike,
are hashed by masks of more words, and where that is still shared by many, by masks of all words that must agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import discard, map_batches, staged

#: Fixed masks: five words in a row, and some that leave words out. Together they hit every stretch of 12 words with at most
#: two substitutions, and items of 7 to 11 words that agree at 80 % (see the tests).
MASKS = ("11111", "110111", "1110011", "1101011", "11001011")
#: Items of up to six words have masks of their own: all words, or all but one where one of them may differ.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "10111", "11011", "11101"), 6: ("11111", "101111", "110111", "111011", "111101")}
EVERY = tuple(dict.fromkeys([*MASKS, *(m for masks in SHORT.values() for m in masks)]))
#: Least stretch in words, and the share of its words that must agree. Shorter items must agree as a whole.
LEAST = 12
SIMILARITY = 0.8
#: Places in items up to which a hash is joined as it is.
HOT = 32


def _without(width: int, gone: tuple[int, ...]) -> str:
    return "".join("0" if i in gone else "1" for i in range(width))


def full_masks(width: int) -> tuple[str, ...]:
    """Masks over a window of so many words that leave out as many as may differ: what they hit agrees well enough."""
    return tuple(_without(width, gone) for gone in combinations(range(width), int((1 - SIMILARITY) * width + 1e-9)))


def _broad_masks() -> tuple[str, ...]:
    """Masks of seven words over LEAST that leave out any two of them at least once, each chosen for the most new pairs."""
    missing = set(combinations(range(LEAST), 2))
    out = []
    while missing:
        gone = max(combinations(range(LEAST), 5), key=lambda c: len(missing.intersection(combinations(c, 2))))
        missing -= set(combinations(gone, 2))
        out.append(_without(LEAST, gone))
    return tuple(out)


#: Masks for windows around shared hashes: any two words of LEAST may differ.
BROAD = _broad_masks()
#: Bits of the map of test hashes, a power of two between these that has at least so many bits a hash.
MAP_BITS = (16, 27)
BITS_A_HASH = 48
#: Bits that each hash sets, fewer where the map is full.
PROBES = 6
WORDS_KEPT = 300_000
#: Words of documents that are hashed together.
WORDS_AT_ONCE = 200_000
SIGNS = ".,;:!?\"'()[]{}<>|*%&$#=+-_/\\~^`@«»“”‘’…–—"


def _odd(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1)


class WordHashes(dict):
    """A 64-bit hash for each word, without the signs at its ends; 0 for a word of signs only."""

    def __missing__(self, word: str) -> int:
        core = word.strip(SIGNS)
        h = self[word] = xxhash.xxh64_intdigest(core.encode(), 7) if core else 0
        return h


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """The hashes of a text's words in lower case; words of signs only are left out. known: WordHashes, or an empty dict."""
    hashes = known if isinstance(known, WordHashes) else WordHashes(known)
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    words = (text or "").lower().split()
    out = np.fromiter(map(hashes.__getitem__, words), dtype="<u8", count=len(words))
    return out[out != 0]


def seed_hashes(words: np.ndarray, mask: str, at: np.ndarray | None = None) -> np.ndarray:
    """The mask's hash at each of the places `at`, by default wherever it fits."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n if at is None else len(at), _odd(1000 + int("1" + mask, 2)), dtype=np.uint64)
    for k, i in enumerate(ones):
        out = (out ^ (words[i : i + n] if at is None else words[at + i])) * _odd(k)
        out ^= out >> np.uint64(29)
    return out


def stretch(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> tuple[int, int]:
    """(words, equal words) of the longest stretch of at least `least` aligned words of which `similarity` agree; (0, 0) for none."""
    same = np.concatenate([[0], np.cumsum(a == b)])
    # the longest i..j whose share is enough: the surplus at j is no less than that at i, whose running minimum falls
    surplus = same - similarity * np.arange(len(same))
    lowest = np.minimum.accumulate(surplus)
    first = np.searchsorted(-lowest, -(surplus + 1e-9), side="left")
    size = int((np.arange(len(same)) - first).max())
    if size < max(least, 1):
        return 0, 0
    return size, int((same[size:] - same[: len(same) - size]).max())


def _item_words():
    known = WordHashes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [word_hashes(t.as_py(), known).tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "item_words"])

    return step


def _item_seeds():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, ...]] = []
        for item, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = np.frombuffer(raw.as_py(), dtype="<u8")
            for m in SHORT.get(len(words), MASKS):
                hashes = seed_hashes(words, m).view(np.int64)
                same = [np.full(len(hashes), v) for v in (item, len(words), EVERY.index(m), len(m))]
                out.append((*same, hashes, np.arange(len(hashes))))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 6
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["item", "length", "mask", "span", "hash", "item_at"])

    return step


def _window_seeds(width: int, masks: tuple[str, ...]):
    """Hashes of the windows of items (item, item_words, starts) by the masks, all of one width."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[np.ndarray, ...]] = []
            for item, raw, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words, at = np.frombuffer(raw.as_py(), dtype="<u8"), np.array(starts.as_py(), dtype=np.int64)
                out.extend((np.full(len(at), item), np.full(len(at), width), seed_hashes(words, m, at).view(np.int64), at) for m in masks)
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["item", "span", "hash", "item_at"])

        return step

    return make


def _probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The place of each hash's k-th bit: k steps by its high part from its low part."""
    return (hashes + np.uint64(k) * (hashes >> np.uint64(36))) & np.uint64((1 << bits) - 1)


def _in_map(table: np.ndarray, hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The places of the hashes that the map has."""
    left = np.arange(len(hashes))
    for k in range(probes):
        slot = _probe(hashes[left], k, bits)
        left = left[((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)]
    return left


def _document_hits(shared, masks: tuple[str, ...], widths: tuple[int, ...], bits: int, probes: int):
    """Documents with a hash that the map has: words, and hash and place of each such hit. Windows of the widths around hashes
    that many items share are hashed by their own masks."""
    names = ["doc_id", "doc_words", "hits", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not masks:
            return
        (table, hot), known = shared.value, WordHashes()
        docs: list[int | None] = []
        words: list[np.ndarray] = []

        def found() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(w) for w in words])
            every = np.concatenate(words)
            ends = np.cumsum(sizes)
            hit_at, hit_hash = [], []

            def within(at: np.ndarray, width: int) -> np.ndarray:
                return at[at + width <= ends[np.searchsorted(ends, at, side="right")]]

            def send(at: np.ndarray, hashes: np.ndarray) -> None:
                hit_at.append(at)
                hit_hash.append(hashes.view(np.int64))

            near: list[tuple[np.ndarray, int]] = []
            for m in masks:
                hashes = seed_hashes(every, m)
                at = within(_in_map(table, hashes, bits, probes), len(m))
                send(at, hashes[at])
                if widths:
                    near.append((within(_in_map(hot, hashes, bits, probes), len(m)), len(m)))
            for width in widths:
                marked = np.zeros(len(every), dtype=bool)
                for at, span in near:
                    for back in range(max(width - span, 0) + 1):
                        marked[at[at >= back] - back] = True
                starts = within(np.flatnonzero(marked), width)
                if width == LEAST:
                    marked[:] = False
                    for m in BROAD:
                        hashes = seed_hashes(every, m, starts)
                        found_at = _in_map(table, hashes, bits, probes)
                        send(starts[found_at], hashes[found_at])
                        marked[starts[_in_map(hot, hashes, bits, probes)]] = True
                    starts = np.flatnonzero(marked)
                for m in full_masks(width):
                    hashes = seed_hashes(every, m, starts)
                    found_at = _in_map(table, hashes, bits, probes)
                    send(starts[found_at], hashes[found_at])
            at, hashes = np.concatenate(hit_at), np.concatenate(hit_hash)
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
            owner = np.searchsorted(ends, at, side="right")
            own, starts = np.unique(owner, return_index=True)
            if len(own):
                cuts = pa.array(np.append(starts, len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[k] for k in own], pa.int64()),
                        pa.array([words[k].tobytes() for k in own], pa.binary()),
                        pa.ListArray.from_arrays(cuts, pa.array(hashes)),
                        pa.ListArray.from_arrays(cuts, pa.array(at - (ends - sizes)[owner])),
                    ],
                    names=names,
                )
            docs.clear()
            words.clear()

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                docs.append(doc.as_py())
                words.append(word_hashes(text.as_py(), known))
                held += len(words[-1])
                if held >= WORDS_AT_ONCE:
                    yield from found()
                    held = 0
        if held:
            yield from found()

    return run


def _verifier(least: int, similarity: float):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: list[tuple] = []
            seen: dict[tuple, tuple[int, int]] = {}
            for doc, item, a, b, length in zip(*(get[c] for c in ("doc_id", "item_id", "x", "y", "item_length")), strict=True):
                key = (a.as_py(), b.as_py())
                if key not in seen:
                    x, y = (np.frombuffer(v, dtype="<u8") for v in key)
                    seen[key] = stretch(x, y, min(least, length.as_py()), similarity)
                size, equal = seen[key]
                if size:
                    out.append((doc.as_py(), item.as_py(), size, equal))
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "words", "equal_words"])

        return step

    return make


def _hash_map(seeds: DataFrame, bits: int, probes: int) -> np.ndarray:
    """The map of test hashes, 2 ** bits bits, with the places of _probe set."""
    # sums of the low parts only: a long must not overflow
    low = lambda c: c.bitwiseAND(F.lit((1 << bits) - 1))
    slots = F.array(*[low(low(F.col("hash")) + F.lit(k) * F.shiftrightunsigned("hash", 36)) for k in range(probes)])
    words = seeds.select(F.explode(slots).alias("slot")).select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros((1 << bits) // 64, dtype=np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def _spread(first: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """(seeds, hot, widths): the hashes that documents are joined with (item, hash, item_at), those that more than HOT places
    of items share, and the widths of the windows that stand for them. Items of up to six words keep theirs: their masks hit
    only what agrees well enough."""
    schema = "item long, span long, hash long, item_at long"
    shared = lambda rows: rows.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("hash")
    hot = staged(shared(first), "hot-seeds")
    long = F.col("length") > max(SHORT)
    plain = first.where(~long).unionByName(first.where(long).join(hot, "hash", "left_anti")).select("item", "hash", "item_at")
    width = F.least(F.lit(window), F.col("length"))
    around = first.where(long).join(hot, "hash", "left_semi").withColumn("width", F.greatest(width, "span"))
    starts = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("item_at") + F.col("span") - F.col("width")), F.least(F.col("item_at"), F.col("length") - F.col("width"))))
    windows = staged(around.select("item", "width", starts.alias("start")).distinct(), "windows")
    widths = tuple(r["width"] for r in windows.select("width").distinct().orderBy("width").collect())  # at most LEAST rows

    def hashed(rows: DataFrame, size: int, masks: tuple[str, ...]) -> DataFrame:
        # the starts of one item's windows are fewer than its words
        own = rows.groupBy("item").agg(F.collect_set("start").alias("starts")).join(items, "item")
        return map_batches(own.select("item", "item_words", "starts"), _window_seeds(size, masks), schema)

    parts, hots, spent = [plain], [hot], [windows]
    for size in widths:
        rows = windows.where(F.col("width") == size)
        if size == LEAST:
            broad = staged(hashed(rows, size, BROAD), "broad-seeds")
            again = staged(shared(broad), "hot-broad")
            parts.append(broad.join(again, "hash", "left_anti").select("item", "hash", "item_at"))
            hots.append(again)
            spent.append(broad)
            rows = broad.join(again, "hash", "left_semi").select("item", F.col("item_at").alias("start")).distinct()
        parts.append(hashed(rows, size, full_masks(size)).select("item", "hash", "item_at"))
    seeds = staged(reduce(DataFrame.unionByName, parts), "seeds")
    every = staged(reduce(DataFrame.unionByName, hots), "hot")
    for table in [*hots, *spent]:
        discard(table)
    return seeds, every, widths


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, words, equal_words) for every document that shares with a test item a stretch of at least `least`
    words (the whole item, if shorter) of which the share `similarity` agrees; the longest such stretch is given, however long.

    Words are compared in lower case and without signs at their ends. Null texts are empty and overlap with nothing, as do
    items without words; a short item is found wherever its words stand. Null ids count as ids. Repeated rows do not repeat the
    result; other columns are ignored; an empty table on either side gives an empty result. Documents send a hash only where a
    bit map of the test hashes, of at most 2 ** 27 bits, has it; hashes and places meet in a join that Spark may split where one
    is hot, and words travel only to the pairs and shifts that come out of it. Hashes that more than HOT places of items share
    are looked up by the windows around them: what agrees in ten of twelve words in a row is found all the same.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = staged(map_batches(rows, _item_words, "item_id long, item_words binary").where("octet_length(item_words) > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    first = staged(map_batches(items.select("item", "item_words"), _item_seeds, "item long, length long, mask long, span long, hash long, item_at long"), "first-seeds")
    masks = tuple(EVERY[r["mask"]] for r in first.select("mask").distinct().orderBy("mask").collect())  # a row a mask
    seeds, hot, widths = _spread(first, items, min(least, LEAST))
    discard(first)
    n = seeds.count()
    bits = min(max(int(BITS_A_HASH * n).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    probes = min(PROBES, max(1, round(0.7 * (1 << bits) / max(n, 1))))
    shared = spark.sparkContext.broadcast((_hash_map(seeds, bits, probes), _hash_map(hot, bits, probes) if widths else None))
    discard(hot)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hits = texts.mapInArrow(_document_hits(shared, masks, widths, bits, probes), "doc_id long, doc_words binary, hits array<long>, places array<long>")
    hits = staged(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    places = hits.select("row", F.explode(F.arrays_zip("hits", "places")).alias("h")).select("row", F.col("h.hits").alias("hash"), F.col("h.places").alias("doc_at"))
    # the item's first word stands at place `at` of the document, before its first word if negative
    met = staged(places.join(seeds.select("item", "hash", "item_at"), "hash").select("row", "item", (F.col("doc_at") - F.col("item_at")).alias("at")).distinct(), "met")
    discard(seeds)
    wide = met.join(items, "item").join(hits.select("row", "doc_id", "doc_words"), "row")
    shift = lambda words, n: F.expr(f"substring({words}, cast(8 * {n} + 1 as int))")
    wide = wide.select("doc_id", "item_id", F.expr("octet_length(item_words) div 8").alias("item_length"), shift("doc_words", "greatest(at, 0)").alias("x"), shift("item_words", "greatest(-at, 0)").alias("y"))
    wide = wide.withColumn("n", F.least(F.octet_length("x"), F.octet_length("y"))).selectExpr("doc_id", "item_id", "item_length", "substring(x, 1, n) as x", "substring(y, 1, n) as y")
    found = map_batches(wide, _verifier(least, similarity), "doc_id long, item_id long, words long, equal_words long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "equal_words")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.words").alias("words"), F.col("m.equal_words").alias("equal_words"))


def flagged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, contaminated, n_items, item_ids, words) for every row of docs: the test items it overlaps with, smallest id first,
    and the longest stretch. item_ids is empty for clean rows."""
    found = overlaps(docs, benchmark, id_col=id_col, **options)
    told = staged(found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("words")), "contaminated")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    none = F.array().cast("array<bigint>")
    out = ids.join(told, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return out.select("id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that overlap with no test item."""
    gone = staged(overlaps(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__lm_gone")).distinct(), "gone")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__lm_gone")), "left_anti")
