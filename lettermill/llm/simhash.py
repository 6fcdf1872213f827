"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits maps to 32 segments of two bits, each with its bit count 0, 1 or 2. The Manhattan distance of
two such vectors never exceeds the Hamming distance of the fingerprints, so a link (at most 3 bits) lies within Manhattan
distance 3. The 32 segments form five groups; three units of distance leave at least two groups untouched, so the range
join is a grid join: ten cells a fingerprint, one for each pair of groups, keyed by the counts in them. Pairs that meet in
a cell are held against the Manhattan bound over all segments, then verified on the bits themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import blocked, components, discard, group_ids, map_batches, paired, runs, spanning, staged

BITS = 3
SHINGLE = 3
SEED = 42
EVEN = 0x5555555555555555
#: Segments of each group; bits 2s and 2s+1 belong to segment s.
GROUPS = [range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: For each pair of groups, the packed bits that its cell keeps.
CELLS = [_signed(sum(3 << (2 * s) for g in pair for s in GROUPS[g])) for pair in combinations(range(len(GROUPS)), 2)]


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included: a bit is 1 if set in over half of their hashes; no words: 0."""
    if not words:
        return 0
    text = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(text, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([hash64(text[s:e], SEED) for s, e in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinter():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        prints = np.fromiter((fingerprint((texts[i].as_py() or "").encode().lower().split()) for i in range(len(texts))), dtype="<u8", count=len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], names=["id", "fp"])

    return step


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each whole text as a signed long. A null or empty text has no words: 0."""
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _fingerprinter, "id long, fp long")


def packed_counts(fp):
    """Bit counts of the 32 two-bit segments, each in the place of its segment (bitwise only: a long must not overflow)."""
    up = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(up).bitwiseAND(F.lit(EVEN)), fp.bitwiseAND(up).bitwiseAND(F.lit(EVEN))
    return one.bitwiseOR(F.shiftleft(two, 1))


def counted(fp: np.ndarray) -> np.ndarray:
    """packed_counts() of unsigned fingerprints in numpy."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(EVEN))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of counted() segments: |x - y| over 0..2 is 2 exactly where the bits differ both ways alike."""
    differ = a ^ b
    # Counts are 00, 01, 10: they differ by one where exactly one of the pairs is 01, else by two (00 against 10).
    low = differ & np.uint64(EVEN)
    high = (differ >> np.uint64(1)) & np.uint64(EVEN)
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return apart(counted(a), counted(b))


def _finder(bits: int):
    keys = ["cell", "value", "lo", "hi"]

    def run(batches):
        for t in runs(batches, keys):
            fp, node = t["fp"].to_numpy().view("<u8"), t["node"].to_numpy()
            own, lo, hi = (t[c].to_numpy() for c in ("own", "lo", "hi"))
            left, right = [], []
            for i, j in paired(group_ids(t, keys), own, lo, hi):
                near = _manhattan(fp[i], fp[j]) <= bits
                i, j = i[near], j[near]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
                left.append(i[near])
                right.append(j[near])
            if left and sum(map(len, left)):
                a, b = spanning(np.concatenate(left), np.concatenate(right), node)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def link_fingerprints(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that join all of the classes (fp, node) at `bits` or fewer differing bits; each task gives a star of
    a group of linked classes, not all its pairs, so the links of a dense group grow with its rows. bits must be below 4."""
    if not 0 <= bits <= 3:
        raise ValueError("five groups leave two untouched up to 3 bits only")
    counts = packed_counts(F.col("fp"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), counts.bitwiseAND(F.lit(mask)).alias("value")) for k, mask in enumerate(CELLS)]))
    rows = classes.select("fp", "node", cells.alias("c")).select("fp", "node", F.col("c.cell").alias("cell"), F.col("c.value").alias("value"))
    return blocked(rows, ["cell", "value"], F.col("fp")).mapInArrow(_finder(bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable over links of `bits` or fewer
    differing bits, the row's own included.

    Equal fingerprints are one class, numbered in the table of classes, so copies never form pairs. Null and empty texts
    have fingerprint 0 and link like any other. A row with a null id has its links like any other, and its component is null
    unless a row with an id is reachable. Repeated ids give repeated rows. Other columns are ignored; an empty table
    gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(link_fingerprints(classes.select("fp", "node"), bits))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    named = staged(named, "named")
    discard(classes, roots)
    return prints.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of docs whose id is the component_id of its group: one document of each group stays. Rows with a null id
    stay as they are, since nothing names them."""
    parts = simhash_components(docs, id_col, text_col, bits)
    gone = staged(parts.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti")
