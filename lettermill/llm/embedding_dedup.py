"""Embedding near-duplicates by spherical-cap filters.

Filters are the words of a random product code: a unit vector is turned by a structured random rotation (signs and
Hadamard transforms), cut into four parts, and each part has a code book, so a filter is four words and its direction
their concatenation; a few lists of words stand for a very large number of directions. A vector is decoded to all filters
whose direction exceeds a cap height with it: the sums of two parts that can still reach the height are formed, then
matched with those of the other two. The height makes a cap hold a fixed share of one vector in n, so that filters grow
with the data and their buckets do not. Vectors that share a filter are verified in double precision.

Only ids and a sketch of SKETCH_BITS signs travel to the many small buckets: pairs whose sketches are near are made distinct
and meet their vectors once. A bucket of more than DENSE_ROWS is a group of near copies; its vectors are compared by matrix
products in blocks, and a pair counts in the largest such bucket that it shares, so the others have next to nothing to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import components, dealt, discard, group_ids, map_batches, paired, runs, staged

COSINE = 0.95
BLOCKS = 4
#: Filters that a vector is expected to exceed, and vectors that a filter is expected to hold.
FILTERS = 32.0
OCCUPANCY = 0.05
#: Filters that each vector is given at least.
LEAST = 30
SEED = 17
#: Buckets of more rows are compared by matrix products.
DENSE_ROWS = 32
#: Signs of a sketch, and how many may differ between two vectors that are verified: those of vectors at a cosine of 0.95 differ
#: each with probability 0.101, so more than 36 of 128 do for one pair in ten million.
SKETCH_BITS, SKETCH_DIFFER = 128, 36
#: Columns of the shared-filter matrix of a dense bucket that are held at once.
COLUMNS = 4096


def cap_height(share: float, dims: int) -> float:
    """The height t at which a cap {x: <x, f> >= t} of the unit sphere holds the share of its surface."""
    t = np.linspace(-1, 1, 200_001)
    density = np.clip(1 - t * t, 0, None) ** ((dims - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above / above[0], -share)])


class Code:
    """Product code for n vectors of some dimensions; the same for the same arguments."""

    def __init__(self, n: int, dims: int, seed: int = SEED):
        self.size = 1 << max(3, (dims - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (3, self.size))
        share = min(0.05, OCCUPANCY / max(n, 20))
        self.words = max(4, int(np.ceil((FILTERS / share) ** (1 / BLOCKS))))
        self.height = cap_height(FILTERS / self.words**BLOCKS, self.size)
        book = rng.standard_normal((BLOCKS, self.words, self.size // BLOCKS))
        self.book = book / np.linalg.norm(book, axis=2, keepdims=True) / np.sqrt(BLOCKS)

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors (rows), padded, after three rounds of random signs and a Hadamard transform."""
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x
        for signs in self.signs:
            out *= signs
            step = 1
            while step < self.size:
                pairs = out.reshape(len(out), -1, 2, step)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), self.size)
                step *= 2
            out /= np.sqrt(self.size)
        return out

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of each row: all that exceed the height, the LEAST best or more at any rate."""
        parts = self.turn(x).reshape(len(x), BLOCKS, -1)
        scores = np.einsum("nbd,bwd->nbw", parts, self.book)
        order = np.argsort(-scores, axis=2, kind="stable")
        scores = np.take_along_axis(scores, order, axis=2)
        out = []
        for s, o in zip(scores, order, strict=True):
            top = s[:, 0]
            limit = min(self.height, top.sum())
            while True:  # a vector whose parts are uneven exceeds few filters at the common height: its own cap is lower
                left, a = _sums(s[0], s[1], limit - top[2] - top[3])
                right, b = _sums(s[2], s[3], limit - top[0] - top[1])
                by = np.argsort(-right, kind="stable")
                n = np.searchsorted(-right[by], left - limit, side="right")
                if n.sum() >= min(LEAST, self.words**BLOCKS):
                    break
                limit -= 0.01
            first = np.repeat(np.cumsum(n) - n, n)
            a, b = np.repeat(a, n, axis=1), b[:, by[np.arange(n.sum()) - first]]
            word = [o[k][i] for k, i in enumerate((*a, *b))]
            out.append(np.unique(((word[0] * self.words + word[1]) * self.words + word[2]) * self.words + word[3]))
        return out

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """SKETCH_BITS signs of each row as two 64-bit numbers: of the turned row, turned again where it has fewer places."""
        signs, turned = [], x
        while sum(s.shape[1] for s in signs) < SKETCH_BITS:
            turned = self.turn(turned)
            signs.append(turned >= 0)
        return np.packbits(np.concatenate(signs, axis=1)[:, :SKETCH_BITS], axis=1, bitorder="little").view("<u8")


def _sums(p: np.ndarray, q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums p[i] + q[j] of two falling lists that reach the limit, and their places (i, j); only these are formed."""
    p = p[: np.searchsorted(-p, q[0] - limit, side="right")]
    n = np.searchsorted(-q, p - limit, side="right")
    i = np.repeat(np.arange(len(p)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return p[i] + q[j], np.stack([i, j])


def _prepare():
    """Valid vectors as little-endian float64 bytes; null for one that links with nothing."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v in batch.column(1):
            x = v.as_py()
            if not x or any(c is None for c in x):
                out.append(None)
                continue
            x = np.array(x, dtype="<f8") + 0.0
            norm = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
            out.append(x.tobytes() if 0 < norm < np.inf else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vector"])

    return step


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of binary rows, shorter ones padded with zeros."""
    raw = column.to_pylist()
    out = np.zeros((len(raw), dims))
    for i, b in enumerate(raw):
        x = np.frombuffer(b, dtype="<f8")
        out[i, : len(x)] = x
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _decoder(n: int, dims: int):
    def make():
        code = Code(n, dims)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists: list[np.ndarray] = []
            marks: list[np.ndarray] = []
            for at in range(0, batch.num_rows, 512):
                unit = _unit(_matrix(batch.column(1).slice(at, 512), dims))
                lists += code.decode(unit)
                marks.append(code.sketch(unit).view("<i8"))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            sketch = np.concatenate(marks)
            filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), filters], names=["node", "vector", "copies", "s0", "s1", "filters"])

        return step

    return make


def _padded(column: pa.Array, size: int | None = None) -> np.ndarray:
    """Lists of numbers as rows, filled up with -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = np.asarray(column.offsets), column.values.to_numpy()
    n = np.diff(ends)
    out = np.full((len(n), max(1, n.max(initial=0))), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], n)] = flat[ends[0] : ends[-1]]
    return out


def _near_sketches(batches):
    """Pairs (a, b), a the smaller node, of rows of a small bucket whose sketches are near and that share no dense bucket."""
    keys = ["key"]
    for t in runs(batches, keys):
        node, sketch, big = t["node"].to_numpy(), np.stack([t["s0"].to_numpy(), t["s1"].to_numpy()], axis=1).view("<u8"), _padded(t["big"])
        own = np.zeros(len(node), dtype=np.int32)
        left, right = [], []
        for i, j in paired(group_ids(t, keys), own, own, own):
            near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= SKETCH_DIFFER
            i, j = i[near], j[near]
            dense = np.flatnonzero((big[i, 0] >= 0) & (big[j, 0] >= 0))
            if len(dense):
                apart = np.ones(len(i), dtype=bool)
                for at in range(0, len(dense), 4096):
                    d = dense[at : at + 4096]
                    x, y = big[i[d]], big[j[d]]
                    apart[d] = ~((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(axis=(1, 2))
                i, j = i[apart], j[apart]
            left.append(np.minimum(node[i], node[j]))
            right.append(np.maximum(node[i], node[j]))
        if sum(map(len, left)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _verifier(dims: int, cosine: float):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            near = np.einsum("nd,nd->n", _unit(_matrix(get["x"], dims)), _unit(_matrix(get["y"], dims))) >= cosine
            return pa.RecordBatch.from_arrays([get[c] for c in ("a", "b", "copies_a", "copies_b")], names=["a", "b", "copies_a", "copies_b"]).filter(pa.array(near))

        return step

    return make


def _fresh(big: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of rows share none of the dense buckets before this one (larger, or as large with a smaller number)."""
    earlier = np.where((big >= 0) & (big < key), big, -1)
    known, at, seen = np.unique(earlier, return_inverse=True, return_counts=True)
    at = at.reshape(earlier.shape)
    # most shared first: one that all rows share leaves nothing; one that a row has alone makes no pair
    known = np.flatnonzero((known >= 0) & (seen > 1))
    known = known[np.argsort(-seen[known], kind="stable")]
    place = np.full(len(seen), len(known))
    place[known] = np.arange(len(known))
    at = place[at]
    fresh = np.ones((len(big), len(big)), dtype=bool)
    np.fill_diagonal(fresh, False)
    step = 64
    start = 0
    while start < len(known) and fresh.any():
        has = np.zeros((len(big), step), dtype=np.float32)
        row, column = np.nonzero((at >= start) & (at < min(start + step, len(known))))
        has[row, at[row, column] - start] = 1
        fresh &= has @ has.T == 0
        start, step = start + step, min(2 * step, COLUMNS)
    return fresh


def _dense(unit, big, key, copies, across, cosine, node):
    """Labels of one large group by matrix products, which rows are linked, and the links that count here."""
    pairs = _fresh(big, key)
    if across is not None:
        pairs &= across[:, None] != across[None, :]
    if not pairs.any():
        return node, np.zeros(len(node), dtype=bool), np.zeros(len(node), dtype=np.int64)
    near = (unit @ unit.T >= cosine) & pairs
    hit = near.any(axis=1)
    label = np.where(hit, node, np.iinfo(np.int64).max)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if np.array_equal(new, label):
            return label, hit, near @ copies
        label = new


def _finder(dims: int, cosine: float):
    keys = ["key", "lo", "hi"]

    def run(batches):
        for t in runs(batches, keys):
            group = group_ids(t, keys)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
            for at, end in zip(starts, [*starts[1:], len(group)], strict=True):
                g = t.slice(at, end - at)
                node, copies, own = (g[c].to_numpy() for c in ("node", "copies", "own"))
                across = None if g["lo"][0] == g["hi"][0] else own
                label, hit, links = _dense(_unit(_matrix(g["vector"].combine_chunks(), dims)), _padded(g["big"]), g["key"][0].as_py(), copies, across, cosine, node)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(label[hit]), pa.array(links[hit].astype(np.int64))], names=["node", "label", "links"])

    return run


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id) for every row. n_links counts the other rows found with that cosine or more,
    component_id is the smallest id reachable over links, the row's own included. cosine must be 0.95 or more: filters and
    sketches are made for that.

    Equal vectors are one class, numbered in the table of classes: they link with each other, and a link of two classes
    counts for each copy. A pair counts once: among the small buckets by being made distinct, among the dense ones in the
    largest that both rows have, and in a small bucket only if the two share no dense one. Each block of a dense bucket gives
    counts and a star a linked group, never its pairs. Null and zero vectors and those with null or non-finite components link
    with nothing; vectors shorter than the longest count as padded with zeros. A row with a null id has its links like any
    other, and its component is null unless a row with an id is reachable. The filters' number follows the number of distinct
    vectors. Repeated ids give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    if not COSINE <= cosine <= 1:
        raise ValueError("filters and sketches find links of cosine 0.95 or more only")
    ids = staged(map_batches(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), _prepare, "id long, vector binary"), "vectors")
    grouped = ids.where("vector is not null").groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.octet_length("vector"))).first()
    if not n:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    dims = longest // 8
    decoded = staged(map_batches(classes.select("node", "vector", "copies"), _decoder(n, dims), "node long, vector binary, copies long, s0 long, s1 long, filters array<long>"), "filters")
    # buckets of one vector are dropped before anything is dealt; a key sorts buckets by size, the largest first: 16 bits for the
    # logarithm of the size in steps of 1/1024, 47 for the filter, enough for 10 ** 11 vectors
    pairs = decoded.select("node", F.explode("filters").alias("filter"))
    key = F.shiftleft(F.lit(65_000) - F.floor(F.log2(F.col("n").cast("double")) * 1024), 47).bitwiseOR(F.col("filter"))
    many = pairs.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("filter", key.alias("key"), "n")
    shared = staged(pairs.join(many, "filter").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("shared")), "shared")
    is_dense = lambda s: s["n"] > DENSE_ROWS
    dense = shared.select("node", F.filter("shared", is_dense).alias("d")).where(F.size("d") > 0).select("node", F.col("d")[0]["key"].alias("first"), F.explode("d").alias("s")).select("node", "first", "s.key", "s.n")
    # a bucket whose rows all lie in one larger bucket as well has no pair of its own
    needed = dense.groupBy("key").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where((F.col("lo") < F.col("hi")) | (F.col("lo") == F.col("key"))).select("key")
    kept = staged(dense.join(needed, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("dense")), "dense")
    lists = kept.select("node", F.transform("dense", lambda s: s["key"]).alias("big"), "dense")

    small = shared.select("node", F.explode(F.filter("shared", lambda s: ~is_dense(s))).alias("s")).select("node", F.col("s.key").alias("key"))
    small = small.join(decoded.select("node", "s0", "s1"), "node").join(lists.select("node", "big"), "node", "left").withColumn("big", F.coalesce("big", F.array().cast("array<long>")))
    small = small.repartition("key").sortWithinPartitions("key")
    met = staged(small.mapInArrow(_near_sketches, "a long, b long").distinct(), "met")
    half = decoded.select("node", "vector", "copies")
    rows = met.join(half.toDF("a", "x", "copies_a"), "a").join(half.toDF("b", "y", "copies_b"), "b")
    single = staged(map_batches(rows, _verifier(dims, cosine), "a long, b long, copies_a long, copies_b long"), "pairs")

    large = lists.join(half, "node").select("node", "vector", "copies", "big", F.explode("dense").alias("s"))
    large = large.select("node", "vector", "copies", "big", F.col("s.key").alias("key"), F.col("s.n").alias("n"))
    found = staged(dealt(large, ["key"], F.col("node"), "n").mapInArrow(_finder(dims, cosine), "node long, label long, links long"), "found")

    roots = components(single.select("a", "b").unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    counted = found.select("node", "links").unionByName(single.select(F.col("a").alias("node"), F.col("copies_b").alias("links"))).unionByName(single.select(F.col("b").alias("node"), F.col("copies_a").alias("links")))
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.select("vector", "node", "copies", "root").join(least, "root").join(counted, "node", "left")
    told = staged(told.select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")), "told")
    discard(classes, decoded, shared, kept, met, single, found, roots)
    linked = ids.where("vector is not null").join(told, "vector").select("id", F.col("n").cast("long").alias("n_links"), "component_id")
    return linked.unionByName(ids.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
