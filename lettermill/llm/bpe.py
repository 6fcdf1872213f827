"""Byte-level BPE encoding and decoding with a pre-tokeniser of array operations.

A batch of texts is one array of code points. Each code point has a class; where the split pattern looks ahead (the end of a
run of spaces, the letters of a contraction) shifted arrays refine it. An automaton of eight states reads the classes: a
character is a map of states to states, and maps compose associatively, so the states before all characters come from a
prefix scan. The few maps that compositions of characters make are numbered once and their products tabled, so each step of
the scan is one look-up. State and class say where a piece begins; no regular expression runs over a text.

Pieces are merged by ranks, each distinct piece once as long as the cache holds it. Every token keeps the place of its first
byte, which is where decoding puts its bytes.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are split and tokens that are decoded at once; a longer document is a chunk of its own when split.
CHUNK = 1 << 19
#: Characters of pieces that the cache holds before it starts anew.
CACHE_CHARS = 1 << 22
#: Bytes of a piece up to which the pairs are searched for the smallest rank; longer pieces have a heap.
SHORT_PIECE = 64
#: Characters that one row of the scan reads before rows are combined.
ROW = 64

# Classes of characters, as an automaton reads them: letter, number, other sign, apostrophe before one or two letters of a
# contraction, space that a space or the end follows, last space of a run that is not or that is U+0020.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LAST, LEAD = range(8)
# States: at the start of a piece, within a run of letters, numbers, others or spaces, behind a leading space, with one or
# two letters of a contraction to come.
START, LETTERS, NUMBERS, OTHERS, SPACES, LED, ONE, TWO = range(8)

# Letters and numbers that Unicode 16.0 added; earlier ones are in the standard library.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Separators that str.isspace() counts and White_Space does not.
NOT_SPACE = range(0x1C, 0x20)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
        elif ch.isspace() and c not in NOT_SPACE:
            out[c] = SPACE
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    return out


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state behind a character, and whether a piece begins at it."""
    sign = kind in (OTHER, SHORT, LONG)
    if state in (ONE, TWO):
        return (START if state == ONE else ONE), False
    if state == LED:
        return LETTERS if kind == LETTER else NUMBERS if kind == NUMBER else OTHERS, False
    if (state, kind) in ((LETTERS, LETTER), (NUMBERS, NUMBER), (SPACES, SPACE)) or (state == OTHERS and sign):
        return state, False
    return {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: ONE, LONG: TWO, SPACE: SPACES, LAST: START, LEAD: LED}[kind], True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Maps of states that characters and their sequences make, numbered: the map of each class (those of a document's first
    character, which forget the state, behind them), the products of maps, the state to which each takes START, whether a piece
    begins by (state, class), and the number of the map that changes nothing."""
    states = range(8)
    plain = [tuple(_step(s, k)[0] for s in states) for k in range(8)]
    first = [(m[START],) * 8 for m in plain]
    found = {m: None for m in [tuple(states), *plain, *first]}
    waiting = list(found)
    while waiting:
        m = waiting.pop()
        for g in plain + first:
            new = tuple(g[s] for s in m)
            if new not in found:
                found[new] = None
                waiting.append(new)
    number = {m: i for i, m in enumerate(found)}
    products = np.array([[number[tuple(b[s] for s in a)] for b in found] for a in found], dtype=np.int16)
    begins = np.array([[_step(s, k)[1] for k in range(8)] for s in states])
    return np.array([number[m] for m in plain + first], dtype=np.int16), products, np.array([m[START] for m in found], dtype=np.uint8), begins, number[tuple(states)]


def scan_states(maps: np.ndarray) -> np.ndarray:
    """The state before each character, given the number of its map: a scan within rows, one over the rows, and their product."""
    _, products, from_start, _, same = automaton()
    many, flat = np.int32(len(products)), products.ravel()
    rows = -(-len(maps) // ROW)
    acc = np.full(rows * ROW, same, dtype=np.int16)
    acc[: len(maps)] = maps
    acc = np.ascontiguousarray(acc.reshape(rows, ROW).T)
    for j in range(1, ROW):
        acc[j] = flat.take(acc[j - 1] * many + acc[j])
    ahead = np.append(np.int16(same), acc[-1][:-1])
    step = 1
    while step < rows:
        ahead[step:] = flat.take(ahead[:-step] * many + ahead[step:])
        step *= 2
    before = np.empty_like(acc)
    before[0] = ahead
    before[1:] = flat.take(ahead[None, :] * many + acc[:-1])
    return from_start[before.T.ravel()[: len(maps)]]


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Places in an array of code points at which pieces begin. doc_starts: where its documents begin, none of them empty."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    first = np.zeros(n + 2, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    kind = code_point_classes()[points]
    # a run's last space, if its document goes on
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1 : n + 1]
    kind[last] = LAST
    kind[last & (points == 0x20)] = LEAD
    # apostrophes before the letters of a contraction that stand in their document
    at = np.flatnonzero(points == ord("'"))
    at = at[~first[at + 1]]
    one = points[at + 1]
    kind[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    more = at + 2 < n
    at, one = at[more], one[more]
    two = points[at + 2]
    pair = np.zeros(len(at), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        pair |= (one == ord(a)) & (two == ord(b))
    kind[at[pair & ~first[at + 2]]] = LONG
    maps = automaton()[0][kind + np.where(first[:n], 8, 0)]
    state = scan_states(maps)
    return np.flatnonzero(automaton()[3][state, kind] | first[:n])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of neighbours with the smallest rank, the leftmost of equals, is merged until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT_PIECE:
        return _merge_long(piece, ranks)
    rank, none = ranks.get, len(ranks)
    at = list(range(len(piece) + 1))
    pairs = [rank(piece[i : i + 2], none) for i in at[:-2]]
    while pairs and (least := min(pairs)) < none:
        k = pairs.index(least)
        del at[k + 1], pairs[k]
        if k < len(pairs):
            pairs[k] = rank(piece[at[k] : at[k + 2]], none)
        if k:
            pairs[k - 1] = rank(piece[at[k - 1] : at[k + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() with a heap of pairs, so that long pieces cost n log n."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins at a place, 0 for one that was merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue  # one of the two was merged since
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceCache(dict):
    """Numbers of pieces; a piece that is not there is merged once. ids(numbers) are the pieces' ids in a row."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.chars, self.flat, self.ends = ranks, 0, array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.flat.extend(merge(piece.encode(), self.ranks))
        self.ends.append(len(self.flat))
        self.chars += len(piece)
        self[piece] = number = len(self.ends) - 2
        return number

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has; a full cache is emptied afterwards."""
        flat, ends = np.frombuffer(self.flat, dtype=np.int32), np.frombuffer(self.ends, dtype=np.int64)
        many = (ends[1:] - ends[:-1])[numbers]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out = flat[np.repeat(ends[:-1][numbers], many) + place]
        del flat, ends  # the arrays can grow again
        if self.chars > CACHE_CHARS:
            self.clear()
            self.chars, self.flat, self.ends = 0, array("i"), array("q", [0])
        return out, many


def encode_texts(texts: list[str], cache: PieceCache, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, the place of each token's first byte in its text, and how many ids each text has."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
    doc_starts = np.cumsum(sizes) - sizes
    starts = piece_starts(points, doc_starts[sizes > 0])
    bounds = [*starts.tolist(), len(whole)]
    numbers = np.fromiter((cache[whole[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)), dtype=np.int64, count=len(starts))
    ids, many = cache.ids(numbers)
    upto = np.concatenate([[0], np.cumsum(many)])
    ends = np.append(doc_starts[1:], len(whole))
    of_text = upto[np.searchsorted(starts, ends)] - upto[np.searchsorted(starts, doc_starts)]
    length = token_bytes[ids]
    place = np.cumsum(length) - length
    first = np.cumsum(of_text) - of_text
    base = np.append(place, 0)[np.minimum(first, len(place))]
    return ids, place - np.repeat(base, of_text), of_text


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of CHUNK together, or of one larger row."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > CHUNK:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, starts array<int>) of each document: token ids by the file of ranks, and the place of each token's
    first byte in the UTF-8 text. Special tokens' strings are ordinary text.

    One pass without a shuffle; a task's memory is bounded by a batch, its longest text and the cache. A null text is empty and
    has no ids. Null and repeated ids stay; id_col is cast to long, other columns are ignored. An empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        cache, token_bytes = PieceCache(ranks), np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        token_bytes[list(ranks.values())] = [len(b) for b in ranks]
        for batch in batches:
            sizes = [len(s) if (s := t.as_buffer()) is not None else 0 for t in batch.column(1)]
            for a, b in _chunks(sizes):
                part = batch.slice(a, b - a)
                ids, starts, many = encode_texts([t or "" for t in part.column(1).to_pylist()], cache, token_bytes)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids, many, pa.int32()), _lists(starts, many, pa.int32())], names=["id", "ids", "starts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, starts array<int>")


def decoded_bytes(ids: np.ndarray, starts: np.ndarray, size: int, blob: np.ndarray, place: np.ndarray, length: np.ndarray) -> bytes:
    """Bytes of one document: each token's bytes at its start, CHUNK tokens at a time."""
    out = np.zeros(size, dtype=np.uint8)
    for at in range(0, len(ids), CHUNK):
        part, to = ids[at : at + CHUNK], starts[at : at + CHUNK]
        n = length[part]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = blob[np.repeat(place[part], n) + step]
    return out.tobytes()


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", starts_col: str = "starts", out_col: str = "decoded") -> DataFrame:
    """encoded with a binary column more: the bytes of its tokens, each put at its start. A range of tokens whose starts are not
    from 0 decodes to its own bytes alone. Other columns stay; one that has the name of the new column is replaced. Null ids
    give null. Ids that the vocabulary lacks and starts with gaps or overlaps are errors."""
    kept = [f for f in encoded.schema.fields if f.name != out_col]
    i, j = (next(k for k, f in enumerate(kept) if f.name == c) for c in (ids_col, starts_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        length[list(ranks.values())] = [len(b) for b in ranks]
        place = np.cumsum(length) - length
        blob = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8)
        for batch in batches:
            lists = batch.column(i)
            for a, b in _chunks(np.diff(np.asarray(lists.offsets)).tolist()):
                part = batch.slice(a, b - a)
                out: list[bytes | None] = []
                for tokens, places in zip(part.column(i), part.column(j), strict=True):
                    if tokens.values is None or places.values is None:
                        out.append(None)
                        continue
                    ids, starts = tokens.values.to_numpy(zero_copy_only=False), places.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or not length[ids].all()):
                        raise ValueError("an id that the vocabulary does not have")
                    if len(ids) != len(starts) or (len(ids) and (np.diff(starts) != length[ids[:-1]]).any()):
                        raise ValueError("starts do not fit the ids")
                    base = starts[0] if len(starts) else 0
                    out.append(decoded_bytes(ids, starts - base, int(length[ids].sum()), blob, place, length))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])

    return encoded.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.BinaryType())]))
