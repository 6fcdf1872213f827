"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all character subsequences of three and four characters that both contain, the products
of their weights; an occurrence that spans s characters weighs DECAY ** s, so a gap or an inserted character lowers the
value but does not end the match. Words are taken with boundary marks and without punctuation, and divided by a norm that
depends on their length. Landmarks are words of the training rows; the Nyström map makes a vector of the kernel values of
a word and the landmarks.

Labels belong to documents, insults to single words: the machine is trained in rounds (multiple instances), each taking the
strongest words of each labelled row as its instances, and a document scores by a logistic function of its three strongest
distinct words, fitted to the labels. Since a kernel value with a fixed landmark is a sum over the word's subsequences, the
trained machine folds into one weight for each subsequence, exactly, and scoring never touches the landmarks again.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import labelled_sample, map_batches

#: Most labelled rows of either label that training takes, by the order of a hash of the id, and most characters of a
#: label's rows together (rows beyond are left out whole). Clean rows are the many: what toxic rows say by chance must show there too.
SAMPLE_ROWS = {1: 1000, 0: 3500}
SAMPLE_CHARS = {1: 3_000_000, 0: 9_000_000}
LANDMARKS = 240
DECAY = 0.7
#: Longest span of a subsequence, by its length: up to two and three inserted characters.
SPANS = {3: 5, 4: 7}
#: A word of a toxic row is an instance, in place of the row's strongest word, from these log-odds and this share of toxic rows on.
ODDS = 3.0
SHARE = 0.01
PENALTY = 1e-5
ROUNDS = 6
#: A toxic row counts for so many clean ones when values become probabilities: training values of toxic rows are higher than others.
TOXIC_WEIGHT = 2.0
COPY_MINIMA = 12
#: A longer word counts as overlapping parts of this many symbols.
LONGEST_WORD = 32
#: At least so many one-letter words in a row are also read as one word.
SPELT = 4
#: Words of the machine that are widened to doubles at once.
MACHINE_ROWS = 4096
#: A document's score rests on the values of so many strongest words; values that agree to so many digits are one.
TOP = 3
VALUE_DIGITS = 4
CACHE_WORDS = 250_000
CHARS_AT_ONCE = 1_000_000
START, END = 30, 31
SIZES = {3: 1 << 15, 4: 1 << 20}
OFFSET = {3: 0, 4: SIZES[3]}
CODES = SIZES[3] + SIZES[4]
#: Position offsets of each subsequence from its first character.
SHAPES = {p: [(0, *rest) for rest in combinations(range(1, span), p - 1)] for p, span in SPANS.items()}


def _symbol(ch: str) -> int:
    """1 to 26 for a letter with or without accents, 27 to 29 for other letters, 0 for what does not count. Digits and signs
    that stand for a letter count as that letter."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if ch in LOOKALIKE:
        return ord(LOOKALIKE[ch]) - 96
    base = unicodedata.normalize("NFKD", ch)[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(ch) % 3 if ch.isalpha() else 0


# Digits that commonly stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_known: dict[str, int] = {}


def symbols(word: str) -> list[int]:
    """Symbols of a lower-case word. A word without letters has none."""
    if not any(map(str.isalpha, word)):
        return []
    out = []
    for ch in word:
        s = _known.get(ch)
        if s is None:
            s = _known[ch] = _symbol(ch)
        if s:
            out.append(s)
    return out


def parts(word: str) -> list[list[int]]:
    """The word's symbols between boundary marks; a long one as overlapping parts."""
    s = symbols(word)
    if len(s) < 2:
        return []
    s = [START, *s, END]
    return [s] if len(s) <= LONGEST_WORD + 2 else [s[i : i + LONGEST_WORD] for i in range(0, len(s) - LONGEST_WORD // 2, LONGEST_WORD // 2)]


def occurrences(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences of words of one length (words x length): their codes and their weights, over the length's norm."""
    n, length = block.shape
    codes, weights = [], []
    for p, shapes in SHAPES.items():
        for shape in shapes:
            k = length - shape[-1]
            if k <= 0:
                continue
            code = np.zeros((n, k), dtype=np.int32)
            for o in shape:
                code = (code << 5) | block[:, o : o + k]
            codes.append(code + OFFSET[p])
            weights.append(np.full(k, DECAY ** (shape[-1] + 1), dtype=np.float32))
    if not codes:
        return np.zeros((n, 0), dtype=np.int32), np.zeros(0, dtype=np.float32)
    w = np.concatenate(weights)
    return np.concatenate(codes, axis=1), w / np.sqrt((w * w).sum())


def blocks(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """All parts of words, in blocks of one length and at most 4096 rows: (places in words, rows x length)."""
    by: dict[int, tuple[list[int], list[list[int]]]] = {}
    for i, w in enumerate(words):
        for s in parts(w):
            at, rows = by.setdefault(len(s), ([], []))
            at.append(i)
            rows.append(s)
    return [(np.array(at[i : i + 4096]), np.array(rows[i : i + 4096], dtype=np.uint8)) for at, rows in by.values() for i in range(0, len(at), 4096)]


def valued(n: int, made: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    """For each of n words, the sum of the table's weights over its subsequences, the largest part's for a long one; -inf for
    a word without symbols."""
    out = np.full(n, -np.inf, dtype=np.float32)
    for at, block in made:
        codes, weights = occurrences(block.astype(np.int32))
        np.maximum.at(out, at, table[codes] @ weights)
    return out


def values(words: list[str], table: np.ndarray) -> np.ndarray:
    """valued() of some words."""
    return valued(len(words), blocks(words), table)


def by_length(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """All parts of words as blocks of one length: (places in words, words x length)."""
    groups: dict[int, tuple[list[int], list[list[int]]]] = {}
    for i, w in enumerate(words):
        for s in parts(w):
            at, rows = groups.setdefault(len(s), ([], []))
            at.append(i)
            rows.append(s)
    return {n: (np.array(at), np.array(rows, dtype=np.int32)) for n, (at, rows) in groups.items()}


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes that the words have, sorted, and the words' weights on them (words x codes)."""
    rows, cols, vals = [], [], []
    for at, block in by_length(words).values():
        codes, weights = occurrences(block)
        rows.append(np.repeat(at, codes.shape[1]))
        cols.append(codes.ravel())
        vals.append(np.tile(weights, len(at)))
    known, at = np.unique(np.concatenate(cols), return_inverse=True)
    out = np.zeros((len(words), len(known)), dtype=np.float32)
    np.add.at(out, (np.concatenate(rows), at), np.concatenate(vals))
    return known, out


def _kernel(words: list[str], known: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks."""
    place = np.full(CODES, len(known), dtype=np.int32)
    place[known] = np.arange(len(known))
    by_code = np.vstack([landmarks.T, np.zeros((1, len(landmarks)), dtype=np.float32)])
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for at, block in by_length(words).values():
        codes, weights = occurrences(block)
        for i in range(0, len(at), 64):
            np.add.at(out, at[i : i + 64], np.einsum("k,nkm->nm", weights, by_code[place[codes[i : i + 64]]], optimize=True))
    return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    size = z.shape[1] + 1
    beta = np.zeros(size)
    ridge = np.full(size, PENALTY)
    ridge[-1] = 1e-6
    wide = lambda rows: np.hstack([z[rows], np.ones((len(rows), 1), dtype=z.dtype)]).astype(np.float64)
    steps = range(0, len(z), MACHINE_ROWS)  # z stays as it is, only a step's rows are widened
    given = lambda b: np.concatenate([z[i : i + MACHINE_ROWS].astype(np.float64) @ b[:-1] + b[-1] for i in steps])
    loss = lambda b: ridge @ (b * b) + weight @ np.maximum(0, 1 - y * given(b)) ** 2
    for _ in range(50):
        inside = np.flatnonzero(y * given(beta) < 1)
        both, right = np.diag(ridge), np.zeros(size)
        for i in range(0, len(inside), MACHINE_ROWS):
            at = inside[i : i + MACHINE_ROWS]
            x = wide(at)
            a = x * weight[at, None]
            both += a.T @ x
            right += a.T @ y[at]
        move = np.linalg.solve(both, right) - beta
        now, step = loss(beta), 1.0
        while step > 1e-6 and loss(beta + step * move) >= now:
            step /= 2
        if step <= 1e-6:
            break
        beta = beta + step * move
        if now - loss(beta) < 1e-6 * now:
            break
    return beta[:-1], float(beta[-1])


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none negative, and shift that make probabilities of decision values (rows x TOP), by Platt's targets and Newton
    steps; a row of label 1 weighs TOXIC_WEIGHT. A value whose slope would be negative is left out."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    used = np.ones(f.shape[1], dtype=bool)
    while True:
        x = np.hstack([f[:, used], np.ones((len(f), 1))])
        start = np.append(np.full(used.sum(), 1 / used.sum()), 0.0)
        beta = start.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
            move = np.linalg.solve(h, x.T @ (w * (p - t)) + 1e-2 * (beta - start))
            beta -= np.clip(move, -2, 2)
        if used.sum() == 1 or (beta[:-1] >= 0).all():
            slopes = np.zeros(f.shape[1])
            slopes[used] = np.maximum(beta[:-1], 0.05)
            return slopes, float(beta[-1])
        used[np.flatnonzero(used)[np.argmin(beta[:-1])]] = False


@dataclass
class ToxicityModel:
    """table: a weight for each subsequence; a document scores sigmoid(slopes * (values of its strongest words) + shift)."""

    table: np.ndarray
    slopes: np.ndarray
    shift: float


def strongest_values(values: Iterable[float]) -> list[float]:
    """The TOP largest distinct values; the last is repeated where there are fewer, none of no values. Words that are written
    apart by signs only have one value, so they count once."""
    top = nlargest(TOP, set(values))
    return top + top[-1:] * (TOP - len(top)) if top else []


def spelt(words: list[str]) -> list[str]:
    """Words that are spelt out as SPELT or more one-letter words in a row."""
    out, run = [], []
    if list(map(len, words)).count(1) < SPELT:
        return out
    for w in [*words, ""]:
        if len(w) == 1 and w.isalnum():
            run.append(w)
            continue
        if len(run) >= SPELT:
            out.append("".join(run))
        run = []
    return out


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    return words + spelt(words)


def distinct_rows(texts: list[str]) -> list[int]:
    """Rows without near copies of earlier ones, by COPY_MINIMA minima over hashes of four words in a row: what a copied text says by
    chance would else count as often as it was copied."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, text in enumerate(texts):
        words = text.split()
        hashes = np.fromiter((zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))), dtype=np.uint32)
        low = {(n, int(((hashes ^ (hashes >> np.uint32(15))) * np.uint32(m)).min())) for n, m in enumerate(range(2654435761, 2654435761 + 2 * COPY_MINIMA, 2))}
        if not low & seen:
            out.append(k)
        seen |= low
    return out


def _learn(held: list[np.ndarray], y: np.ndarray, rows: list[int], vocabulary: list[str], made: list[tuple[np.ndarray, np.ndarray]], seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """The machine of some rows, given as places in the vocabulary: its table, its bias and the values of all words."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, len(vocabulary)))
    for k in rows:
        seen[y[k]][held[k]] += 1
    toxic_rows, clean_rows = max(1, sum(y[k] == 1 for k in rows)), max(1, sum(y[k] == 0 for k in rows))
    odds = np.log((seen[1] + 0.5) / toxic_rows) - np.log((seen[0] + 0.5) / clean_rows)
    often = max(3, SHARE * toxic_rows)
    value = odds
    landmarks: list[str] = []
    clean = np.zeros(len(vocabulary))
    table = np.zeros(CODES, dtype=np.float32)
    own = np.flatnonzero(seen.sum(axis=0))
    for turn in range(ROUNDS):
        strongest = []
        for k in rows:
            mine = held[k]
            first = mine[np.argsort(-value[mine], kind="stable")[: 1 if y[k] else 4]]
            told = mine[(odds[mine] >= ODDS) & (seen[1][mine] >= often)] if y[k] else first
            strongest.append(told if len(told) else first)
        if turn < 2:  # landmarks: the words taken for insults most often, strong words of clean rows, and any words
            taken = np.bincount(np.concatenate([s for k, s in zip(rows, strongest, strict=True) if y[k]]), minlength=len(vocabulary))
            first = np.argsort(-taken, kind="stable")[: LANDMARKS // 2]
            rival = np.unique(np.concatenate([s for k, s in zip(rows, strongest, strict=True) if not y[k]] or [np.zeros(0, dtype=np.int64)]))
            rival = rng.permutation(rival)[: LANDMARKS // 4]
            chosen = np.unique(np.concatenate([first[taken[first] > 0], rival, rng.choice(own, min(len(own), LANDMARKS // 4), replace=False)]))
            landmarks = [vocabulary[i] for i in chosen]
            codes, phi = _matrix(landmarks)
            e, v = np.linalg.eigh((phi @ phi.T).astype(np.float64))
            large = e > 1e-6 * e.max()
            root = v[:, large] / np.sqrt(e[large])
        # a word that a clean row ever gave is clean, in whatever toxic row it may stand; clean ones add up over the rounds
        for k, words in zip(rows, strongest, strict=True):
            if not y[k]:
                clean[words] += 1
                clean[rng.choice(held[k], 2)] += 1
        toxic = np.bincount(np.concatenate([s for k, s in zip(rows, strongest, strict=True) if y[k]]), minlength=len(vocabulary)).astype(np.float64)
        toxic[clean > 0] = 0
        words = np.concatenate([np.flatnonzero(toxic), np.flatnonzero(clean)])
        label = np.where(toxic[words] > 0, 1.0, -1.0)
        weight = np.sqrt(np.where(label > 0, toxic[words], clean[words]))
        weight /= np.where(label > 0, weight[label > 0].sum(), weight[label < 0].sum())
        z = _kernel([vocabulary[i] for i in words], codes, phi) @ root.astype(np.float32)
        beta, bias = _machine(z, label, weight)
        table = np.zeros(CODES, dtype=np.float32)
        table[codes] = (root @ beta) @ phi
        value = valued(len(vocabulary), made, table) + np.float32(bias)
    return table, bias, value


def train(texts: list[str], labels: list[int], seed: int = 5) -> ToxicityModel:
    """Train on whole labelled texts. With rows of one label only, or none, all documents score the share of label 1.

    Probabilities are fitted to the values of the rows' strongest words; toxic rows weigh TOXIC_WEIGHT.
    """
    keep = distinct_rows(texts)
    texts, labels = [texts[k] for k in keep], [labels[k] for k in keep]
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.001
        return ToxicityModel(np.zeros(CODES, dtype=np.float32), np.zeros(TOP), float(np.log(share / (1 - share))))
    known: dict[str, str] = {}  # a word is held once, however many rows have it
    bags = [sorted({known.setdefault(w, w) for w in words_of(t)}) for t in texts]
    known.clear()
    vocabulary = sorted({w for b in bags for w in b if parts(w)})
    index = {w: i for i, w in enumerate(vocabulary)}
    held = [np.array([index[w] for w in b if w in index], dtype=np.int64) for b in bags]
    del bags, index
    rows = [k for k in range(len(y)) if len(held[k])]
    made = blocks(vocabulary)
    table, bias, value = _learn(held, y, rows, vocabulary, made, seed)
    near = np.round(value, VALUE_DIGITS)
    best = np.array([strongest_values(near[held[k]].tolist()) for k in rows])
    slopes, shift = _logistic(best, y[rows])
    return ToxicityModel(table, slopes, shift + float(slopes.sum() * bias))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Train on at most SAMPLE_ROWS rows and SAMPLE_CHARS characters of each label among the rows where `learn` holds. Rows
    with a null id or label do not count; a row that is labelled twice counts with the larger label."""
    return train(*labelled_sample(docs, labels, learn, id_col, text_col, label_col, SAMPLE_ROWS, SAMPLE_CHARS))


def _batch_scorer(model: ToxicityModel):
    """Scores of an array of texts; words valued before are kept, up to CACHE_WORDS."""
    low = float(-1e30)
    told = bool(model.slopes.any())
    known: dict[str, float] = {}

    def scores(texts: pa.Array) -> np.ndarray:
        nonlocal known
        best = np.full((len(texts), TOP), low)
        at = 0
        while at < len(texts):  # some texts at a time, so that their new words are valued together
            bags, size = [], 0
            while at + len(bags) < len(texts) and size < CHARS_AT_ONCE:
                text = texts[at + len(bags)].as_py() or ""
                size += len(text)
                bags.append(set(words_of(text)))
            new = list(set().union(*(b.difference(known) for b in bags)))
            if len(known) + len(new) > CACHE_WORDS:
                known = {}
                new = list(set().union(*bags))
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                known.update(zip(some, np.round(values(some, model.table), VALUE_DIGITS).tolist(), strict=True))
            for bag in bags:
                top = strongest_values(v for v in map(known.__getitem__, bag) if v > low)
                if top:
                    best[at] = top
                at += 1
        z = np.where(best[:, 0] > low, best.dot(model.slopes) + model.shift, -30.0 if told else model.shift)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, over its whole text. Null, empty and letterless texts score next to 0 (the label's share
    if the model knows one label only); repeated ids give repeated rows; other columns are ignored; an empty table gives an
    empty result. The model sent to tasks has a fixed size, 4 bytes a subsequence code."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = _batch_scorer(shared.value)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], names=["id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; no join is needed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def make():
        scores = _batch_scorer(shared.value)
        return lambda batch: batch.filter(pa.array(scores(batch.column(place)) < threshold))

    return map_batches(docs, make, docs.schema)
