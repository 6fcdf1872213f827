"""Quality classifier: supervised subword embeddings.

Every word gives hashed features, itself and its character n-grams between word-boundary marks; each feature has a
learned vector, a document is the average of the vectors of all its features, and a softmax layer gives the label.
Vectors and output layer are trained by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
As the average and the output layer are linear, a trained model scores a document with one number a feature.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import labelled_sample, map_batches

#: Most labelled rows of either label that training takes, by the order of a hash of the id, and most characters of them.
SAMPLE_ROWS = {0: 1200, 1: 1200}
SAMPLE_CHARS = {0: 4_000_000, 1: 4_000_000}
BUCKETS = 1 << 18
DIMENSIONS = 12
NGRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.6
#: Words whose sums a task keeps; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Longer words are cut into parts of this many characters, each a word of its own.
LONGEST_WORD = 64


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word: itself, and the n-grams of <word>."""
    out = []
    for at in range(0, len(word), LONGEST_WORD):
        part = f"<{word[at : at + LONGEST_WORD]}>"
        raw = [part.encode("utf-32-le")]
        whole = raw[0]
        raw += [whole[4 * i : 4 * (i + n)] for n in NGRAMS for i in range(len(part) - n + 1)]
        out += [zlib.crc32(r) & (buckets - 1) for r in raw]
    return out


@dataclass
class QualityModel:
    """value: what each bucket adds to the log-odds of label 1; bias: what every document starts from."""

    value: np.ndarray
    bias: float


def _bag(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, with their shares of all its features."""
    parts = []
    for w in text.split():
        got = known.get(w)
        if got is None:
            if len(known) > CACHE_WORDS // 4:
                known.clear()
            got = known[w] = np.array(features(w), dtype=np.int32)
        parts.append(got)
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids.astype(np.int32), (n / n.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over shuffled documents, rate falling to zero; classes weigh the same. With rows of one
    class only, or none, every document scores the share of label 1 (one half for none)."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return QualityModel(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    known: dict[str, np.ndarray] = {}
    bags = [_bag(t, known) for t in texts]
    known.clear()
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            rate = RATE * (1 - step / steps)
            step += 1
            ids, share = bags[k]
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, dtype=np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= np.float32(weight[y[k]])
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            if len(ids):
                # the mean spreads a document's step over many features: scaled up so that a feature's own step is of the order of the rate
                vectors[ids] -= (rate * 40.0 * share)[:, None] * back
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Train on at most SAMPLE_ROWS rows and SAMPLE_CHARS characters of each label among the rows where `learn` holds."""
    return train(*labelled_sample(docs, labels, learn, id_col, text_col, label_col, SAMPLE_ROWS, SAMPLE_CHARS))


def _scorer(shared):
    def make():
        model = shared.value
        known: dict[str, complex] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            scores = np.empty(len(texts))
            for i in range(len(texts)):
                words = (texts[i].as_py() or "").split()
                for w in set(words).difference(known):
                    f = features(w)
                    known[w] = complex(float(model.value[f].sum(dtype=np.float64)), len(f))
                total = sum(map(known.__getitem__, words), 0j)
                z = model.bias + (total.real / total.imag if words else 0.0)
                scores[i] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                if len(known) > CACHE_WORDS:
                    known.clear()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])

        return step

    return make


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the probability of label 1 of the whole text. Null and empty texts score by the bias alone;
    repeated ids give repeated rows; other columns are ignored; an empty table gives an empty result. The model sent to
    tasks has a fixed size, 4 bytes a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _scorer(shared), "id long, score double")
