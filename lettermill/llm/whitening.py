"""Embedding whitening by incremental eigendecomposition.

A task holds the spectrum (values and vectors) of the scatter of the vectors it has read. Each further vector, centred by
the running mean, is a rank-one change: the roots of its secular equation are the new values, and directions that it does not
touch, or that share a value, are left out first (deflation). Spectra of tasks are combined in a tree, one spectrum's directions
being so many rank-one changes of the other's. The leading directions are then refined over all vectors by Rayleigh-Ritz
steps: tasks sum up V Q for a few columns Q, residuals widen Q until they are at rounding level.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import discard, staged
from lettermill.llm.vectors import matrix, whole_vectors

#: Components that are returned, and directions beside them that are refined.
COMPONENTS, GUARD = 4, 8
#: Spectra that one task combines.
FAN = 8
#: Refining steps at most, and the residual that ends them, in multiples of the largest value.
STEPS, RESIDUAL = 12, 1e-15
EPS = np.finfo(np.float64).eps


def _smaller_root(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of c t^2 - a t + b that lies between two poles."""
    with np.errstate(all="ignore"):
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        return np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', d rising without equals, no z zero, rho positive; and the matrix d[j] - root[i].

    Root i lies between d[i] and d[i + 1], the last at most rho |z|^2 above. Each is sought as a distance from its nearer pole,
    which keeps differences exact to rounding: a step fits a rational function with the two poles around (one for the last
    root) to both halves of the sum; one that leaves the bracket is a bisection.
    """
    k = len(d)
    z2 = rho * z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    half = (upper - d) / 2
    at = np.arange(k)
    beside = np.minimum(at + 1, k - 1)
    term = z2 / ((d[None, :] - d[:, None]) - half[:, None])
    f = 1 + term.sum(axis=1)
    left = f >= 0
    left[-1] = True
    origin = np.where(left, at, beside)
    gap = d[None, :] - d[origin][:, None]
    lo, hi = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    hi[-1] = 2 * half[-1]
    # the first guess keeps the two poles around and what the others add in the middle
    c, pair = f - term[at, at] - term[at, beside], z2 + z2[beside]
    t = _smaller_root(c, np.where(left, 2 * half * c, -2 * half * c) + pair, np.where(left, z2, -z2[beside]) * 2 * half)
    t = np.where(np.isfinite(t) & (t > lo) & (t < hi), t, (lo + hi) / 2)
    t[-1] = half[-1]
    below = (at[None, :] <= at[:, None]).astype(float)
    live = at
    for _ in range(100):
        delta = gap[live] - t[live, None]
        term = z2 / delta
        slope = term / delta
        side = below[live]
        low, d_low = np.einsum("ij,ij->i", side, term), np.einsum("ij,ij->i", side, slope)
        f, d_high = 1 + term.sum(axis=1), slope.sum(axis=1) - d_low
        up = f < 0
        lo[live[up]], hi[live[~up]] = t[live[up]], t[live[~up]]
        width = hi[live] - lo[live]
        going = (np.abs(f) > 4 * EPS * (1 + np.abs(term).sum(axis=1))) & (width > 2 * EPS * np.maximum(np.abs(lo[live]), np.abs(hi[live])))
        if not going.any():
            break
        live, delta, f, low, d_low, d_high = live[going], delta[going], f[going], low[going], d_low[going], d_high[going]
        row = np.arange(len(live))
        p, q = delta[row, live], delta[row, np.minimum(live + 1, k - 1)]
        with np.errstate(all="ignore"):
            c = f - p * d_low - q * d_high
            a = (p + q) * f - p * q * (d_low + d_high)
            move = _smaller_root(c, a, p * q * f)
            last = live == k - 1
            move = np.where(last, p + p * p * d_low / (1 + low - p * d_low), move)
            new = t[live] + move
        inside = np.isfinite(new) & (new > lo[live]) & (new < hi[live])
        t[live] = np.where(inside, new, (lo[live] + hi[live]) / 2)
    t = np.where(t == 0, np.where(left, hi, lo), t)
    return d[origin] + t, gap - t[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (values rising, vectors as columns) of q diag(d) q' + rho v v', rho positive."""
    z = q.T @ v
    norm = np.sqrt(z @ z)
    if norm == 0 or rho <= 0:
        return d, q
    z, rho = z / norm, rho * norm * norm
    small = 8 * EPS * max(np.abs(d).max(), rho)
    near = np.diff(d) <= small
    if near.any():
        # directions that share a value are turned until only the last of them has a part in v
        q = q.copy()
        starts = np.flatnonzero(~np.concatenate([[False], near]))
        for a, b in zip(starts, [*starts[1:], len(d)], strict=True):
            part = z[a:b]
            size = np.sqrt(part @ part)
            if b - a > 1 and size > 0:
                turned = -size if part[-1] > 0 else size
                u = part.copy()
                u[-1] -= turned
                q[:, a:b] -= np.outer(q[:, a:b] @ u, u * (2 / (u @ u)))
                z[a:b] = 0
                z[b - 1] = turned
    some = rho * np.abs(z) > small
    if not some.any():
        return d, q
    d, q, z = d.copy(), q.copy(), z[some]
    old = d[some]
    if len(old) == 1:
        d[some] = old + rho * z * z
    else:
        roots, gap = secular_roots(old, z, rho)
        # the z for which these roots are exact: their vectors are orthogonal to rounding
        k = len(old)
        i, j = np.arange(k)[:, None], np.arange(k)[None, :]
        shifted = np.where(i < j, old[:, None], np.append(old[1:], 0)[:, None]) - old[None, :]
        shifted[-1] = 1
        ratio = -gap / shifted
        exact = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(z)
        vectors = exact[:, None] / gap.T
        vectors /= np.sqrt(np.square(vectors).sum(axis=0))
        d[some], q[:, some] = roots, q[:, some] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Number, mean, and spectrum of the scatter (sum of centred products) of vectors."""

    def __init__(self, dims: int, n: int = 0, mean: np.ndarray | None = None, values: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.n = n
        self.mean = np.zeros(dims) if mean is None else mean
        self.values = np.zeros(dims) if values is None else values
        self.vectors = np.eye(dims) if vectors is None else vectors

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, (self.n - 1) / self.n)

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        n, away = self.n + other.n, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n


SPECTRA = "part long, n long, mean binary, vals binary, vecs binary"


def _row(part: int, s: Spectrum) -> list[pa.Array]:
    return [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *[pa.array([np.ascontiguousarray(a).astype("<f8").tobytes()], pa.binary()) for a in (s.mean, s.values, s.vectors)]]


def _spectrum(r, dims: int) -> Spectrum:
    mean, values, vectors = (np.frombuffer(bytes(r[c]), dtype="<f8").copy() for c in ("mean", "vals", "vecs"))
    return Spectrum(dims, r["n"], mean, values, vectors.reshape(dims, dims))


def _spectra(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dims)
        for batch in batches:
            for x in matrix(batch.column(0), dims).astype(np.float64):
                s.add(x)
        if s.n:
            yield pa.RecordBatch.from_arrays(_row(TaskContext.get().partitionId(), s), names=["part", "n", "mean", "vals", "vecs"])

    return run


def _combiner(dims: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])  # FAN at most
        s = _spectrum(rows[0], dims)
        for r in rows[1:]:
            s.combine(_spectrum(r, dims))
        return pa.Table.from_arrays(_row(rows[0]["part"] // FAN, s), names=["part", "n", "mean", "vals", "vecs"])

    return run


def whole_spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """Spectrum of all rows of fit (x binary): a row of dims * (dims + 2) numbers a task, FAN of them combined at a time."""
    rows = staged(fit.select("x").mapInArrow(_spectra(dims), SPECTRA), "spectra")
    while (rows.agg(F.max("part")).first()[0] or 0) > 0:
        old, rows = rows, staged(rows.groupBy(F.expr(f"part div {FAN}").alias("up")).applyInArrow(_combiner(dims), SPECTRA), "spectra")
        discard(old)
    out = _spectrum(rows.first(), dims)
    discard(rows)
    return out


def _totals(dims: int):
    """Number and sums by component of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, [0] * dims, 0
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n += len(x)
            most = max([most, -int(x.min(initial=0)), int(x.max(initial=0))])
            total = [a + b for a, b in zip(total, x.sum(axis=0, dtype=object if most > 2**40 else np.int64).tolist(), strict=True)]
        if n:
            columns = [range(dims), [n] * dims, [Decimal(s) for s in total], [Decimal(most)] * dims]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)), strict=True)], names=["dim", "n", "s", "most"])

    return run


class Centre:
    """Rows minus their mean S / n: exact as n * x - S, in 64-bit numbers where these suffice."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums = n, sums
        self.safe = len(sums) * (2 * n * most) ** 2 < 2**62

    def exact(self, x: np.ndarray) -> np.ndarray:
        kind = np.int64 if self.safe else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(np.float64)


def _summed(fit: DataFrame, dims: int, rows: int, columns: int, product) -> np.ndarray:
    """Sum over fit of product(x), a matrix of rows x columns: each task gives its own sum, sums of tasks are added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((rows, columns)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(at, 4096), dims)
                total += product(x)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    added = fit.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # rows * columns numbers
    out = np.zeros(rows * columns)
    for r in added:
        out[r["place"]] = r["value"]
    return out.reshape(rows, columns)


def refine(fit: DataFrame, centre: Centre, start: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the leading components of the covariance of fit, from a basis near them. A step takes
    V Q over all rows and solves the small problem Q' V Q; what is left over (residuals) joins the basis, until it is at
    rounding level, no longer falls, or the basis is the whole space."""
    dims, n = start.shape[0], centre.n
    q, before = np.linalg.qr(start)[0], np.inf
    for _ in range(STEPS):
        image = _summed(fit, dims, dims, q.shape[1], lambda x, q=q: (c := centre(x)).T @ (c @ q)) / n
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        rest = image @ turn - vectors * values
        worst = np.sqrt(np.square(rest[:, :components]).sum(axis=0)).max()
        if worst <= RESIDUAL * max(values[0], 0) or worst >= before / 2 or q.shape[1] == dims:
            break
        before = worst
        # as many directions as before lead, their residuals join them
        lead = min(start.shape[1], dims)
        wider = [*vectors[:, :lead].T]
        for r in rest[:, :lead].T:
            for _ in range(2):
                r = r - np.array(wider).T @ (np.array(wider) @ r)
                size = np.sqrt(r @ r)
                r = r / size if size > 0 else r
            if size > 0 and len(wider) < dims:
                wider.append(r)
        q = np.linalg.qr(np.array(wider).T)[0]
    return values[:components], vectors[:, :components] / np.sqrt(np.square(vectors[:, :components]).sum(axis=0))


RESULT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and leading component.

    Vectors that are null or hold null or non-finite components are dropped; others are taken as floor(256 * component), those
    shorter than the longest filled up with zeros. The covariance is over the n distinct ones. Components are numbered from 1 by
    falling variance, as many as there are dimensions at most. whitened is the vector minus the mean, projected on the component,
    over the root of its variance; explained the component's share of all variance; deviation the sum over dimensions of
    (n * x - S) ** 2, S the sums of the distinct vectors; identity_error the largest absolute entry of whitened's covariance minus
    the identity over the components. Components without variance have a null whitened value and do not count in identity_error, which is null if none
    counts; explained is null if there is no variance at all. Directions of equal variance are any of their space. Null and
    repeated ids stay; other columns are ignored; an empty table gives an empty result.

    The distinct vectors are a shuffle on their values with partial aggregation; what reaches the driver are dims x (components +
    guard) numbers a step and one spectrum, whatever the number of rows.
    """
    rows = staged(whole_vectors(vectors, id_col, vector_col), "whole")
    longest = rows.agg(F.max(F.octet_length("x"))).first()[0]
    result = f"{RESULT}, identity_error double"
    if not longest:  # no rows, or empty vectors only
        discard(rows)
        return vectors.sparkSession.createDataFrame([], result)
    dims = longest // 8
    filled = rows.select("id", F.rpad("x", longest, F.lit(bytes(1))).alias("x"))
    fit = staged(filled.select("x").distinct(), "fit")
    sums = fit.mapInArrow(_totals(dims), "dim int, n long, s decimal(38,0), most decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).orderBy("dim").collect()
    centre = Centre(sums[0]["n"], [int(r["s"]) for r in sums], max(int(r["most"]) for r in sums))
    n, components = centre.n, min(components, dims)
    rough = whole_spectrum(fit, dims)
    values, axes = refine(fit, centre, rough.vectors[:, ::-1][:, : min(dims, components + GUARD)], components)
    trace = float(_summed(fit, dims, 1, 1, lambda x: np.square(centre(x)).sum()[None, None])[0, 0] / n)
    scale = np.sqrt(np.where(values > 64 * EPS * trace, values, np.nan))

    def project(x: np.ndarray) -> np.ndarray:
        return (centre(x) @ axes) / scale

    varied = np.flatnonzero(np.isfinite(scale))
    error = None
    if len(varied):
        k = len(varied)
        sums_and_products = _summed(fit, dims, k + 1, k, lambda x: np.vstack([(y := project(x)[:, varied]).sum(axis=0), y.T @ y])) / n
        mean = sums_and_products[0]
        error = float(np.abs(sums_and_products[1:] - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / trace if trace > 0 else np.full(components, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            deviation = np.square(centre.exact(x)).sum(axis=1).tolist()
            m = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), components))),
                pa.array(np.tile(np.arange(1, components + 1), m), pa.int32()),
                pa.array(np.full(m * components, n), pa.int64()),
                pa.array([d for v in deviation for d in [Decimal(v)] * components], pa.decimal128(38, 0)),
                pa.array(project(x).ravel(), from_pandas=True),
                pa.array(np.tile(explained, m), from_pandas=True),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained"])

    discard(fit)
    return filled.mapInArrow(run, RESULT).withColumn("identity_error", F.lit(error).cast("double"))
