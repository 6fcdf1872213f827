"""Whitening and clustering against brute force in whole numbers, and their edge cases."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lettermill.llm import centroids, queries, whitening
from lettermill.llm.common import staged
from tests.llm.test_operators import SF

VEC = "vec_id long, embedding array<float>, label int, cluster int, n long, x int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, 9, 9) for i, v in rows], VEC)


def whole(v):
    return None if v is None or any(c is None or not np.isfinite(c) for c in v) else tuple(int(x) for x in np.floor(np.array(v, dtype=np.float64) * 256))


def plain_clusters(rows, dims, k, rounds):
    kept = [(i, whole(v)) for i, v in rows if whole(v) is not None and len(v) == dims]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], dtype="<i8").tobytes()))
    centres = [x for _, x in hashed[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        centres = [tuple(sum(c) // len(members[j]) for c in zip(*members[j], strict=True)) if members[j] else old for j, old in enumerate(centres)]
    return sorted(((i is None, i or 0, *nearest(x)[::-1]) for i, x in kept)), centres


def test_clusters_match_brute_force(spark):
    got = queries.op13_centroids(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centres = plain_clusters(rows, 64, 40, 5)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got) == want
    inertia = defaultdict(int)
    for _, _, c, d in want:
        inertia[c] += d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("dims,k,chunk", [(5, 3, 4), (3, 8, 1000), (16, 2, 7), (33, 4, 5)])
def test_clusters_edges(spark, monkeypatch, dims, k, chunk):
    monkeypatch.setattr(centroids, "ROWS", chunk)
    rng = np.random.default_rng(dims)
    rows = [(i, rng.standard_normal(dims).tolist()) for i in range(40)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (None, rng.standard_normal(dims).tolist()), (91, None), (92, []), (93, [None] * dims), (94, [float("nan")] * dims), (95, [1.0] * (dims + 1)), (96, [0.0] * dims)]
    rows += [(200 + i, [1.0] * dims) for i in range(60)]  # copies: ties, and centroids that stay empty
    told, centres = centroids.cluster_vectors(vectors_of(spark, rows), dims=dims, k=k, rounds=3)
    want, final = plain_clusters([(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows], dims, k, 3)
    assert sorted((r["id"] is None, r["id"] or 0, r["cluster"], r["distance"]) for r in told.collect()) == want
    got = defaultdict(dict)
    for r in centres.collect():
        got[r["cluster"]][r["shard"] * centroids.COLUMNS + r["column"]] = r["value"]
    assert [tuple(v for _, v in sorted(got[j].items())) for j in range(len(final))] == final


def test_clusters_of_few_and_none(spark):
    told, centres = centroids.cluster_vectors(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), dims=2, k=5)
    assert {(r["id"], r["cluster"], r["distance"]) for r in told.collect()} == {(1, 0, 0), (2, 0, 0)} and centres.count() == 4
    told, centres = centroids.cluster_vectors(vectors_of(spark, [(1, [1.0])]), dims=2)
    assert told.count() == 0 and centroids.cluster_report(told, centres).count() == 0
    with pytest.raises(Exception, match="must be below"):
        centroids.cluster_vectors(vectors_of(spark, [(1, [1e9, 0.0])]), dims=2)


def plain_whitening(rows, components):
    kept = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    dims = max(len(x) for _, x in kept)
    kept = [(i, x + (0,) * (dims - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, n, sums, values, axes, min(components, dims)


def check_whitening(got, rows, components=4, tolerance=1e-9):
    kept, n, sums, values, axes, k = plain_whitening(rows, components)
    assert len(got) == len(kept) * k
    by = defaultdict(list)
    for r in got:
        by[(r["id"] is None, r["id"] or 0)].append(r)
    signs = np.zeros(k)
    for i, x in kept:
        exact = [n * a - s for a, s in zip(x, sums, strict=True)]
        want = np.array([float(Fraction(e, n)) for e in exact]) @ axes[:, :k]
        for r in by[(i is None, i or 0)]:
            assert r["n"] == n
            j = r["component"] - 1
            if len({x for m, x in kept if m == i}) > 1:
                continue
            assert int(r["deviation"]) == sum(e * e for e in exact)
            assert abs(r["explained"] - values[j] / values.sum()) <= 1e-9
            if values[j] > 1e-9 * values[0]:
                y = want[j] / np.sqrt(values[j])
                signs[j] = signs[j] or (np.sign(y * r["whitened"]) if abs(y) > 1e-3 else 0)
                assert abs(r["whitened"] - (signs[j] or 1) * y) <= tolerance * max(1, abs(y)) or not signs[j]
            else:
                assert r["whitened"] is None
    assert all(r["identity_error"] is None or r["identity_error"] <= 1e-9 for r in got)


def test_whitening_matches_brute_force(spark):
    got = [r.asDict() | {"id": r["vec_id"]} for r in queries.op11_whitening(spark, SF).collect()]
    check_whitening(got, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0]).astype(np.float32).tolist()) for i in range(70)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (101, None), (102, [None] * 6), (103, [float("inf")] * 6), (104, [2.0, 1.0]), (105, [])]
    rows += [(300 + i, rows[0][1]) for i in range(50)]
    check_whitening([r.asDict() for r in whitening.whiten(vectors_of(spark, rows).repartition(9)).collect()], rows)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert len(got) == 2 * len(rows) and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)


def test_whitening_of_a_line_and_of_nothing(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    check_whitening([r.asDict() for r in whitening.whiten(vectors_of(spark, rows)).collect()], rows)
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(vectors_of(spark, rows)).count() == 0


def test_whitening_of_large_numbers_is_exact(spark):
    rows = [(i, [float(2**40 + 7 * i), float(i * i)]) for i in range(20)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    check_whitening([r.asDict() for r in whitening.whiten(frame).collect()], rows)


@pytest.mark.parametrize("fan", [2, 8])
def test_spectra_combine_to_the_whole(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (600, 7)) * np.array([9, 7, 5, 3, 2, 1, 1])
    rows = staged(spark.createDataFrame([(r.astype("<i8").tobytes(),) for r in x], "x binary").repartition(7), "fit")
    s = whitening.whole_spectrum(rows, 7)
    c = x - x.mean(axis=0)
    want = np.linalg.eigh(c.T @ c)
    assert s.n == 600 and np.allclose(s.mean, x.mean(axis=0), atol=1e-10) and np.allclose(s.values, want[0], rtol=1e-11)
    assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, c.T @ c, rtol=0, atol=1e-10 * want[0][-1])


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(6)
    for trial in range(300):
        k = int(rng.integers(1, 30))
        d = np.sort(rng.integers(0, 6, k).astype(float) if trial % 2 else rng.random(k)) * 10.0 ** rng.integers(-4, 5)
        v = rng.standard_normal(k) * 10.0 ** rng.integers(-9, 1, k) * (rng.random(k) > 0.3)
        rho = float(rng.random() * 10)
        values, vectors = whitening.rank_one(d, np.eye(k), v, rho)
        want = np.diag(d) + rho * np.outer(v, v)
        assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() <= 1e-13 * max(np.abs(want).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13 and (np.diff(values) >= 0).all()
