"""Links of embeddings: rows without ids, the whole table of the query, and pairs that meet in many buckets."""

import numpy as np

from lettermill.llm import common, embedding_dedup, queries
from tests.llm.test_operators import SF, roots


def brute(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)


def test_rows_without_ids_have_their_links(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 32))
    near = x[0] + 0.01 * rng.standard_normal((3, 32))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(None, near[0].tolist()), (None, near[0].tolist()), (100, near[1].tolist()), (None, (-x[5]).tolist()), (None, (-x[5] * 3).tolist()), (None, None)]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {r["id"]: (r["n_links"], r["component_id"]) for r in got if r["id"] is not None}
    assert len(got) == len(rows) and by[0] == (3, 0) and by[100] == (3, 0) and by[5] == (0, 5)
    none = sorted((r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got if r["id"] is None)
    assert none == [(0, -1), (1, -1), (1, -1), (3, 0), (3, 0)]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    links = brute(np.array([r["embedding"] for r in rows], dtype=np.float64))
    ids = [r["vec_id"] for r in rows]
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links), strict=True)])
    got = {r["vec_id"]: r for r in queries.op5_embedding_dedup(spark, SF).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[k].sum(), want[i], want[i] == i)


def test_dense_groups_count_each_pair_once(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 64))
    v = np.concatenate([c + s * rng.standard_normal((90, 64)) for c in centres for s in (0.03, 0.12, 0.2)])
    links = brute(v)
    old, common.BLOCK_ROWS = common.BLOCK_ROWS, 50
    try:
        got = {r["id"]: r for r in embedding_dedup.link_embeddings(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    finally:
        common.BLOCK_ROWS = old
    found, want = np.array([got[i]["n_links"] for i in range(len(v))]), links.sum(1)
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    whole = roots(range(len(v)), zip(*np.nonzero(links), strict=True))
    assert np.mean([got[i]["component_id"] == whole[i] for i in range(len(v))]) >= 0.99


def test_sums_are_those_that_reach_the_limit():
    rng = np.random.default_rng(5)
    p, q = -np.sort(-rng.standard_normal(40)), -np.sort(-rng.standard_normal(30))
    for limit in (-9.0, 0.3, 2.0, 99.0):
        got, (i, j) = embedding_dedup._sums(p, q, limit)
        want = {(a, b) for a in range(40) for b in range(30) if p[a] + q[b] >= limit}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and np.allclose(got, p[i] + q[j])
