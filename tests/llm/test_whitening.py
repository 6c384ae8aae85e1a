"""Whitening against an eigendecomposition of exact sums."""

from fractions import Fraction

import numpy as np
import pytest

from chronoweave.llm import queries, whitening


def plain(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    d = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(dim)] for r in x])
    e, v = np.linalg.eigh(d.T @ d / n)
    return n, [sum((n * r[j] - s[j]) ** 2 for j in range(dim)) for r in x], d, e[::-1], v[:, ::-1]


def test_query(spark, small):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    n, deviation, d, e, v = plain(rows.values())
    got = queries.op13_whitening(spark, small).collect()
    assert len(got) == 8 * n and {(r.vec_id, r.component) for r in got} == {(i, k) for i in rows for k in range(1, 9)}
    place = {i: k for k, i in enumerate(rows)}
    z = np.zeros((n, 8))
    for r in got:
        i, k = place[r.vec_id], r.component - 1
        z[i, k] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[i]) and r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    want = d @ v[:, :8] / np.sqrt(e[:8])
    want *= np.sign((want * z).sum(0))
    assert np.abs(z - want).max() < 1e-7
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows, dim", [(40, 1), (5, 9), (300, 33), (200, 64)])
def test_jacobi(rows, dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(rows, dim)) * 10.0 ** rng.uniform(-6, 3, dim)
    r = whitening.compressed(a)
    lengths, v = whitening.jacobi(r)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(lengths[: len(want)], want, rtol=1e-9, atol=1e-12 * want[0]) and np.allclose(v.T @ v, np.eye(dim), atol=1e-12)
    assert np.allclose(np.linalg.norm(a @ v, axis=0), lengths, rtol=1e-9, atol=1e-12 * want[0])


def test_tree_of_many_tasks(spark):
    """300 tasks need three rounds; the result is that of one task."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    n, _, _, e, w = plain(v)
    for tasks in (1, 300):
        model = whitening.fit(df.repartition(tasks))[5]
        assert model["n"] == n and np.allclose(model["e"], e, rtol=1e-10) and np.allclose(np.abs((model["components"] * w).sum(0)), 1, atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [0.0, 0.0]), (6, [0.0, 0.0]), (None, [1.0, -2.0]), (7, [3.0]), (8, [0.5, 0.5, 0.5]), (9, [0.5, 0.5, 0.5]), (10, [1e12, 2.0, 3.0, 4.0]), (11, [-1e12, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, component int")
    model = whitening.fit(df)
    errors = whitening.identity_errors(df, model)
    got = [tuple(r) for r in whitening.whiten(df, model, errors).collect()]
    assert sorted({(r[0] or 0, r[2]) for r in got}) == [(0, 3), (6, 3), (7, 1), (8, 2), (9, 2), (10, 2), (11, 2)]
    assert len(got) == 3 * 2 + 1 + 2 * 3 + 2 * 4
    flat = [r for r in got if r[0] in (7, 8, 9)]
    assert all(r[3] == 0 and r[4] == 0 and r[5] == 0 and r[6] == 0 for r in flat)
    assert {r[3] for r in got if r[0] in (10, 11)} == {None}  # (2 * 1e15)^2 is beyond 64 bits
    assert all(r[6] < 1e-9 for r in got)
    pairs = [r for r in got if r[0] in (None, 6)]
    assert sum(r[4] ** 2 for r in pairs if r[1] == 1) == pytest.approx(3) and all(r[4] == 0 for r in pairs if r[1] == 2)
    assert whitening.fit(df.limit(0)) == {} and whitening.whiten(df.limit(0), {}, {}).count() == 0
