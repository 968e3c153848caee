"""Whitening against numpy's own eigenvectors and against exact integers."""

import math

import numpy as np
import pytest

from lotquery.llm.queries import op11_embedding_whitening
from lotquery.llm.whitening import EPS, bidiagonalise, whiten

from .conftest import rows


def spread(x):
    """|X r|^2 and X^T X r of a matrix."""
    return lambda r: (x.T @ (x @ r), float((x @ r) @ (x @ r)))


@pytest.mark.parametrize("n, dim, wanted, seed", [(300, 20, 8, 1), (40, 64, 32, 2), (500, 5, 5, 3), (3, 9, 9, 4)])
def test_singular_vectors(n, dim, wanted, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim)) * 3.0 ** -np.arange(dim)
    x -= x.mean(0)
    sigma, axes = bidiagonalise(spread(x), dim, wanted, float((x * x).sum()))
    _, want, right = np.linalg.svd(x, full_matrices=False)
    k = int(((want / want[0]) > 1e-6).sum())
    k = min(k, wanted)
    assert np.allclose(sigma[:k], want[:k], rtol=1e-8)
    assert np.allclose(np.abs((axes[:, :k] * right[:k].T).sum(0)), 1, atol=1e-8)
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 50 * EPS


def test_equal_singular_values():
    """Each of several equal ones is found, though the steps from one vector see but one."""
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))[0]
    x = turn * np.array([5, 5, 5, 5, 2, 2, 1, 1, 1, 1, 0, 0.0]) @ turn.T
    sigma, axes = bidiagonalise(spread(x), 12, 10, float((x * x).sum()))
    assert np.allclose(sigma, [5, 5, 5, 5, 2, 2, 1, 1, 1, 1])
    assert np.allclose(np.linalg.norm(x @ axes, axis=0), sigma)


def test_stops_early_where_nothing_can_be_missing():
    x = np.random.default_rng(1).standard_normal((200, 60)) * 10.0 ** -np.arange(60)
    steps = []

    def product(r):
        steps.append(1)
        return spread(x)(r)
    sigma, _ = bidiagonalise(product, 60, 3, float((x * x).sum()))
    assert len(steps) < 30 and np.allclose(sigma, np.linalg.svd(x)[1][:3])


def check(got, vectors, components=32):
    """``got`` against the contract, by numpy and whole numbers."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors.values()])
    n, dim = x.shape
    sums = x.sum(0)
    centred = (x * n - sums) / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    m = min(components, int((e > 1e-12 * e[0]).sum()))
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == n * m
    ids = list(vectors)
    w = np.array([[by[i, c]["whitened"] for c in range(1, m + 1)] for i in ids])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert all(by[i, 1]["deviation"] == d and by[i, 1]["n"] == n for i, d in zip(ids, deviation))
    assert np.allclose([by[ids[0], c]["explained"] for c in range(1, m + 1)], e[:m] / e.sum(), rtol=1e-8)
    error = np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(m)).max()
    assert error < 1e-8 and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8
    for c in range(m):
        if min(abs(e[c] - e[k]) for k in range(dim) if k != c) > 1e-3 * e[c]:
            want = centred @ axes[:, c] / math.sqrt(e[c])
            assert min(np.abs(w[:, c] - want).max(), np.abs(w[:, c] + want).max()) < 1e-8


def test_query_on_all_embeddings(spark):
    folder = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: r["embedding"] for r in rows(spark.read.parquet(f"{folder}/embeddings.parquet"))}
    check(rows(op11_embedding_whitening(spark, folder)), vectors)


SCHEMA = "vec_id long, embedding array<float>, component string, n int, id string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "c", 1, "i") for i, v in vectors], SCHEMA)


def test_odd_rows(spark):
    dice = np.random.default_rng(3)
    good = {i: [float(np.float32(c)) for c in dice.standard_normal(6) * (1, 2, 3, 4, 5, 0)] for i in range(40)}
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5),
           (104, []), (105, [1.0] * 5)]
    check(rows(whiten(table(spark, [*good.items(), *bad]))), good)
    check(rows(whiten(table(spark, good.items()), components=2)), good, 2)
    twice = rows(whiten(table(spark, [*good.items(), *good.items(), (None, good[0])])))
    assert len(twice) == 81 * 5 and {r["n"] for r in twice} == {81}
    assert sum(r["vec_id"] is None for r in twice) == 5
    assert rows(whiten(table(spark, []))) == rows(whiten(table(spark, bad[:1]))) == rows(whiten(table(spark, [(1, []), (2, [])]))) == []
    assert rows(whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))) == []


def test_very_large_entries(spark):
    vectors = {i: [float(np.float32(c)) for c in v] for i, v in enumerate([(1e9, 1.0), (-1e9, 2.0), (3e8, 7.0), (1e16, -3.0)])}
    got = {(r["vec_id"], r["component"]): r for r in rows(whiten(table(spark, vectors.items())))}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors.values()]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((4 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [got[i, 1]["deviation"] for i in range(4)] == [w if w < 1 << 63 else None for w in want]
    assert got[0, 1]["identity_error"] < 1e-6
