"""The exact characteristic polynomial and its roots against plain versions; whitening against eigh; awkward rows."""

from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from codeaudit.llm import whitening
from codeaudit.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_polynomial(m):
    """Faddeev and LeVerrier, in fractions."""
    d = len(m)
    a = np.array([[Fraction(int(v)) for v in row] for row in m], object)
    unit = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    b, out = unit, [Fraction(1)]
    for k in range(1, d + 1):
        b = a @ b
        c = -sum(b[i, i] for i in range(d)) / k
        out.append(c)
        b = b + c * unit
    return [int(c) for c in reversed(out)]


def scatter(x):
    x = np.array(x, object)
    s = x.sum(axis=0)
    return (len(x) * (x.T @ x) - np.outer(s, s)).tolist()


CASES = {
    "random": scatter(np.random.default_rng(1).integers(-300, 300, (40, 7))),
    "low rank": scatter(np.random.default_rng(2).integers(-9, 9, (3, 6))),
    "diagonal": [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]],
    "zero": [[0, 0], [0, 0]],
    "one": [[7]],
    "huge": scatter(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, (9, 4))),
    "swaps": [[0, 0, 3, 0], [0, 4, 0, 0], [3, 0, 9, 1], [0, 0, 1, 6]],
}


@pytest.mark.parametrize("name", sorted(set(CASES) - {"swaps"}))
def test_polynomial(spark, name):
    assert whitening.characteristic_polynomial(spark, CASES[name]) == plain_polynomial(CASES[name])


def test_polynomial_mod_with_row_swaps():
    p = whitening.primes(10)[0]
    got = whitening.polynomial_mod(np.array(CASES["swaps"], np.int64) % p, p).tolist()
    assert got == [c % p for c in plain_polynomial(CASES["swaps"])]


def test_roots_with_multiplicity():
    poly = plain_polynomial(CASES["diagonal"])
    assert [whitening.roots_above(poly, a, s) for a, s in ((0, 0), (2, 0), (9, 1), (5, 0), (39, 3))] == [3, 2, 2, 0, 2]
    for j, (root, place, size) in enumerate(((5, 0, 2), (5, 1, 2), (2, 0, 1)), 1):
        a, s, *rest = whitening.isolate(poly, j)
        assert a < root * 2**s <= a + 1 and rest == [place, size] and a.bit_length() == whitening.ROOT_BITS


@pytest.mark.parametrize("name", ["random", "low rank", "diagonal", "huge"])
def test_components(spark, name):
    m = np.array(CASES[name], float)
    found = whitening.components(spark, CASES[name], 4)
    values = np.linalg.eigvalsh(m)[::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    assert len(found) == min(4, rank)
    vectors = np.array([v for *_, v in found])
    assert np.allclose([r for r, *_ in found], values[: len(found)], rtol=1e-9)
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-15)
    assert np.allclose(m @ vectors.T, vectors.T * values[: len(found)], atol=1e-9 * values[0])
    assert np.allclose([share for _, share, _ in found], values[: len(found)] / np.trace(m), rtol=1e-9)


def test_close_roots_are_told_apart(spark):
    m = [[10**20, 1, 0], [1, 10**20 + 1, 0], [0, 0, 10**20]]
    found = whitening.components(spark, m, 3)
    lift = np.linalg.eigh(np.array([[0, 1, 0], [1, 1, 0], [0, 0, 0]], float))
    for k, (_, _, v) in enumerate(found):
        assert np.allclose(np.abs(v), np.abs(lift[1][:, 2 - k]), atol=1e-14)


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (100, 1 << 30, 1 << 62):
        x = rng.integers(-top, top, (700, 3))
        assert (whitening._products(x) == x.astype(object).T @ x.astype(object)).all()


def test_query_against_eigh(spark):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], float)) for r in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    got = QUERIES["op12_embedding_whitening"](spark, FOLDER).collect()
    assert len(got) == 4 * len(rows)
    sign = {}
    for r in got:
        e, v = values[-r.component], vectors[:, -r.component]
        z = (x[r.vec_id] - mean) @ v / e**0.5
        sign.setdefault(r.component, np.sign(z) * np.sign(r.whitened))
        assert r.n == n and abs(r.whitened - sign[r.component] * z) < 1e-9 * (1 + abs(z))
        assert r.deviation == int(sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[r.vec_id], fit.sum(axis=0))))
        assert abs(r.explained / (e / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [-1.0, 0.25, 3.0], [0.0, -0.0, 1.0], None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [1.0], [9.5, -3.0, 2.0]]
    rows = [(i, v, "x", 0.0, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], None, None, None), (2, vectors[2], "x", 0.0, 1)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, whitened double, n int")
    got = whitening.whiten(made).collect()
    assert {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {4}
    assert sorted((r.vec_id is not None, r.vec_id or 0) for r in got if r.component == 1) == [(False, 0), (True, 0), (True, 1), (True, 2), (True, 2), (True, 3), (True, 10)]
    assert len({r.whitened for r in got if r.component == 2 and r.vec_id in (0, 1, None)}) == 1
    for empty in (made.where("false"), made.where("vec_id in (0, 1)"), made.where("vec_id between 4 and 8")):
        assert whitening.whiten(empty).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, -7.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(huge).collect()} == {(1, None), (2, None), (3, ((3 * 1280 - 1279) ** 2 + (-3 * 1792 + 1024) ** 2))}
