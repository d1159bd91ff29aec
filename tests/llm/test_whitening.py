"""Factor, eigenvalues and whitened rows against NumPy and exact fractions."""

import numpy as np
import pytest

from sievework.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x int, width int, component int"


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def plain(rows, width):
    """{position: (n, deviation, {component: whitened}, shares)} for the rows of one width."""
    whole = {i: [int(np.floor(256.0 * c)) for c in v] for i, (_, v) in enumerate(rows) if good(v) and len(v) == width}
    fit = sorted({tuple(x) for x in whole.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = centre.T @ centre / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole.items():
        z = (np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors[:, :4]) / np.sqrt(np.maximum(values[:4], 1e-300))
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), z, values / np.trace(cov))
    return out


def compare(df, rows, width, components):
    got = {}
    for r in wh.whiten(df).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    want = plain(rows, width)
    assert sorted(got) == sorted(rows[i][0] for i in want)
    sign = None
    for i, (n, deviation, z, shares) in want.items():
        mine = got[rows[i][0]]
        assert sorted(mine) == list(range(1, components + 1))
        values = np.array([mine[c]["whitened"] for c in sorted(mine)])
        if sign is None and np.all(np.abs(values) > 1e-3):
            sign = np.sign(values) * np.sign(z[:components])
        if sign is not None:
            assert np.allclose(values * sign, z[:components], rtol=1e-7, atol=1e-7)
        for c, r in mine.items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["explained"] - shares[c - 1]) <= 1e-9 * shares[c - 1] and 0 <= r["identity_error"] < 1e-9


def made(seed, n=400, width=12, offset=0.0):
    pick = np.random.default_rng(seed)
    return [(i, (pick.normal(size=width) * np.geomspace(3, 0.05, width) + offset).tolist()) for i in range(n)]


@pytest.mark.parametrize("offset", [0.0, -3.0, 1e7])
def test_rows_equal_the_plain_version(spark, offset):
    rows = made(1, offset=offset)
    rows += [(1000 + i, rows[5][1]) for i in range(200)]
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], SCHEMA).repartition(7)
    compare(df, rows, 12, 4)


def test_factor_and_rotation():
    pick = np.random.default_rng(2)
    for d, rank in ((1, 1), (2, 2), (5, 3), (17, 17), (64, 20)):
        half = pick.normal(size=(d, rank)) * np.geomspace(1, 1e-4, rank)
        matrix = half @ half.T
        factor, order = wh.pivoted_cholesky(matrix)
        assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)]) and np.allclose(np.triu(factor, 1), 0)
        values, vectors = wh.eigen(matrix)
        assert len(values) >= rank and np.all(np.diff(values) <= 0)
        want = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
        assert np.allclose(values[:rank], want[:rank], rtol=1e-8)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)
        assert np.allclose((vectors * values) @ vectors.T, matrix, atol=1e-12)
    # small eigenvalues keep their precision on a matrix of very different scales
    scale = np.diag([1e6, 1.0, 1e-6])
    graded = scale @ np.array([[1, 0.5, 0.5], [0.5, 1, 0.5], [0.5, 0.5, 1]]) @ scale / 1e6
    factor, order = wh.pivoted_cholesky(graded[:2, :2])
    values = np.sort(np.linalg.norm(wh.rotated(factor), axis=0) ** 2)
    assert abs(values[0] * values[1] / (0.75 * 1e12 / 1e12) - 1) < 1e-12
    assert wh.eigen(np.zeros((3, 3)))[0].size == 0
    pairs = [tuple(sorted(p)) for a, b in wh.rounds(7) for p in zip(a.tolist(), b.tolist())]
    assert sorted(pairs) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def test_few_columns_widths_and_ranks(spark):
    two = [(i, [float(i), float(i * i % 7)]) for i in range(20)]
    one = [(100 + i, [float(i % 3)]) for i in range(9)]
    line = [(200 + i, [float(i), 2.0 * i, -i / 256.0]) for i in range(10)]
    same = [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(4)]
    rows = two + one + line + same + [(400, [])]
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], SCHEMA)
    by_id = {}
    for r in wh.whiten(df).collect():
        by_id.setdefault(r["vec_id"], []).append(r["component"])
        assert r["identity_error"] < 1e-9 and r["deviation"] is not None
    assert {k: sorted(v) for k, v in by_id.items()} == {**{i: [1, 2] for i in range(20)}, **{100 + i: [1] for i in range(9)}, **{200 + i: [1] for i in range(10)}}


def test_blocks_of_widths(spark, monkeypatch):
    rows = [(i, np.random.default_rng(i).normal(size=1 + i % 5).tolist()) for i in range(200)]
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], SCHEMA)
    whole = {(r["vec_id"], r["component"]): r["whitened"] for r in wh.whiten(df).collect()}
    monkeypatch.setattr(wh, "BLOCK_NUMBERS", 17)
    assert [b for b in wh.blocks([5, 1, 2, 3, 4])] == [[1, 2, 3], [4], [5]]
    parts = {(r["vec_id"], r["component"]): r["whitened"] for r in wh.whiten(df).collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[k] - whole[k]) < 1e-9 for k in whole)


def test_odd_vectors(spark):
    far = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (4, [1e17, -1e17])]
    got = wh.whiten(spark.createDataFrame([(k, v, 1, 2, 3) for k, v in far], SCHEMA)).collect()
    assert len(got) == 12 and any(r["deviation"] is None for r in got) and all(np.isfinite(r["whitened"]) for r in got)
    for rows in ([], [(1, None)], [(1, [None])], [(1, [])]):
        assert wh.whiten(spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], SCHEMA)).count() == 0
