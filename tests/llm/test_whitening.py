"""Whitening against plain linear algebra."""

import math

import numpy as np
import pytest

from arenalake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("case", ["spread", "close", "equal", "low rank", "blocks", "tiny", "one", "two", "zero", "diagonal"])
def test_eigenvectors_of_symmetric_matrices(case):
    rng = np.random.default_rng(8)
    values = {
        "spread": np.geomspace(1e-6, 1e3, 40), "close": 1 + 1e-9 * np.arange(40), "equal": np.repeat([3.0, 2.0, 1.0], 12), "low rank": np.array([0.0] * 30 + [1.0, 2, 3]),
        "blocks": np.arange(12.0), "tiny": np.arange(1, 20) * 1e-200, "one": np.array([2.0]), "two": np.array([1.0, 4.0]), "zero": np.zeros(5), "diagonal": np.arange(9.0),
    }[case]
    a = symmetric(rng, values)
    if case == "blocks":
        a = np.kron(np.eye(3), a[:4, :4])
    if case == "diagonal":
        a = np.diag(values)
    a = (a + a.T) / 2
    k = min(10, len(a))
    e, x = whitening.leading_eigenvectors(a, k)
    size = np.abs(a).max()
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(e - want).max() <= 1e-13 * size * len(a)
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12
    assert np.abs(a @ x - x * e).max() <= 1e-13 * size * len(a)


def test_sturm_counts_and_tridiagonal_form():
    rng = np.random.default_rng(2)
    a = symmetric(rng, rng.standard_normal(15))
    d, e, mirrors = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    q = np.eye(15)
    for m in mirrors:
        q = q @ (np.eye(15) - 2 * np.outer(m, m))
    assert np.abs(q.T @ a @ q - t).max() < 1e-13
    at = rng.standard_normal(50)
    assert (whitening.below(d, e, at) == (np.linalg.eigvalsh(a) < at[:, None]).sum(1)).all()


def plain(vecs, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vecs], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(((n * r - s) ** 2).sum()) for r in x]
    c = np.array(x - np.array([int(v) / n for v in s]), float)
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, c @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_against_plain_linear_algebra(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BAND", 100)
    rng = np.random.default_rng(6)
    long = [[float(np.float32(c)) for c in v] for v in rng.standard_normal((150, 40)) * np.linspace(0.2, 1.5, 40)]
    long += [long[3], [0.0] * 40, [100.0] + [0.0] * 39]  # a copy, nothing, one far away
    short = [[float(np.float32(c)) for c in v] for v in rng.standard_normal((30, 3))]
    rows = [(i, v, 0, 7, "clash") for i, v in enumerate(long)] + [(1000 + i, v, 0, 7, "") for i, v in enumerate(short)]
    rows += [(None, long[9], 0, 7, ""), (5, long[10], 0, 7, "")]
    bad = [(2000, None, 0, 0, ""), (2001, [None] + [0.1] * 39, 0, 0, ""), (2002, [math.nan] * 40, 0, 0, ""), (2003, [math.inf] + [0.0] * 39, 0, 0, ""), (2004, [], 0, 0, "")]
    got = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(5)).toPandas()
    longer = long + [long[9], long[10]]
    for vecs, mine, k in ((longer, got[(got.vec_id < 1000) | got.vec_id.isna()], 32), (short, got[got.vec_id >= 1000], 3)):
        n, deviation, w, explained = plain(vecs, k)
        assert len(mine) == n * k and set(mine.n) == {n} and mine.identity_error.max() < 1e-9
        assert sorted(mine[mine.component == 1].deviation) == sorted(deviation)
        for c in range(k):
            own = mine[mine.component == c + 1]
            assert np.allclose(own.explained, explained[c], rtol=1e-9)
            a, b = np.sort(own.whitened), np.sort(w[:, c])
            assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-6
        signs = mine[mine.component == 1].set_index(mine[mine.component == 1].vec_id.fillna(-1)).whitened
        first = w[: len(long if k == 32 else short), 0] if k == 32 else w[:, 0]
        ids = [i for i in range(len(first)) if i != 5] if k == 32 else range(len(first))
        at = np.array([signs[i + (0 if k == 32 else 1000)] for i in ids])
        assert min(np.abs(at - first[list(ids)]).max(), np.abs(at + first[list(ids)]).max()) < 1e-6


def test_components_without_variance_and_huge_values(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0], 0, 0, "") for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 60 and (got[got.component > 1].whitened == 0).all() and got.identity_error.max() < 1e-9
    assert abs(got[got.component == 1].explained.iloc[0] - 1) < 1e-12
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, 0, "") for i in range(4)], SCHEMA)).toPandas()
    assert len(same) == 8 and (same.whitened == 0).all() and (same.deviation == 0).all()
    huge = [(i, [1e30 * (-1) ** i, float(i)], 0, 0, "") for i in range(6)]
    far = whitening.whiten(spark.createDataFrame(huge, SCHEMA)).toPandas()
    assert len(far) == 12 and far.deviation.max() == (1 << 63) - 1 and np.isfinite(far.whitened).all()


def test_several_passes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BROADCAST", 40)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.standard_normal(2 + i % 3)], 0, 0, "") for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 20 + 30 + 40 and got.identity_error.max() < 1e-9
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
