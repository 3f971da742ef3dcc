import random

import numpy as np
import pytest

from ashlar.llm import whitening


def plain(rows, top=8):
    """Whitening by an eigenvalue routine over exact integers."""
    good = [(k, [float(x) for x in v]) for k, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda d: (sizes.count(d), d))
    good = [(k, np.floor(1024 * np.array(v)).astype(np.int64) + 100000) for k, v in good if len(v) == size]
    x = np.array([v for _, v in good]).astype(object)
    n, s = len(x), x.sum(axis=0)
    away = x * n - s
    v = np.array(away.T.dot(away) / (n**3), float)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return [k for k, _ in good], (away**2).sum(axis=1), (away / n).astype(float) @ axes, e, np.trace(v), min(top, size)


def held(got, keys, deviation, projected, e, trace, top):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == len(keys) * top
    for i, key in enumerate(keys):
        rows = by[(key, int(deviation[i]))]
        for c in range(top):
            here = [r for r in rows if r.component == c + 1]
            assert here and all(r.n == len(keys) and abs(r.explained - e[c] / trace) <= 1e-9 for r in here)
            assert any(abs(abs(r.whitened) - abs(projected[i, c]) / np.sqrt(e[c])) < 1e-6 for r in here)
            assert all(r.identity_error <= 1e-9 for r in here)


def test_equals_an_eigenvalue_routine(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.3, 0.05 * (j + 1)) for j in range(11)], 1, "c") for i in range(400)]
    rows += [(7, rows[7][1], 1, "c"), (None, rows[9][1], 1, None), (900, None, 1, "c"), (901, [1.0] * 10 + [None], 1, "c"), (902, [float("nan")] * 11, 1, "c"), (903, [float("-inf")] * 11, 1, "c"), (904, [], 1, "c"), (905, [0.5, 0.5], 1, "c"), (906, [1e300] * 11, 1, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string").repartition(7)
    keys, *rest = plain([r for r in rows if r[0] != 906])
    held(whitening.whitened(table).collect(), keys, *rest)


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 24):
        scale = 10.0 ** -np.linspace(0, 6, d)
        base = np.eye(d) + 0.1 * np.ones((d, d))
        matrix = base * scale[:, None] * scale[None, :]
        values, axes = whitening.jacobi(matrix)
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13)
        assert np.allclose(axes @ np.diag(values) @ axes.T, matrix, atol=1e-14)
        # the determinant holds the small ones: their product is known
        assert np.isclose(np.sum(np.log(values)), np.log(1 + 0.1 * d) + 2 * np.sum(np.log(scale)), rtol=1e-12)
        assert (np.diff(values) <= 0).all()
    del rng


def test_large_entries_are_added_exactly(spark):
    rows = [(i, [float(3**i), 2.0**40 + i, -(2.0**41)]) for i in range(24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    model = whitening.fit(table, "embedding")
    x = [[int(v * 1024) + 100000 for v in r] for _, r in rows]
    assert [int(s) for s in model.sums] == [sum(c) for c in zip(*x)]
    got = whitening.whitened(table).collect()
    exact = {i: sum((24 * v - s) ** 2 for v, s in zip(r, [sum(c) for c in zip(*x)])) for i, r in enumerate(x)}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 2**63 else None) for r in got)
    assert all(r.whitened == 0 for r in got if r.component == 3)  # no variance
    total = whitening.Sum((1,))
    for _ in range(5):
        total.add(np.array([2**62]), 2**62)
    assert total.value()[0] == 5 * 2**62


@pytest.mark.parametrize("rows, size", [([], 0), ([(1, [0.5, 0.25])], 2), ([(1, [0.5, 0.25])] * 3, 2), ([(1, None), (2, [None])], 0)])
def test_few_rows(spark, rows, size):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whitened(table).collect()
    assert len(got) == (len(rows) * size)
    assert all(r.whitened == 0 and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in got)


def test_a_long_vector(spark):
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, rng.normal(size=150).tolist()) for i in range(40)], "vec_id long, embedding array<float>")
    got = whitening.whitened(table).collect()
    assert len(got) == 320 and max(r.identity_error for r in got) < 1e-9
