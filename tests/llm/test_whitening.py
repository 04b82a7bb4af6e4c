"""Whitening against numpy's eigendecomposition, and its parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import whitening
from terrace.llm.whitening import Spectrum, fit_whitener, quantised, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(dim)]
    c = np.array([[x[k] * n - s[k] for k in range(dim)] for x in fit], float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return kept, n, s, e[::-1], q[:, ::-1]


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * np.linspace(3, 0.3, dim) + rng.normal(size=(1, dim)) * 5).astype(np.float32)


def test_updates_keep_eigenpairs():
    """Also with equal, zero and far apart eigenvalues, and updates along an eigenvector."""
    rng = np.random.default_rng(1)
    for values in ([0.0] * 8, [1, 1, 1, 2, 2, 5, 5, 9], [1e-14, 1e-7, 1, 1 + 1e-15, 1e3, 1e6, 1e6, 1e9], list(range(8))):
        d, q = np.array(values, float), np.linalg.qr(rng.normal(size=(8, 8)))[0]
        for v in (rng.normal(size=8), q[:, 3], np.zeros(8), 1e-9 * rng.normal(size=8), 1e4 * q[:, 0] + q[:, 7]):
            e, u = rank_one(d, q, v, 0.7)
            whole = q @ np.diag(d) @ q.T + 0.7 * np.outer(v, v)
            top = max(1e-300, np.abs(whole).max())
            assert np.abs(u @ np.diag(e) @ u.T - whole).max() < 1e-13 * top * 8
            assert np.abs(u.T @ u - np.eye(8)).max() < 1e-13 and np.all(np.diff(e) >= 0)


def test_secular_roots_lie_between():
    d, z = np.array([0.0, 1.0, 1.5, 4.0]), np.array([1e-6, 0.5, 2.0, 1.0])
    got = d + np.diagonal(secular_roots(d, z * z, 2.0))
    assert np.allclose(got, np.linalg.eigvalsh(np.diag(d) + 2 * np.outer(z, z)), rtol=1e-14)
    assert np.all(got > d) and np.all(got[:-1] < d[1:])


def test_spectra_join():
    x = vectors(300, 12)
    parts = []
    for block in np.array_split(x, 7):
        s = Spectrum.none(12)
        for v in block.astype(float):
            s.add(v)
        parts.append(s)
    whole = Spectrum.none(12)
    for s in parts:
        whole.join(s)
    c = x - x.mean(0, dtype=float)
    assert np.allclose(whole.values, np.linalg.eigvalsh(c.T @ c), rtol=1e-11) and np.allclose(whole.mean, x.mean(0, dtype=float))
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - c.T @ c).max() < 1e-9


@pytest.mark.parametrize(("n", "dim", "rows_a_task"), [(400, 24, 37), (90, 5, 65_536), (10, 20, 2)])
def test_whitening_against_numpy(spark, monkeypatch, n, dim, rows_a_task):
    monkeypatch.setattr(whitening, "MOST_ROWS", rows_a_task)
    monkeypatch.setattr(whitening, "LEAST_ROWS", rows_a_task)
    x = vectors(n, dim)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, x[0].tolist()) for i in range(n // 2)]
    rows += [(None, x[1].tolist()), (20_000, None), (20_001, []), (20_002, [math.nan] * dim), (20_003, [math.inf] + [0.0] * (dim - 1)), (20_004, [None] + [1.0] * (dim - 1)), (20_005, [1.0] * (dim + 1))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'a' as x", "2 as component", "3 as part")
    got = whiten(df).collect()
    kept, count, s, e, q = brute([r for r in rows if r[0] != 20_005])
    top, trace = min(16, dim), e.sum()
    assert len(got) == len(kept) * top and {r.n for r in got} == {count}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {i for i, _ in kept}
    have = [k for k in range(top) if e[k] > dim * 3e-16 * trace]
    signs = {}
    for i, v in kept:
        off = np.array([count * a - b for a, b in zip(v, s, strict=True)], object)
        for k in range(top):
            r = by[i][k + 1]
            assert r.deviation == sum(a * a for a in off) and abs(r.explained - max(e[k], 0) / trace) <= 1e-10
            if k not in have:
                assert r.whitened is None
                continue
            want = float(off.astype(float) / count @ q[:, k]) / math.sqrt(e[k])
            if abs(want) > 1e-3:
                signs.setdefault(k, math.copysign(1, want * r.whitened))
            assert abs(r.whitened - signs.get(k, 1) * want) < 1e-7
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_no_spread_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], SCHEMA)
    got = whiten(same).collect()
    assert len(got) == 8 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)
    assert whiten(same.limit(0)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    assert quantised(spark.createDataFrame([(1, [-0.001, 1e30])], SCHEMA)).first().x == [999_999, (64 << 40) + 1_000_000]


def test_sums_beyond_doubles(spark):
    """Large entries: deviations are exact, or null where a long can't hold them."""
    big = 64 * 10**8
    df = spark.createDataFrame([(1, [1e8, 0.0]), (2, [-1e8, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(df).collect()} == {None}
    made = fit_whitener(quantised(df))
    assert made.deviation(np.array([[1_000_000 + 10**9, 10**6]])) == [(2 * 10**9) ** 2 + 64**2] and big * big * 4 >= 1 << 63
