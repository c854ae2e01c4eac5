from __future__ import annotations

import math

import numpy as np
import pytest

from tickloom.llm import whitening

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, components):
    """By numpy's own eigensolver, over whole numbers."""
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return [k for k, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), values[order], centred @ axes[:, order] / np.sqrt(values[order]), values.sum()


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(9000, rows[0][1])] * 300 + [(None, rows[1][1])]
    odd = [(9001, None), (9002, []), (9003, [None] + [0.1] * 11), (9004, [math.nan] + [0.1] * 11), (9005, [math.inf] + [0.0] * 11), (9006, [0.5] * 5)]
    frame = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "1 as component", "2 as key", "3 as x")
    got = whitening.whitened_embeddings(frame, components=7).collect()
    keys, n, deviation, values, whitened, trace = plain(rows, 7)
    assert len(got) == 7 * len(keys) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {c: np.sign(by[5][c][0].whitened * whitened[5, c - 1]) for c in range(1, 8)}
    for i, key in enumerate(keys):
        for c in range(1, 8):
            for r in by[key][c]:
                assert r.deviation == deviation[i]
                assert abs(signs[c] * r.whitened - whitened[i, c - 1]) < 1e-8
                assert abs(r.explained - values[c - 1] / trace) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_equal_vectors_flat_directions_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS)
    assert whitening.whitened_embeddings(same).count() == 0
    assert whitening.whitened_embeddings(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)], VECTORS)
    got = whitening.whitened_embeddings(line).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12 and len(got) == 6


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e5 * (i % 7), -3e4 * i, 5.0 * (i % 2)]) for i in range(40)]
    got = whitening.whitened_embeddings(spark.createDataFrame(rows, VECTORS)).filter("component = 1").collect()
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    sums = [sum(column) for column in zip(*x)]
    assert {r.vec_id: r.deviation for r in got} == {i: sum((40 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert got[0].identity_error < 1e-6
    z = np.array([[1 << 40, 3], [5, -(1 << 39)]])
    assert whitening._exact_products(z).tolist() == [[(1 << 80) + 25, (3 << 40) - (5 << 39)], [(3 << 40) - (5 << 39), 9 + (1 << 78)]]
    with pytest.raises(Exception, match="too large"):
        whitening.whitened_embeddings(spark.createDataFrame([(1, [1e300]), (2, [0.0])], VECTORS)).count()


def test_inertia_counts_eigenvalues_above_a_shift():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 20):
        for _ in range(30):
            a = rng.integers(-3, 4, (size, size)).astype(float)
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            for shift in (-1.5, 0.3, 2.7):
                if np.abs(values - shift).min() > 1e-9:
                    assert whitening.positive_pivots(a - shift * np.eye(size)) == (values > shift).sum()


def test_repeated_and_close_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.array([9, 9, 9, 5, 5 - 1e-13, 4, 4 - 1e-6, 3, *np.linspace(2, 1, 15), *[0] * 7], float)
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, axes = whitening.leading_components(a, 32)
    assert len(found) == 23 and np.abs(found - values[:23]).max() < 1e-11
    assert np.abs(axes.T @ axes - np.eye(23)).max() < 1e-10
    assert np.abs(a @ axes - axes * found).max() < 1e-10
    assert len(whitening.leading_components(a, 2)[0]) == 2
