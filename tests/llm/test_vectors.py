"""Centroid clustering and whitening against brute force."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import centroids, queries, whitening


def planted(n, dim, groups, seed, copies=0):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((groups, dim))
    x = at[rng.integers(groups, size=n)] * 0.3 + rng.standard_normal((n, dim)) * 0.1
    return np.concatenate([x] + [x[:1]] * copies)


def frame(spark, rows, extra="label int"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<double>, {extra}")


ODD = [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [None] * 64)]


def plain_clusters(rows, k, rounds):
    """Lloyd's rounds in Python integers."""
    x = np.array([np.floor(1024 * np.array(v)) for _, v in rows]).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    at = [x[i].tolist() for i in order[:k]]
    for r in range(rounds + 1):
        d = np.stack([((x - np.array(c)) ** 2).sum(axis=1) for c in at], axis=1)
        best = d.argmin(axis=1)
        if r < rounds:
            at = [[int(s) // int((best == c).sum()) for s in x[best == c].sum(axis=0)] if (best == c).any() else at[c] for c in range(len(at))]
    return best, d.min(axis=1), at


@pytest.mark.parametrize("seed, groups", [(1, 3), (2, 8), (3, 40)])
def test_clusters_equal_plain_rounds(spark, seed, groups):
    rows = list(enumerate(planted(700, 64, groups, seed, copies=200).tolist())) + [(None, [0.25] * 64), (5, [0.25] * 64), (5, [0.25] * 64)]
    scans = []
    got = centroids.clusters(frame(spark, rows + ODD), scans=scans).collect()
    best, far, at = plain_clusters(rows, 8, 10)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    want = [(i, int(c), int(d), int(far[best == c].sum()), int(far.sum()), digest[c]) for (i, _), c, d in zip(rows, best, far)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert scans[0] == len(rows) and sum(scans[1:]) < len(rows) * (len(scans) - 1)


def test_few_and_no_vectors_ties_and_large_entries(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    got = {r.vec_id: r for r in centroids.clusters(frame(spark, rows)).collect()}
    assert got[1].cluster == got[2].cluster and got[3].cluster != got[1].cluster and got[1].inertia == 0
    assert centroids.clusters(frame(spark, ODD)).collect() == []
    with pytest.raises(Exception, match="exceeds"):
        centroids.clusters(frame(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_hold_under_drift():
    rng = np.random.default_rng(4)
    x, at, state, drift = rng.integers(-500, 500, (2000, 8)), rng.integers(-500, 500, (6, 8)), None, np.zeros(6)
    for _ in range(12):
        cluster, upper, lower, scanned = centroids.settle(x, at, drift, state)
        d = centroids.distances(x, at)
        assert (cluster == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d.min(axis=1)) * (1 - 1e-12)).all() and (lower <= np.sqrt(np.partition(d, 1)[:, 1]) * (1 + 1e-12)).all()
        state, new = (cluster, upper, lower), np.stack([x[cluster == c].mean(axis=0).astype(int) if (cluster == c).any() else at[c] for c in range(6)])
        drift, at = np.sqrt(((new - at) ** 2).sum(axis=1)), new
    assert scanned < len(x) // 2


def test_query_of_clusters_as_in_duckdb(spark, small, duck, same):
    same(duck, queries.ORACLE["op11_centroids"], queries.QUERIES["op11_centroids"](spark, small))


def whitened(rows, most=16):
    """Fit list, deviations as Python integers, eigenvalues and axes."""
    x = np.array([np.floor(64 * np.array(v)) for _, v in rows]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row.tolist(), s.tolist())) for row in x]
    centred = (n * fit - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, ((n * x - s) / n) @ axes[:, ::-1][:, :most] / np.sqrt(values[::-1][:most]), values[::-1][:most] / values.sum()


@pytest.mark.parametrize("dim, n", [(64, 500), (3, 50)])
def test_whitening_equals_numpy(spark, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((n, dim)) * np.linspace(3, 1, dim)).tolist())]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (n, rows[1][1])]
    odd = [(900, None), (901, []), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [None] * dim)]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    count, deviation, z, explained = whitened(rows)
    k = min(dim, 16)
    assert len(got) == len(rows) * k
    by = {(r.vec_id, r.component): r for r in got}
    flip = np.sign([by[3, c + 1].whitened * z[3, c] for c in range(k)])
    for (i, _), dev, line in zip(rows, deviation, z):
        for c in range(k):
            r = by[i, c + 1]
            assert (r.n, int(r.deviation)) == (count, dev)
            assert abs(r.whitened - line[c] * flip[c]) < 1e-9 and abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-12


def test_flat_directions_lengths_and_empty_tables(spark):
    rows = [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [1.0, 2.0, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.component, int(r.deviation), round(abs(r.whitened), 9)) for r in got) == [(1, 1, 4096, 1), (2, 1, 4096, 1)]
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_double_double_sums_are_exact_where_doubles_are_not():
    rng = np.random.default_rng(0)
    y = rng.integers(-(2**58), 2**58, (700, 5)) >> rng.integers(0, 50, (700, 5))
    exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(5)] for i in range(5)]
    high, low = np.zeros((5, 5)), np.zeros((5, 5))
    for lo in range(0, 700, 64):
        for product in whitening.outer_sum(y[lo : lo + 64]):
            high, low = whitening.add(high, low, product)
    off = max(abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact[i][j]) / max(abs(exact[i][j]), 1) for i in range(5) for j in range(5))
    assert off < Fraction(1, 2**95)


def test_query_of_whitening(spark, small):
    rows = queries.QUERIES["op13_whitening"](spark, small).collect()
    assert len(rows) == 500 * 16 and rows[0].identity_error < 1e-10 and all(r.deviation == int(r.deviation_decimal) for r in rows)
