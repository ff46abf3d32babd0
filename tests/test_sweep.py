"""Label sweeps over tiles equal a plain loop over all spots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hmrf, simulate, sweep


def plain(score, near, labels, weight, sweeps, tol, choose=None):
    labels, n = list(labels), len(labels)
    for number in range(1, sweeps + 1):
        edits = 0
        draws = sweep.uniform(np.arange(n), 0, number)
        for i in range(n):
            cost = score[i].copy()
            for j, w in near[i]:
                cost[labels[j]] += weight * w
            new = choose(cost, labels[i], draws[i], number) if choose else int(cost.argmax())
            edits += new != labels[i]
            labels[i] = new
        if edits < tol * n:
            break
    return labels


def planted(n, k, seed, reach=3):
    """Scores, and links of each spot to others near in number and to one far away (another slice)."""
    rng = np.random.default_rng(seed)
    score, near = rng.normal(0, 1, (n, k)), [[] for _ in range(n)]
    for i in range(n):
        for j in (*range(i + 1, min(i + reach, n)), (i + n // 2) % n):
            w = float(rng.uniform(0.2, 1.5))
            if i != j:
                near[i].append((j, w))
                near[j].append((i, w))
    return score, near, rng.integers(0, k, n)


@pytest.mark.parametrize("tile", [7, 40, 4096])
def test_icm_over_linked_slices(spark, tile):
    n, k = 120, 4
    score, near, labels = planted(n, k, tile)
    llf = spark.createDataFrame([(i, c, float(score[i, c])) for i in range(n) for c in range(k)], "spot long, clone int, llf double")
    edges = spark.createDataFrame([(i, j, w) for i in range(n) for j, w in near[i]] + [(3, 3, 9.0), (3, 999, 9.0)], "src long, dst long, weight double")
    given = spark.createDataFrame([(i % 2, i, int(labels[i])) for i in range(n)], "sample int, spot long, label int")
    got = {r.spot: r for r in hmrf.icm(llf, edges, given, weight=0.7, tol=1e-9, tile=tile).collect()}
    assert [got[i].label for i in range(n)] == plain(score, near, labels, 0.7, 100, 1e-9)
    assert all(r.sample == i % 2 and abs(sum(r.posterior) - 1) < 1e-9 for i, r in got.items())


def test_no_group_holds_a_sample_and_rounds_follow_chains(spark):
    n = 300
    score, near, labels = planted(n, 3, 1, reach=2)
    nodes = spark.createDataFrame([(i, score[i].tolist()) for i in range(n)], "node long, score array<double>")
    edges = spark.createDataFrame([(i, j, w) for i in range(n) for j, w in near[i]], "src long, dst long, weight double")
    field = sweep.Field(nodes, edges, 0.7, tile=30)
    sizes = [r["count"] for r in field.nodes.groupBy("tile").count().collect()]
    assert max(sizes) <= 33 and len(sizes) >= 10
    state, _ = field.sweep(field.start(spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "node long, label int")))
    assert {r.node: r.now for r in state.collect()} == dict(enumerate(plain(score, near, labels, 0.7, 1, 0)))
    assert field.rounds < 10


def test_random_sweeps_equal_a_plain_loop(spark):
    n, k = 60, 3
    score, near, labels = planted(n, k, 2)
    nodes = spark.createDataFrame([(i % 2, i, int(labels[i]), score[i].tolist()) for i in range(n)], "sample int, node long, label int, h array<double>")
    edges = spark.createDataFrame([(i, j, w) for i in range(n) for j, w in near[i]], "src long, dst long, weight double")

    def choose(cost, label, draws, number):
        trial = (label + 1 + int(draws[1] * (k - 1))) % k
        return trial if draws[0] < np.exp(min(0.0, 1.3 * (cost[trial] - cost[label]))) else label

    got = {r.node: r.label for r in simulate.metropolis(nodes, edges, k, beta=1.3, sweeps=2).collect()}
    assert [got[i] for i in range(n)] == plain(score, near, labels, 1.0, 2, -1, choose)
    draws = sweep.uniform(np.arange(20_000), 5, 1)
    assert abs(draws.mean() - 0.5) < 0.01 and abs(np.corrcoef(draws.T)[0, 1]) < 0.03 and (draws < 1).all()


def test_a_spot_without_likelihoods_of_a_clone(spark):
    llf = spark.createDataFrame([(1, 5, -1.0), (1, 7, -2.0), (2, 7, -3.0)], "spot long, clone int, llf double")
    given = spark.createDataFrame([(0, 1, 9), (0, 2, 5)], "sample int, spot long, label int")
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.1)], "src long, dst long, weight double")
    got = hmrf.icm(llf, edges, given).select("spot", "label").orderBy("spot")
    assert [tuple(r) for r in got.collect()] == [(1, 5), (2, 7)]
    assert hmrf.icm(llf.where(F.lit(False)), edges, given).count() == 0
