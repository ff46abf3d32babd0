"""Lattices against all paths, blocks of chains, many models together, and Newton fits against grids."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import fit, hmm


def all_paths(em, start, at):
    """(log-likelihood, posteriors, expected transitions) by every path."""
    n, s = em.shape
    weight = {p: start[p[0]] + em[0, p[0]] + sum(at(i)[p[i], p[i + 1]] + em[i + 1, p[i + 1]] for i in range(n - 1)) for p in itertools.product(range(s), repeat=n)}
    total = np.logaddexp.reduce(list(weight.values()))
    gamma, xi = np.zeros((n, s)), np.zeros((s, s))
    for p, w in weight.items():
        for t in range(n):
            gamma[t, p[t]] += math.exp(w - total)
        for a, b in itertools.pairwise(p):
            xi[a, b] += math.exp(w - total)
    return total, gamma, xi


def chains(spark, lengths, states, seed, models=1):
    rng = np.random.default_rng(seed)
    rows = [(c % models, c, t, rng.normal(size=states).tolist(), float(np.log(rng.uniform(0.01, 0.4)))) for c, n in enumerate(lengths) for t in range(n)]
    return rows, spark.createDataFrame(rows, "model int, chain int, t int, em array<double>, switch double").repartition(3)


def two_models(k, seed):
    rng = np.random.default_rng(seed)
    return [hmm.States(p=tuple(rng.uniform(0.1, 0.9, k)), tau=(20.0,) * k, log_start=tuple(np.log(rng.dirichlet([1.0] * k))), log_trans=tuple(map(tuple, np.log(rng.dirichlet([1.0] * k, k))))) for _ in range(2)]


@pytest.mark.parametrize("phased", [False, True])
@pytest.mark.parametrize("cut", [None, 1, 2, 4])
def test_posteriors_against_all_paths(spark, phased, cut):
    k, models = 2, two_models(2, 5)
    rows, obs = chains(spark, [1, 2, 5, 3, 6], 2 * k if phased else k, 7, 2)
    got = hmm.posteriors(obs, models, ["model", "chain"], switch="switch" if phased else None, model="model", cut=None if cut is None else F.floor(F.col("t") / cut)).collect()
    assert len(got) == len(rows)
    for c in range(5):
        own, m = [r for r in rows if r[1] == c], models[c % 2]
        trans = np.array(m.log_trans)
        start = np.array(m.log_start)
        if phased:
            start = np.concatenate([start, start]) + np.log(0.5)

            def at(i):
                s = own[i][4]
                stay = np.log1p(-np.exp(s))
                return np.block([[stay + trans, s + trans], [s + trans, stay + trans]])
        else:
            def at(i):
                return trans
        total, gamma, xi = all_paths(np.array([r[3] for r in own]), start, at)
        found = sorted((r for r in got if r.chain == c), key=lambda r: r.t)
        assert np.allclose(np.exp([r.log_gamma for r in found]), gamma)
        assert [r.llf for r in found if r.llf is not None] == pytest.approx([total]) and found[0].llf is not None
        if phased:
            xi = xi[:k, :k] + xi[:k, k:] + xi[k:, :k] + xi[k:, k:]
        assert np.allclose(sum(np.array(r.xi) for r in found if r.xi is not None).reshape(k, k), xi)
        assert [r.state for r in found] == [int(np.argmax(g)) % k for g in gamma]
    sums = hmm.expected_sums(spark.createDataFrame(got), k, "model")
    assert sums[0][1].sum() == pytest.approx(3) and sums[1][1].sum() == pytest.approx(2)


def test_impossible_chain_is_an_error(spark):
    obs = spark.createDataFrame([(0, 0, [float("-inf"), float("-inf")])], "chain int, t int, em array<double>")
    with pytest.raises(Exception, match="no possible path"):
        hmm.posteriors(obs, two_models(2, 1)[0], ["chain"]).collect()


def test_gammas(spark):
    xs = [1e-4, 0.3, 1.0, 2.5, 17.0, 1e3, 1e6]
    log, first, second = fit.gammas(np.array(xs))
    euler = 0.5772156649015329
    assert log == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)
    assert first[2] == pytest.approx(-euler, rel=1e-12) and second[2] == pytest.approx(math.pi**2 / 6, rel=1e-12)
    for k, x in enumerate(xs):  # recurrences
        _, above, above2 = fit.gammas(np.array([x + 1]))
        assert above[0] - first[k] == pytest.approx(1 / x, rel=1e-9) and second[k] - above2[0] == pytest.approx(1 / x**2, rel=1e-5)
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(C.digamma(F.col("x")), C.trigamma(F.col("x"))).collect()
    assert np.allclose([r[0] for r in got], first, rtol=1e-12) and np.allclose([r[1] for r in got], second, rtol=1e-12)


@pytest.mark.parametrize("kind", ["nb", "bb"])
@pytest.mark.parametrize("pure", [False, True])
def test_derivatives(kind, pure):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 40).astype(float)
    x = np.floor(n * rng.uniform(0, 1, 40))
    q = rng.uniform(0.2, 1, 40) if pure else None
    f = lambda a, b: [np.sum(v) for v in fit.TERMS[kind](x, n, a, b, q)]
    at, h = (0.3, 1.1 if kind == "bb" else -1.2), 1e-5
    value, gl, gd, ll, ld, dd = f(*at)
    up, down, right, left = f(at[0] + h, at[1]), f(at[0] - h, at[1]), f(at[0], at[1] + h), f(at[0], at[1] - h)
    assert gl == pytest.approx((up[0] - down[0]) / (2 * h), rel=1e-5) and gd == pytest.approx((right[0] - left[0]) / (2 * h), rel=1e-5)
    assert ll == pytest.approx((up[1] - down[1]) / (2 * h), rel=1e-5) and ld == pytest.approx((right[1] - left[1]) / (2 * h), rel=1e-5) and dd == pytest.approx((right[2] - left[2]) / (2 * h), rel=1e-5)


def sample(kind, rng, size, loc, disp):
    n = rng.integers(5, 80, size)
    if kind == "bb":
        return np.minimum(rng.binomial(n, rng.beta(loc * disp, (1 - loc) * disp, size)), n), n
    return rng.poisson(rng.gamma(1 / disp, n * np.exp(loc) * disp)), n


@pytest.mark.parametrize("kind, planted", [("bb", [(0.5, 40.0), (0.12, 40.0), (0.9, 8.0)]), ("nb", [(0.0, 0.1), (0.7, 0.1), (-0.6, 0.9)])])
@pytest.mark.parametrize("shared", [False, True])
def test_newton_reaches_a_fine_grid_in_ten_passes(spark, kind, planted, shared):
    """Two models fitted together; neighbours on a fine grid around the result are no better."""
    rng = np.random.default_rng(3)
    rows = []
    for m in (0, 1):
        for s, (loc, disp) in enumerate(planted):
            x, n = sample(kind, rng, 500, loc * (1 + 0.05 * m), disp)
            rows += [(m, float(a), float(b), [float(s == i) for i in range(3)]) for a, b in zip(x, n, strict=True)]
    stats = spark.createDataFrame(rows, "model int, x double, n double, w array<double>").persist()
    start = np.full((2, 3, 2), [0.5, 20.0] if kind == "bb" else [0.1, 0.01])
    found, passes = fit.newton(stats, kind, start, shared=shared)
    assert passes <= 10
    for m in (0, 1):
        assert np.allclose(found[m, :, 0], [loc * (1 + 0.05 * m) for loc, _ in planted], atol=0.12)
        if shared:
            assert np.ptp(found[m, :, 1]) == 0

    model, x, n = (np.array([r[i] for r in rows]) for i in range(3))
    state = np.array([r[3].index(1.0) for r in rows])

    def value(points):
        line = fit._to_line(kind, points)[model.astype(int), state]
        return float(fit.TERMS[kind](x, n, line[:, 0], line[:, 1])[0].sum())

    top = value(found)
    for move in itertools.product((-1, 0, 1), repeat=2):
        for h in (1e-2, 1e-3):
            other = found.copy()
            other[..., 0] += h * move[0]
            other[..., 1] *= math.exp(h * move[1])
            assert value(other) <= top + 1e-6
    near, few = fit.newton(stats, kind, found, shared=shared, near=True)
    assert few <= 2 and np.allclose(near, found, rtol=1e-4)
    kept, _ = fit.newton(stats, kind, found * [1, 1.5], shared=False, fixed=True)
    assert np.allclose(kept[..., 1], found[..., 1] * 1.5)


def test_settings_steer_a_fit(spark, capsys):
    stats = spark.createDataFrame([(3.0, 10.0, [1.0]), (9.0, 20.0, [1.0])], "x double, n double, w array<double>")
    _, passes = fit.newton(stats, "bb", np.array([[[0.5, 20.0]]]), shared=False, settings={"maxiter": 2, "disp": 1.0})
    assert passes == 2 and capsys.readouterr().out.count("log-likelihood") == 2


def planted_chains(seed, share, mean):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(4):
        for t in range(60):
            s = (t // 15) % 2
            base = 40.0
            rows.append((c, t, int(rng.poisson(base * (mean if s else 1.0))), base, int(rng.binomial(50, share if s else 0.5)), 50))
    return rows


def test_two_models_together_equal_two_fits(spark, tmp_path):
    start = hmm.States(p=(0.5, 0.3), tau=(30.0,) * 2, log_mu=(0.0, 0.3), alpha=(0.1,) * 2, log_start=(math.log(0.5),) * 2, log_trans=((math.log(0.95), math.log(0.05)), (math.log(0.05), math.log(0.95))))
    kinds = "chain int, t int, umi int, base double, k int, depth int"
    data = [planted_chains(1, 0.2, 1.6), planted_chains(2, 0.35, 0.6)]
    both = spark.createDataFrame([(m, *r) for m, rows in enumerate(data) for r in rows], f"model int, {kinds}")
    models, trails = hmm.fit_together(both, [start, start], ["model", "chain"], rounds=5, telemetry=str(tmp_path / "runs"))
    for m, rows in enumerate(data):
        alone, trail = hmm.baum_welch(spark.createDataFrame(rows, kinds), start, ["chain"], rounds=5)
        assert trails[m] == pytest.approx(trail, rel=1e-6)
        assert models[m].p == pytest.approx(alone.p, abs=1e-4) and models[m].log_mu == pytest.approx(alone.log_mu, abs=1e-4)
        assert all(b >= a - 1e-3 for a, b in itertools.pairwise(trail))
    assert sorted(models[0].p) == pytest.approx([0.2, 0.5], abs=0.03) and max(models[0].log_mu) == pytest.approx(math.log(1.6), abs=0.1)
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == sum(map(len, trails)) and runs.where("rounds = 1 and size = 480").count() == 2
    assert sorted(runs.where("rounds = 2").select("llf").toPandas()["llf"]) == pytest.approx(sorted(t[1] for t in trails))


def test_mixture_start_finds_planted_states_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.poisson(60 * m)), 60.0, int(rng.binomial(80, p)), 80) for m, p in ((1.0, 0.5), (0.5, 0.15), (1.8, 0.66)) for _ in range(300)] + [(5, 0.0, 0, 0)]
    obs = spark.createDataFrame(rows, "umi int, base double, k int, depth int")
    found = [hmm.gmm_states(obs.repartition(n), 3) for n in (2, 5)]
    assert found[0] == found[1]
    assert np.allclose(sorted(zip(found[0].p, np.exp(found[0].log_mu))), sorted([(0.5, 1.0), (0.15, 0.5), (0.66, 1.8)]), atol=0.06)
    assert hmm.gmm_states(obs.limit(0), 2) == hmm.default_states(2)
