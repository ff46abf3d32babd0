"""Maximum-likelihood fits of emission parameters over compressed observations, by Newton steps.

Equal observations meet in one row with their summed state weights (partial aggregation before
the shuffle). A pass sums likelihood, gradient and curvature of every state at a few candidate
points, here steps of several lengths; the driver holds six numbers a candidate, whatever the data.
States of many models are fitted in one pass: observations carry the number of their model.
"""

from __future__ import annotations

import functools
from collections.abc import Generator, Iterable, Iterator, Sequence
from dataclasses import replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .hmm import States

#: Passes at most, the first of which looks at a coarse grid; with a near start (a round of many); lengths of a pass's steps.
PASSES, NEAR_PASSES, LENGTHS = 10, 3, (1.0, 0.5, 0.2, 0.05, 0.01)
#: Points of the grid: log means or logits of shares, and log dispersions.
GRID = {"nb": (np.linspace(-2.0, 2.0, 9), np.log([0.001, 0.03, 0.3, 3.0])), "bb": (np.linspace(-3.5, 3.5, 9), np.log([2.0, 10.0, 50.0, 500.0]))}
#: Relative gain of a likelihood below which a fit is done, and the longest step of a coordinate.
GAIN, REACH = 1e-11, 2.0
#: The settings that each solver takes.
SOLVERS = {"BFGS": ("xrtol", "disp"), "L-BFGS-B": ("maxiter", "ftol", "disp"), "Nelder-Mead": ("maxiter", "xtol", "ftol", "disp")}


def solver_settings(config) -> dict[str, float]:
    """The settings ``em_<name>`` of ``config.hmm`` that its ``solver`` takes, by name; an error for another solver.

    Fits take Newton steps whatever the solver's name: ``maxiter`` bounds their passes, ``ftol`` is
    the relative gain and ``xtol`` or ``xrtol`` the step under which they end, ``disp`` prints each pass.
    """
    solver = config.hmm.solver
    if solver not in SOLVERS:
        raise ValueError(f"no solver {solver!r}; one of {', '.join(SOLVERS)}")
    return {name: float(getattr(config.hmm, f"em_{name}")) for name in SOLVERS[solver]}


def gammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log gamma, digamma, trigamma) of x > 0: shifted by 8, then their asymptotic series."""
    x = np.asarray(x, float)
    product, first, second = np.ones_like(x), np.zeros_like(x), np.zeros_like(x)
    for k in range(8):
        r = 1 / (x + k)
        product, first, second = product * (x + k), first + r, second + r * r
    z = x + 8
    r = 1 / z
    r2 = r * r
    log = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680))) - np.log(product)
    digamma = np.log(z) - r / 2 - r2 * (1 / 12 - r2 * (1 / 120 - r2 * (1 / 252 - r2 * (1 / 240 - r2 / 132)))) - first
    trigamma = r + r2 / 2 + r * r2 * (1 / 6 - r2 * (1 / 30 - r2 * (1 / 42 - r2 * (1 / 30 - r2 * 5 / 66)))) + second
    return log, digamma, trigamma


def np_lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of x > 0."""
    return gammas(x)[0]


def _less(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(a - b for a, b in zip(gammas(x), gammas(y), strict=True))


def nb_terms(k: np.ndarray, base: np.ndarray, loc: np.ndarray, disp: np.ndarray, purity: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Negative binomial log-likelihood at log mean ``loc`` and log dispersion ``disp``, and its derivatives.

    Six arrays: value, by loc, by disp, by loc twice, by both, by disp twice; 0 without base.
    """
    slope = base * np.exp(loc) * (1.0 if purity is None else purity)
    mean = np.maximum(slope if purity is None else slope + base * (1 - purity), 1e-12)
    r = np.exp(-disp) + 0 * mean
    both, log_share = r + mean, np.log(r) - np.log(r + mean)
    d = _less(k + r, r)
    value = d[0] - np_lgamma(k + 1.0 + 0 * mean) + r * log_share + k * (np.log(mean) - np.log(both))
    by_mean, by_r = k / mean - (k + r) / both, d[1] + log_share + 1 - (k + r) / both
    twice_mean, cross, twice_r = -k / mean**2 + (k + r) / both**2, -1 / both + (k + r) / both**2, d[2] + 1 / r - 2 / both + (k + r) / both**2
    found = value, by_mean * slope, -r * by_r, twice_mean * slope**2 + by_mean * slope, -r * cross * slope, r * r * twice_r + r * by_r
    return tuple(np.where(base > 0, f, 0.0) for f in found)


def bb_terms(k: np.ndarray, n: np.ndarray, loc: np.ndarray, disp: np.ndarray, purity: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Beta-binomial log-likelihood at the logit of a share and the log of its concentration, and its derivatives; 0 without depth."""
    p, t = 1 / (1 + np.exp(-loc)), np.exp(disp)
    q = 1.0 if purity is None else purity
    share, first = p * q + 0.5 * (1 - q), q * p * (1 - p)
    second = first * (1 - 2 * p)
    k, n = np.minimum(k, n) * 1.0, n * 1.0
    a, b, t = share * t, (1 - share) * t, t + 0 * share
    da, db, dt = _less(k + a, a), _less(n - k + b, b), _less(t, n + t)
    value = np_lgamma(n + 1) - np_lgamma(k + 1) - np_lgamma(n - k + 1) + da[0] + db[0] + dt[0]
    by_loc, by_disp = t * first * (da[1] - db[1]), a * da[1] + b * db[1] + t * dt[1]
    twice_loc = (t * first) ** 2 * (da[2] + db[2]) + t * second * (da[1] - db[1])
    cross = t * first * (a * da[2] - b * db[2] + da[1] - db[1])
    twice_disp = a * a * da[2] + b * b * db[2] + t * t * dt[2] + by_disp
    return tuple(np.where(n > 0, f, 0.0) for f in (value, by_loc, by_disp, twice_loc, cross, twice_disp))


TERMS = {"nb": nb_terms, "bb": bb_terms}
#: Location and dispersion of a law by name, and the range of locations.
PARAMETERS = {"nb": ("log_mu", "alpha", -2, 2), "bb": ("p", "tau", 0.01, 0.99)}


def np_nb(k: np.ndarray, base: np.ndarray, log_mu: np.ndarray, alpha: np.ndarray, purity: np.ndarray | None = None) -> np.ndarray:
    """Negative binomial log-likelihood of log mean and dispersion."""
    return nb_terms(k, base, log_mu, np.log(alpha), purity)[0]


def np_bb(k: np.ndarray, n: np.ndarray, p: np.ndarray, tau: np.ndarray, purity: np.ndarray | None = None) -> np.ndarray:
    """Beta-binomial log-likelihood of share and concentration."""
    return bb_terms(k, n, np.log(p / (1 - p)), np.log(tau), purity)[0]


def summed_terms(stats: DataFrame, points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each law [model, state, candidate, six]: terms at ``points[law][model, state, candidate, (loc, disp)]`` summed over ``stats(law, [model], x, n, w, [purity])``, all in one pass.

    ``w``: array of one weight a state. Each task sums its own rows; what comes to the driver is a row for each task and law.
    """
    pure, many = "purity" in stats.columns, "model" in stats.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {law: np.zeros((*at.shape[:3], 6)) for law, at in points.items()}
        for rows in batches:
            laws, x, n = (np.asarray(rows.column(c)) for c in ("law", "x", "n"))
            model, weights = np.asarray(rows.column("model")) if many else np.zeros(rows.num_rows, int), np.asarray(rows.column("w").flatten(), float)
            weights = weights.reshape(rows.num_rows, -1) if rows.num_rows else weights
            for law, at in points.items():
                own = np.flatnonzero(laws == law)
                for m in np.unique(model[own]):
                    mine = own[model[own] == m]
                    for s in range(at.shape[1]):
                        held = mine[weights[mine, s] != 0]
                        q = np.asarray(rows.column("purity"))[held][:, None] if pure else None
                        found = TERMS[law](x[held][:, None].astype(float), n[held][:, None].astype(float), at[m, s, :, 0], at[m, s, :, 1], q)
                        total[law][m, s] += np.stack([weights[held, s] @ f for f in found], axis=1)
        for law, found in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([law]), pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], ["law", "v"])

    out = {law: np.zeros((*at.shape[:3], 6)) for law, at in points.items()}
    for law, v in stats.mapInArrow(part, "law string, v array<double>").collect():
        out[law] += np.reshape(v, out[law].shape)
    return out


def compressed(obs: DataFrame, x: Column, n: Column, weights: Column, k: int, decimals: int = 3, purity: str | None = None, model: str | None = None) -> DataFrame:
    """([model], x, n, w, [purity]): distinct pairs with summed weights of k states."""
    keys = [x.alias("x"), F.round(n.cast("double"), decimals).alias("n"), *([F.round(purity, decimals).alias("purity")] if purity else []), *([F.col(model).alias("model")] if model else [])]
    names = ["x", "n", *(["purity"] if purity else []), *(["model"] if model else [])]
    summed = obs.select(*keys, weights.alias("_w")).groupBy(*names).agg(*(F.sum(F.col("_w")[s]).alias(f"_{s}") for s in range(k)))
    return summed.select(*names, F.array(*(F.col(f"_{s}") for s in range(k))).alias("w"))


def _to_line(kind: str, values: np.ndarray) -> np.ndarray:
    """(location, dispersion) as unbounded coordinates."""
    loc = values[..., 0] if kind == "nb" else np.log(values[..., 0] / (1 - values[..., 0]))
    return np.stack([loc, np.log(values[..., 1])], axis=-1)


def _inside(kind: str, line: np.ndarray) -> np.ndarray:
    """Coordinates within the plausible ranges: log means within ±10, shares within 1e-6 of 0 and 1, dispersions from 1e-6 to 1e6."""
    far = 10.0 if kind == "nb" else np.log((1 - 1e-6) / 1e-6)
    return np.stack([np.clip(line[..., 0], -far, far), np.clip(line[..., 1], np.log(1e-6), np.log(1e6))], axis=-1)


def _newton_step(terms: np.ndarray, shared: bool, fixed: bool) -> np.ndarray:
    """[state, 2]: the step uphill of one model from its states' ``terms[state, six]``.

    Curvatures of the wrong sign count with the right one, so that the step always climbs.
    """
    states = len(terms)
    size = states + 1 if shared else 2 * states
    at = [(s, states if shared else states + s) for s in range(states)]
    gradient, curve = np.zeros(size), np.zeros((size, size))
    for (i, j), (_, gl, gd, ll, ld, dd) in zip(at, terms, strict=True):
        gradient[i] += gl
        gradient[j] += gd
        curve[i, i] += ll
        curve[i, j] += ld
        curve[j, i] += ld
        curve[j, j] += dd
    if fixed:
        gradient[states:] = 0
        curve[states:, :] = curve[:, states:] = 0
    values, axes = np.linalg.eigh(curve)
    bend = np.maximum(np.abs(values), 1e-10 * max(np.abs(values).max(initial=0), 1e-300))
    along = (axes.T @ gradient) / bend
    step = axes @ np.where(np.abs(values) > 0, along, 0.0)
    return np.clip(np.array([(step[i], step[j]) for i, j in at]), -REACH, REACH)


def climb(kind: str, start: np.ndarray, *, shared: bool, fixed: bool = False, settings: dict[str, float] | None = None, near: bool = False) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, int]]:
    """Newton's way up, as a generator: it yields points, takes their summed terms, and returns the result with the passes taken.

    The result [model, state, (location, dispersion)] has the largest likelihood, from ``start`` of the same shape.

    Locations are log means (nb) or shares (bb). ``shared``: one dispersion for all states of a
    model; ``fixed``: dispersions stay. The first pass looks at a coarse grid and the start,
    so neither start nor grid is preferred; with ``near`` the start is one of an earlier fit, and
    steps begin there.
    """
    settings = settings or {}
    most = NEAR_PASSES if near else PASSES
    passes, gain = int(min(most, settings.get("maxiter", most))), settings.get("ftol", GAIN)
    short = settings.get("xtol", settings.get("xrtol", 1e-9))
    at = _inside(kind, _to_line(kind, np.asarray(start, float)))
    if shared and not fixed:
        at[:, :, 1] = at[:, :, 1].mean(axis=1, keepdims=True)
    models, states, _ = at.shape
    points = at[:, :, None, :]
    if not near:
        locs, disps = GRID[kind]
        grid = np.array([(a, b) for a in locs for b in disps])
        points = np.concatenate([points, np.broadcast_to(grid, (models, states, *grid.shape))], axis=2)
        if fixed:
            points = points.copy()
            points[:, :, :, 1] = at[:, :, None, 1]
    best, taken = None, 0
    while taken < passes:
        found = yield points
        taken += 1
        if best is None:
            best = np.take_along_axis(found, np.zeros((models, states, 1, 1), int), axis=2)[:, :, 0]
        better = np.zeros(models, bool)
        for m in range(models):
            value = found[m, :, :, 0]
            if shared and not fixed:
                if taken == 1 and not near:  # the grid: each dispersion with every state's best location
                    tried = [[(c, points[m, s, c, 1]) for c in range(points.shape[2])] for s in range(states)]
                    options = sorted({d for row in tried for _, d in row})
                    pick = max(options, key=lambda d: sum(max(value[s, c] for c, e in tried[s] if e == d) for s in range(states)))
                    chosen = [max((c for c, e in tried[s] if e == pick), key=lambda c: value[s, c]) for s in range(states)]
                else:
                    chosen = [int(value.sum(axis=0).argmax())] * states
                groups = [(range(states), chosen)]
            else:
                groups = [([s], [int(value[s].argmax())]) for s in range(states)]
            for members, picks in groups:
                old, new = sum(best[m, s, 0] for s in members), sum(value[s, c] for s, c in zip(members, picks, strict=True))
                if new > old or taken == 1:
                    better[m] |= taken == 1 or new - old > gain * (1 + abs(old))
                    for s, c in zip(members, picks, strict=True):
                        at[m, s], best[m, s] = points[m, s, c], found[m, s, c]
        if settings.get("disp"):
            print(f"pass {taken}: log-likelihood {best[:, :, 0].sum():.6f}")
        if not better.any():
            break
        steps = np.stack([_newton_step(best[m], shared and not fixed, fixed) for m in range(models)])
        steps[~better] = 0
        if np.abs(steps).max() <= short:
            break
        points = _inside(kind, at[:, :, None, :] + steps[:, :, None, :] * np.array(LENGTHS)[None, None, :, None])
    loc = at[:, :, 0] if kind == "nb" else 1 / (1 + np.exp(-at[:, :, 0]))
    return np.stack([loc, np.exp(at[:, :, 1])], axis=-1), taken


def climb_together(stats: DataFrame, climbs: dict[str, Generator], points: dict[str, np.ndarray] | None = None, found: dict[str, np.ndarray] | None = None) -> dict[str, tuple[np.ndarray, int]]:
    """What several laws' ways up end with; each pass over ``stats(law, …)`` serves all that still climb.

    ``points``: where ways that have begun stand; ``found``: their summed terms, where these are known already.
    """
    points, out = {law: next(way) for law, way in climbs.items()} if points is None else points, {}
    while points:
        found, later = found or summed_terms(stats, points), {}
        for law, terms in found.items():
            try:
                later[law] = climbs[law].send(terms)
            except StopIteration as end:
                out[law] = end.value
        points, found = later, None
    return out


def newton(stats: DataFrame, kind: str, start: np.ndarray, **how) -> tuple[np.ndarray, int]:
    """``climb`` of one law over ``stats([model], x, n, w, [purity])``: (parameters, passes taken)."""
    return climb_together(stats.withColumn("law", F.lit(kind)), {kind: climb(kind, start, **how)})[kind]


def maximise(stats: DataFrame, kind: str, start: np.ndarray, *, shared: bool, fixed: bool = False, settings: dict[str, float] | None = None, near: bool = False) -> np.ndarray:
    """``newton`` of one model: [state, (location, dispersion)]."""
    return newton(stats, kind, np.asarray(start)[None], shared=shared, fixed=fixed, settings=settings, near=near)[0][0]


def fit_models(rows: DataFrame, models: Sequence[States], *, means: bool, shares: bool, phased: bool = False, shared: bool = True, fixed: bool = False, least: float = 0.1, purity: str | None = None, near: bool = False, settings: dict[str, float] | None = None) -> list[States]:
    """Models refitted to ``rows(model, umi, base, k, depth, log_gamma)`` together; states of less than ``least`` weight stay.

    ``phased``: there are 2K posteriors, the second half of which counts reads of the other allele.
    """
    k = models[0].k
    gamma = F.transform("log_gamma", lambda g: F.exp(g))
    both = F.array(*(gamma[s] + gamma[s + k] for s in range(k))) if phased else gamma

    laws = {}
    if means and models[0].log_mu:
        laws["nb"] = compressed(rows.where(F.col("base") > 0), F.col("umi").cast("double"), F.col("base"), both, k, purity=purity, model="model")
    if shares:
        held, weights = rows.where(F.col("depth") > 0), gamma
        if phased:
            first, second = F.array(*(gamma[s] for s in range(k))), F.array(*(gamma[s + k] for s in range(k)))
            more = ["model", *([purity] if purity else [])]
            held = held.select("k", "depth", *more, first.alias("w")).unionByName(held.select((F.col("depth") - F.col("k")).alias("k"), "depth", *more, second.alias("w")))
            weights = F.col("w")
        laws["bb"] = compressed(held, F.col("k").cast("double"), F.col("depth"), weights, k, purity=purity, model="model")
    if not laws:
        return list(models)
    stats = functools.reduce(DataFrame.unionByName, (df.withColumn("law", F.lit(law)) for law, df in laws.items())).persist()
    found = climb_together(stats, ways_up(models, laws, shared=shared, fixed=fixed, near=near, settings=settings))
    weight = {law: np.zeros((len(models), k)) for law in laws}
    for r in stats.groupBy("law", "model").agg(*(F.sum(F.col("w")[s]).alias(f"_{s}") for s in range(k))).collect():
        weight[r[0]][r[1]] = r[2:]
    stats.unpersist()
    return refitted(models, found, weight, least)


def ways_up(models: Sequence[States], laws: Iterable[str], **how) -> dict[str, Generator]:
    """``climb`` of each law from the models' parameters."""
    return {law: climb(law, np.array([np.stack([getattr(m, c) for c in PARAMETERS[law][:2]], axis=1) for m in models]), **how) for law in laws}


def refitted(models: Sequence[States], found: dict[str, tuple[np.ndarray, int]], weight: dict[str, np.ndarray], least: float = 0.1) -> list[States]:
    """``models`` with the parameters found; states of less than ``least`` weight (of a law: [model, state]) stay."""
    models = list(models)
    for law, (values, _) in found.items():
        loc, disp, low, high = PARAMETERS[law]
        for i, m in enumerate(models):
            keep = weight[law][i] < least
            new = {loc: np.where(keep, getattr(m, loc), np.clip(values[i, :, 0], low, high)), disp: np.where(keep, getattr(m, disp), values[i, :, 1])}
            models[i] = replace(m, **{c: tuple(map(float, v)) for c, v in new.items()})
    return models


def fit_states(rows: DataFrame, states: States, **how) -> States:
    """``fit_models`` of one model."""
    return fit_models(rows.withColumn("model", F.lit(0)), [states], **how)[0]


def fit_normal_shares(obs: DataFrame, least_tau: float = 30.0) -> tuple[float, float]:
    """(p, tau) of one beta-binomial over ``obs(k, depth)``."""
    stats = compressed(obs.where(F.col("depth") > 0), F.col("k").cast("double"), F.col("depth"), F.array(F.lit(1.0)), 1)
    p, tau = maximise(stats, "bb", np.array([[0.5, 20.0]]), shared=False)[0]
    return float(p), max(float(tau), least_tau)
