"""Hidden Markov models of copy-number states along chromosomes.

Emissions are columns (an array per row, one entry a state), the forward likelihood is a fold
inside generated code, and full lattices run over batches of chains at once (``lattice``); longer
chains can be cut into blocks. Many models are fitted together: their number is a column. Only sums
over all chains of a model (K x K transitions, K starts) come to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bb_emission, bb_state, nb_emission, nb_state
from .fit import climb_together, refitted, ways_up
from .lattice import PAIRS, emitter, finisher, lse, multiplier, pair_counter, scanner, sum_shapes
from .storage import keep


@dataclass(frozen=True)
class States:
    """Parameters of K states: what a driver holds of a model."""

    p: tuple[float, ...]
    tau: tuple[float, ...]
    log_mu: tuple[float, ...] = ()
    alpha: tuple[float, ...] = ()
    log_start: tuple[float, ...] = ()
    log_trans: tuple[tuple[float, ...], ...] = field(default=())

    @property
    def k(self) -> int:
        return len(self.p)


def default_states(k: int, t: float = 0.99999) -> States:
    """Start values: log means and shares spread evenly, sticky transitions."""
    stay, leave = np.log(t), np.log((1 - t) / max(1, k - 1))
    trans = tuple(tuple(float(stay if i == j else leave) for j in range(k)) for i in range(k))
    shares, means = (tuple(map(float, np.linspace(a, b, k))) for a, b in ((0.05, 0.45), (-0.1, 0.1)))
    return States(shares, (30.0,) * k, means, (0.1,) * k, (float(-np.log(k)),) * k, trans)


def emission(states: States, *, phased: bool = False, reads: bool = True, purity: Column | None = None, shift: Column | None = None) -> Column:
    """Array of log-emissions of a row (umi, base, k, depth): K entries, or 2K with the alleles flipped in the second half.

    ``shift`` (a clone's log mean over its genome) weighs purity, where alleles are concerned, by
    how many copies a tumour cell has of the state's bins.
    """
    rdr = [nb_state(F.col("umi"), F.col("base"), m, a, purity) if reads and states.log_mu else F.lit(0.0) for m, a in zip(states.log_mu or states.p, states.alpha or states.p, strict=True)]
    pure = [purity] * states.k if shift is None else [adjusted_purity(purity, F.exp(F.lit(m) - shift)) for m in states.log_mu]

    def shares(count: Column) -> list[Column]:
        return [r + bb_state(count, F.col("depth"), p, t, q) for r, p, t, q in zip(rdr, states.p, states.tau, pure, strict=True)]

    return F.array(*shares(F.col("k")), *(shares(F.col("depth") - F.col("k")) if phased else []))


#: Rows of chains for each task that sums their distinct pairs.
TASK_PAIRS = 1_000_000
#: Parameters of a row's model, as columns.
PARAMETERS = ("_p", "_tau", "_log_mu", "_alpha")


def with_parameters(obs: DataFrame, models: Sequence[States], model: str) -> DataFrame:
    """``obs`` with the ``PARAMETERS`` of the model that its column ``model`` numbers: a row for each model is broadcast."""
    rows = [(i, *(list(map(float, v)) for v in (m.p, m.tau, m.log_mu, m.alpha))) for i, m in enumerate(models)]
    table = obs.sparkSession.createDataFrame(rows, f"`{model}` int, " + ", ".join(f"{c} array<double>" for c in PARAMETERS))
    return obs.join(F.broadcast(table), model)


def emission_by_model(k: int, *, phased: bool = False, reads: bool = True, purity: Column | None = None) -> Column:
    """``emission`` of K states whose parameters are columns: one expression for all models and rounds."""
    p, tau, log_mu, alpha = (F.col(c) for c in PARAMETERS)
    rdr = [nb_emission(F.col("umi"), F.col("base"), log_mu[i], alpha[i], purity) if reads else F.lit(0.0) for i in range(k)]
    kept = [rdr[i] + bb_emission(F.col("k"), F.col("depth"), p[i], tau[i], purity) for i in range(k)]
    turned = [rdr[i] + bb_emission(F.col("depth") - F.col("k"), F.col("depth"), p[i], tau[i], purity) for i in range(k)] if phased else []
    return F.array(*kept, *turned)


def adjusted_purity(tumour: Column, weight: Column) -> Column:
    """Purity weighted by how much a tumour cell's total differs from a normal cell's."""
    return tumour * weight / (tumour * weight + 1 - tumour)


def decode_independent(em: Column) -> Column:
    """State with the largest emission, the first on ties."""
    return (F.array_position(em, F.array_max(em)) - 1).cast("int")


def forward_llf(obs: DataFrame, states: States, keys: Sequence[str], order: str = "t") -> DataFrame:
    """(keys, llf): forward log-likelihood of each chain of ``obs(…, em)``."""
    k = states.k

    def step(alpha: Column, em: Column) -> Column:
        def into(j: int) -> Column:
            terms = [alpha[i] + states.log_trans[i][j] for i in range(k)]
            top = F.greatest(*terms)
            total = F.exp(terms[0] - top)
            for x in terms[1:]:
                total = total + F.exp(x - top)
            return em[j] + top + F.log(total)

        return F.array(*(into(j) for j in range(k)))

    rows = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col("em").alias("em")))).alias("rows"))
    ems = F.transform("rows", lambda r: r["em"])
    first = F.array(*(ems[0][j] + states.log_start[j] for j in range(k)))
    rest = F.slice(ems, F.lit(2), F.greatest(F.size(ems) - 1, F.lit(0)))

    def finish(a: Column) -> Column:
        top = F.array_max(a)
        return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))

    return rows.select(*keys, F.aggregate(rest, first, step, finish).alias("llf"))


def _starts(models: Sequence[States], phased: bool) -> np.ndarray:
    start = np.array([m.log_start for m in models])
    return np.concatenate([start, start], axis=1) + np.log(0.5) if phased else start


def _blocks(obs: DataFrame, keys: Sequence[str], order: str, switch: str | None, *, model: str | None, cut: Column | None = None, carry: Sequence[str]) -> DataFrame:
    """(keys, [cut], _model, t, carry, [switch]): each chain, or block of it, as arrays in order."""
    names = [*keys, "_cut"] if cut is not None else list(keys)
    more = {c: F.col(c) for c in carry} | ({"switch": F.col(switch).cast("double")} if switch else {})
    row = F.struct(F.col(order).alias("t"), *(c.alias(n) for n, c in more.items()))
    needed = obs.select(*keys, *([cut.alias("_cut")] if cut is not None else []), (F.col(model) if model else F.lit(0)).cast("int").alias("_model"), row.alias("_row"))
    blocks = needed.groupBy(*names).agg(F.first("_model").alias("_model"), F.array_sort(F.collect_list("_row")).alias("_rows"))
    arrays = [F.col(f"_rows.{n}").alias(n) for n in ("t", *more)]
    return blocks.select(*keys, *([F.col("_cut").alias("cut")] if cut is not None else []), "_model", *arrays)


def _schemas(obs: DataFrame, keys: Sequence[str], order: str, carry: Sequence[str]) -> tuple[str, str]:
    """Schemas of the keys and of rows of posteriors."""
    kinds = {f.name: f.dataType.simpleString() for f in obs.select(*dict.fromkeys([*keys, order, *carry])).schema}
    own = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return own, f"{own}{', ' if own else ''}`{order}` {kinds[order]}, log_gamma array<double>, state int, phase boolean, xi array<double>, llf double" + "".join(f", `{c}` {kinds[c]}" for c in carry)


def posteriors(obs: DataFrame, states: States | Sequence[States], keys: Sequence[str], order: str = "t", switch: str | None = None, *, model: str | None = None, cut: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(keys, order, log_gamma, state, phase, xi, llf, carry): posterior of each row of ``obs(…, em)``, with the columns ``carry``.

    With ``switch`` (log probability of a phase switch before the next row) the chain has 2K
    states. A chain's first row has its expected transitions (flattened) and its likelihood.

    ``model``: a column that numbers the model of each chain in the list ``states``. ``cut``: a
    column that never falls along a chain; rows of one value are a block, blocks are swept apart
    and joined by a scan over their products, and each block's first row has its transitions.
    Without it a chain is one block.
    """
    models = [states] if isinstance(states, States) else list(states)
    phased = switch is not None
    start, trans = _starts(models, phased), np.array([m.log_trans for m in models])
    blocks = _blocks(obs, keys, order, switch, model=model, cut=cut, carry=("em", *carry))
    own, found = _schemas(obs, keys, order, carry)
    if cut is not None:
        at = blocks.schema["cut"].dataType.simpleString()
        blocks = keep(blocks)  # read twice
        products = blocks.mapInArrow(multiplier(list(keys), trans, phased), f"{own}, _model int, cut {at}, product array<double>, switch double")
        chains = products.groupBy(*keys).agg(F.first("_model").alias("_model"), F.array_sort(F.collect_list(F.struct("cut", "product", "switch"))).alias("b"))
        chains = chains.select(*keys, "_model", *(F.col(f"b.{n}").alias(alias) for n, alias in (("cut", "cuts"), ("product", "products"), ("switch", "switches"))))
        between = chains.mapInArrow(scanner(list(keys), start, trans, phased), f"{own}, cut {at}, entry array<double>, after array<double>, llf double, first boolean")
        blocks = blocks.join(between, [*keys, "cut"])
    return blocks.mapInArrow(finisher(list(keys), order, start, trans, phased, cut is not None, list(carry)), found)


def expected_sums(posterior: DataFrame, k: int, model: str | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each model (0 without a column for it): expected transitions [K, K], first rows' posteriors [K], log-likelihood over all chains, in one pass."""
    rows = posterior.where("xi is not null")
    xi = (F.sum(F.col("xi")[i]) for i in range(k * k))
    # With 2K posteriors both phases of a state count; beyond the array's end there is nothing.
    first = F.col("llf").isNotNull()
    start = (F.sum(F.when(first, F.exp(F.col("log_gamma")[i]) + F.coalesce(F.exp(F.get("log_gamma", F.lit(i + k))), F.lit(0.0)))) for i in range(k))
    out = {}
    for r in rows.groupBy((F.col(model) if model else F.lit(0)).alias("_model")).agg(*xi, *start, F.sum("llf")).collect():
        found = np.array([x or 0.0 for x in r[1:]], float)
        out[r[0]] = found[: k * k].reshape(k, k), found[k * k : -1], float(found[-1])
    return out


def normalised_transitions(m: np.ndarray, diagonal: bool = False) -> tuple[tuple[float, ...], ...]:
    """Log transitions from expected ones; ``diagonal`` ties them to one stay and one leave value."""
    k, m = len(m), m + 1e-300
    if diagonal and k > 1:
        stay = np.trace(m) / m.sum()
        m = np.where(np.eye(k, dtype=bool), stay, (1 - stay) / (k - 1)) + 1e-300
    return tuple(map(tuple, np.log(m / m.sum(axis=1, keepdims=True))))


def transition_update(posterior: DataFrame, k: int, diagonal: bool = False) -> tuple[tuple[float, ...], ...]:
    """Log transitions from the expected ones of all chains."""
    return normalised_transitions(expected_sums(posterior, k)[0][0], diagonal)


def start_update(posterior: DataFrame, k: int) -> tuple[float, ...]:
    """Log start probabilities: the mean posterior of first rows, both phases together."""
    m = expected_sums(posterior, k)[0][1] + 1e-300
    return tuple(np.log(m / m.sum()))


def posteriors_by_model(obs: DataFrame, models: Sequence[States], keys: Sequence[str], *, model: str = "model", reads: bool = True) -> DataFrame:
    """``posteriors`` of ``obs(model, keys, t, umi, base, k, depth)``, each chain under its model's emissions, in one pass."""
    carry, kinds = ("umi", "base", "k", "depth"), _schemas(obs, keys, "t", ())[1]
    p, tau, log_mu, alpha = (np.array([getattr(m, c) for m in models], float) for c in ("p", "tau", "log_mu", "alpha"))
    emit = emitter(p, tau, log_mu if reads and models[0].log_mu else None, alpha, False, None)
    finish = finisher(list(keys), "t", _starts(models, False), np.array([m.log_trans for m in models]), False, False, [])
    return _blocks(obs, keys, "t", None, model=model, carry=carry).mapInArrow(lambda batches: finish(emit(batches)), kinds)


def fit_together(obs: DataFrame, models: Sequence[States], keys: Sequence[str], *, model: str = "model", update: str = "stmp", rounds: int = 30, tol: float = 1e-3, switch: str | None = None, diagonal: bool = False, shared: bool = True, purity: str | None = None, settings: dict[str, float] | None = None, telemetry: str | None = None) -> tuple[list[States], list[list[float]]]:
    """(fitted models, their log-likelihoods) of ``obs(model, keys, t, umi, base, k, depth)``: Baum-Welch of many models in one job a step.

    ``update`` names what each round fits: s start, t transitions, m means, p shares. A model is
    done when its transitions, means and shares all change by less than ``tol`` on average; its
    rows are left out of later rounds. Chains are gathered once; each round is one pass over them, in
    which posteriors are summed for distinct pairs of counts, and after the first round the fits' first
    pass is part of it. ``keys`` hold ``model`` or tell its chains apart.
    ``telemetry``: a table that takes a row for each model and round, with what the pass itself counted.
    """
    spark, models, trails = obs.sparkSession, list(models), [[] for _ in models]
    keys, k = [model, *(c for c in keys if c != model)], models[0].k
    reads, going, phased = "m" in update, list(range(len(models))), switch is not None
    carry = ("umi", "base", "k", "depth", *([purity] if purity else []))
    chains = keep(_blocks(obs, keys, "t", switch, model=model, carry=carry))
    tasks = max(spark.sparkContext.defaultParallelism, (chains.agg(F.sum(F.size("t"))).first()[0] or 0) // TASK_PAIRS)
    laws = [*(["nb"] if reads and models[0].log_mu else []), *(["bb"] if "p" in update else [])]
    for number in range(1, rounds + 1):
        began = time.monotonic()
        climbs = ways_up(models, laws, shared=shared, near=number > 1, settings=settings)
        points = {law: next(way) for law, way in climbs.items()}
        p, tau, log_mu, alpha = (np.array([getattr(m, c) for m in models], float) for c in ("p", "tau", "log_mu", "alpha"))
        count = pair_counter(p, tau, log_mu if reads and models[0].log_mu else None, alpha, _starts(models, phased), np.array([m.log_trans for m in models]), phased, purity, laws, points if number > 1 else {})
        pairs = chains.where(F.col(model).isin(going)).mapInArrow(count, PAIRS)
        by = ("law", "model", "x", "n", "purity")
        stats = pairs.repartition(tasks, *by).groupBy(*by).agg(*(F.sum(F.col("w")[s]).alias(f"_{s}") for s in range(k)))
        stats = stats.select(*by[: 5 if purity else 4], F.array(*(F.col(f"_{s}") for s in range(k))).alias("w")).persist()
        sums = _model_sums(stats, len(models), k)
        fresh, before = list(models), list(models)
        for m in going:
            moves, starts = sums["moves"][m], sums["starts"][m]
            trails[m].append(float(sums["llf"][m]))
            if "s" in update and starts.sum():
                fresh[m] = replace(fresh[m], log_start=tuple(np.log((starts + 1e-300) / (starts + 1e-300).sum())))
            if "t" in update and moves.sum():
                fresh[m] = replace(fresh[m], log_trans=normalised_transitions(moves, diagonal))
        ends = climb_together(stats, climbs, points, {law: sums[f"{law}_terms"][:, :, None] for law in laws} if number > 1 else None)
        models = refitted(fresh, ends, sums)
        stats.unpersist()
        if telemetry:
            from ..sources.writers import append_metrics

            append_metrics(spark, telemetry, [("+".join(keys), int(sums["rows"].sum()), k, update, time.monotonic() - began, number, float(trails[m][-1])) for m in going])

        def change(m: int) -> float:
            a, b = models[m], before[m]  # noqa: B023
            parts = [np.abs(np.exp(a.log_trans) - np.exp(b.log_trans)).mean(), np.abs(np.subtract(a.p, b.p)).mean()]
            return max([*parts, np.abs(np.subtract(a.log_mu, b.log_mu)).mean() if reads else 0.0])

        going = [m for m in going if change(m) >= tol]
        if not going:
            break
    return models, trails


def _model_sums(stats: DataFrame, models: int, k: int) -> dict[str, np.ndarray]:
    """The sums that a pass over chains left in ``stats``, by name: [model, …]."""
    shapes = sum_shapes(k)
    sizes = [int(np.prod(s)) for s in shapes.values()]
    flat = np.zeros((models, sum(sizes)))
    for m, place, w in stats.where("law = 'sum'").select("model", F.col("x").cast("int"), F.col("w")[0]).collect():
        flat[m, place] = w
    return {name: part.reshape(models, *shape) for (name, shape), part in zip(shapes.items(), np.split(flat, np.cumsum(sizes)[:-1], axis=1), strict=True)}


def baum_welch(obs: DataFrame, states: States, keys: Sequence[str], **how) -> tuple[States, list[float]]:
    """``fit_together`` of one model: (fitted states, log-likelihoods) of ``obs(keys, t, umi, base, k, depth)``."""
    (found,), (trail,) = fit_together(obs.withColumn("_one", F.lit(0)), [states], keys, model="_one", **how)
    return found, trail


#: Read depth ratios count up to this and in these steps, shares in these: a few ten thousand cells at most.
MOST_RATIO, RATIO_STEP, SHARE_STEP = 20.0, 0.05, 0.01


def mixture_cells(obs: DataFrame, mirror: bool = False) -> DataFrame:
    """(rdr, baf, n): how many rows of ``obs`` lie in each cell of read depth ratio and allele share (clipped to 0.1 to 0.9).

    Where there is no base the ratio is one, where there is no depth the share is one half.
    """
    share = F.least(F.greatest(F.col("k") / F.nullif("depth", F.lit(0)), F.lit(0.1)), F.lit(0.9))
    ratio = F.least(F.coalesce(F.col("umi") / F.nullif("base", F.lit(0.0)), F.lit(1.0)), F.lit(MOST_RATIO))
    rows = obs.select((F.round(ratio / RATIO_STEP) * RATIO_STEP).alias("rdr"), (F.round(F.coalesce(F.least(share, 1 - share) if mirror else share, F.lit(0.5)) / SHARE_STEP) * SHARE_STEP).alias("baf"))
    return rows.groupBy("rdr", "baf").agg(F.count(F.lit(1)).alias("n"))


def mixture_step(x: np.ndarray, n: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, means, covariances, log-likelihood) after one step of expectation and maximisation over cells ``x`` with counts ``n``."""
    off = x[:, None] - mean[None]
    turned = np.linalg.solve(cov[None], off[..., None])[..., 0]
    log = np.log(weight) - 0.5 * ((off * turned).sum(axis=2) + np.log(np.linalg.det(cov))) - np.log(2 * np.pi)
    total = lse(log, 1)
    held = np.exp(log - total[:, None]) * n[:, None]
    size = held.sum(axis=0) + 1e-12
    new = held.T @ x / size[:, None]
    off = x[:, None] - new[None]
    spread = np.einsum("ck,cki,ckj->kij", held, off, off) / size[:, None, None] + least * np.eye(2)
    return size / size.sum(), new, spread, float(n @ total)


def gmm_states(obs: DataFrame, k: int, seed: int = 0, mirror: bool = False, rounds: int = 100) -> States:
    """Start values from a Gaussian mixture over the cells of read depth ratios and allele shares.

    Rows are counted into cells by Spark; the mixture is fitted to the bounded table of cells. Its
    start is fixed: the cell nearest the mean, then each time the cell whose rows lie farthest, in
    sum, from the centres before; so the result is the same in every run (``seed`` isn't used).
    """
    cells = np.array([tuple(r) for r in mixture_cells(obs, mirror).orderBy("rdr", "baf").collect()], float).reshape(-1, 3)
    base = default_states(k)
    if not len(cells):
        return base
    x, n = cells[:, :2], cells[:, 2]
    middle = n @ x / n.sum()
    centres = [x[((x - middle) ** 2).sum(axis=1).argmin()]]
    while len(centres) < k:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) * n
        centres.append(x[far.argmax()])
    off = x - middle
    cov = (off.T * n) @ off / n.sum() / k + 1e-4 * np.eye(2)
    weight, mean, cov, before = np.full(k, 1 / k), np.array(centres), np.array([cov] * k), -np.inf
    for _ in range(rounds):
        weight, mean, cov, value = mixture_step(x, n, weight, mean, cov)
        if value - before < 1e-6 * (1 + abs(value)):
            break
        before = value
    return replace(base, p=tuple(float(v) for v in np.clip(mean[:, 1], 0.01, 0.99)), log_mu=tuple(float(v) for v in np.clip(np.log(np.maximum(mean[:, 0], 1e-3)), -2, 2)))


def spread_states(obs: DataFrame, k: int, seed: int = 0) -> States:
    """Start values by careful seeding: each next centre far, in likelihood, from those before."""
    rng = np.random.default_rng(seed)
    share = F.coalesce(F.col("k") / F.nullif("depth", F.lit(0)), F.lit(0.5))
    ratio = F.log(F.greatest(F.coalesce(F.col("umi") / F.nullif("base", F.lit(0.0)), F.lit(1.0)), F.lit(1e-3)))
    cells = obs.select(F.round(ratio, 1).alias("m"), F.round(share, 2).alias("p")).groupBy("m", "p").agg(F.count(F.lit(1)).alias("n"))
    grid = np.array([tuple(r) for r in cells.orderBy("m", "p").collect()], float)  # rounded values: at most some thousand cells
    centres = [grid[rng.choice(len(grid), p=grid[:, 2] / grid[:, 2].sum()), :2]]
    while len(centres) < k:
        d = np.min([((grid[:, :2] - c) ** 2).sum(axis=1) for c in centres], axis=0) * grid[:, 2]
        centres.append(grid[rng.choice(len(grid), p=d / d.sum()) if d.sum() else 0, :2])
    found = np.array(sorted(map(tuple, centres)))
    return replace(default_states(k), log_mu=tuple(np.clip(found[:, 0], -2, 2)), p=tuple(np.clip(found[:, 1], 0.01, 0.99)))


def fit_chains(obs: DataFrame, keys: Sequence[str], k: int, *, switch: str | None = None, rounds: int = 30, update: str = "stmp", seed: int = 0, purity: str | None = None) -> tuple[States, list[float], DataFrame]:
    """(states, likelihoods, posterior rows): mixture start, Baum-Welch, then the final lattice; ``purity``: a column of ``obs``."""
    states, trail = baum_welch(obs, gmm_states(obs, k, seed), keys, update=update, rounds=rounds, switch=switch, purity=purity)
    em = emission(states, phased=switch is not None, reads="m" in update, purity=F.col(purity) if purity else None)
    return states, trail, posteriors(obs.withColumn("em", em), states, keys, switch=switch)
