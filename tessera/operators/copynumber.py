"""Integer copy numbers of states: small coordinate searches, one per (clone, ploidy, restart), dealt out by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .genome import point_join

#: Pairs of copies a state may have: at most five of either, one to six together.
CANDIDATES = [(a, b) for a in range(6) for b in range(6) if 1 <= a + b <= 6]
#: Searches of a finished inference and the highest ploidy each starts from; the first holds the diploid state fixed.
SEARCHES = {"fixed": 4, "diploid": 2, "triploid": 3, "tetraploid": 4}
#: Modulus and factor of the starts' draws.
PRIME, FACTOR = 2_147_483_647, 48_271
RESULT = "clone int, ploidy int, restart int, loss double, state int, a int, b int"


def diploid_state(states: DataFrame, least: float = 0.1, slack: float = 0.05, retry: float | None = None) -> DataFrame:
    """(clone, state): of the balanced states with at least ``least`` of a clone's bins, the one of the smallest mean.

    ``states``: (clone, state, bins, log_mu, p). With ``retry``, a clone without one takes it from the
    states that hold at least that share; a clone without any has no row.
    """
    total = states.groupBy("clone").agg(F.sum("bins").alias("total"))
    rows = states.join(total, "clone")
    short = F.col("bins") < least * F.col("total")
    enough = ~short if retry is None else F.col("bins") >= min(least, retry) * F.col("total")
    fit = rows.where(enough & (F.abs(F.col("p") - 0.5) <= slack))
    return fit.groupBy("clone").agg(F.min_by("state", F.struct(short, "log_mu", "state")).alias("state"))


def adjusted_log_mu(states: DataFrame, weights: DataFrame) -> DataFrame:
    """``states`` with log means shifted so that each clone's weighted mean of exp is 1.

    ``weights``: (clone, state, weight): the share of the baseline that a state's bins hold. A clone
    whose weights are all zero has no baseline, and goes.
    """
    shift = states.select("clone", "state", "log_mu").join(weights.select("clone", "state", "weight"), ["clone", "state"]).groupBy("clone").agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.exp("log_mu")).alias("_m"))
    shift = shift.where("_w > 0").select("clone", F.log(F.col("_m") / F.col("_w")).alias("shift"))
    return states.join(shift, "clone").withColumn("log_mu", F.col("log_mu") - F.col("shift")).drop("shift")


class Misfit:
    """How badly copies of a clone's states fit their means and shares.

    ``weight`` is the baseline that each state holds. With ``diploid``, an index, means are measured
    from that state, and balanced shares bring no penalty.
    """

    def __init__(self, mu: np.ndarray, p: np.ndarray, bins: np.ndarray, weight: np.ndarray, diploid: int | None = None):
        self.mu, self.p, self.n, self.points = mu, p, float(bins.sum()), bins + 0.1
        self.share, self.diploid = weight / weight.sum(), diploid
        gap = mu[:, None] - mu[None]
        self.above, self.off = gap > 0.3, np.abs(p - 0.5)

    def __call__(self, copies: np.ndarray, ploidy: int) -> float:
        total = copies.sum(axis=1)
        if (total == 0).any():
            return self.n * 1e6
        scale = self.share @ total if self.diploid is None else 2 / self.mu[self.diploid]
        out = self.points @ ((0.3 * (self.mu - total / scale)) ** 2 + (self.p - copies[:, 0] / total) ** 2)
        # A pair of reversed totals counts from both ends.
        faults = 2 * (self.above & (total[:, None] < total[None])).sum() + (self.points @ total > (ploidy + 0.5) * self.points.sum())
        if self.diploid is None:
            even = copies[:, 0] == copies[:, 1]
            faults += (~even & (self.off < max(0.05, self.off[even].max(initial=0.0)))).sum()
        return float(out + self.n * faults)


def climb(loss, start: np.ndarray, allowed: list[list[tuple[int, int]]], sweeps: int = 10) -> tuple[np.ndarray, float]:
    """Coordinate descent over the states' candidates; only strict gains count."""
    now, best = start.copy(), loss(start)
    for _ in range(sweeps):
        gained = False
        for s, options in enumerate(allowed):
            for pair in options:
                trial = now.copy()
                trial[s] = pair
                value = loss(trial)
                if value < best:
                    now, best, gained = trial, value, True
        if not gained:
            break
    return now, best


def drawn_start(n: int, ploidy: int, restart: int, seed: int = 0) -> np.ndarray:
    """Copies that a restart begins with: one candidate for each of ``n`` states, by squares of residues."""
    x = (np.arange(n, dtype=object) * 1009 + ploidy * 99_991 + restart * 7919 + seed + 1) * FACTOR % PRIME
    return np.array([CANDIDATES[int(v * v % PRIME) % len(CANDIDATES)] for v in x]).reshape(n, 2)


def _tries(states: DataFrame, most_ploidy: int, diploid: DataFrame | None, restarts: int, off_balance: float, off_diploid: float, seed: int) -> DataFrame:
    """What every search of every clone finds, a row for each state."""
    weight = F.col("weight" if "weight" in states.columns else "bins").cast("double")
    rows = states.select("clone", F.struct("state", F.col("bins").cast("double"), "log_mu", "p", weight.alias("weight")).alias("r"))
    per = rows.groupBy("clone").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    per = per.withColumn("diploid", F.lit(-1)) if diploid is None else per.join(diploid.select("clone", F.col("state").alias("diploid")), "clone")
    tries = F.sequence(F.lit(0), F.lit(0 if diploid is None else restarts - 1))
    grid = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(most_ploidy))).alias("ploidy")).select("*", F.explode(tries).alias("restart"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, bins, log_mu, p, weight = (np.array(v) for v in zip(*(tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in row.rows), strict=True))
                mu, n = np.exp(log_mu), len(ids)
                if row.diploid < 0:
                    start = np.array([(row.ploidy // 2, row.ploidy - row.ploidy // 2)] * n)
                    misfit, allowed = Misfit(mu, p, bins, weight), [CANDIDATES] * n
                else:
                    at = int(np.flatnonzero(ids == row.diploid)[0])
                    barred = (np.abs(p - 0.5) > off_balance) | (np.abs(mu - 1) > off_diploid)
                    misfit, allowed = Misfit(mu, p, bins, weight, at), [[] if s == at else [c for c in CANDIDATES if c != (1, 1) or not barred[s]] for s in range(n)]
                    start = drawn_start(n, row.ploidy, row.restart, seed)
                    start[at] = (1, 1)
                found, loss = climb(lambda c: misfit(c, row.ploidy), start, allowed)  # noqa: B023
                yield pd.DataFrame({"clone": row.clone, "ploidy": row.ploidy, "restart": row.restart, "loss": loss, "state": ids, "a": found[:, 0], "b": found[:, 1]})

    return grid.repartition("clone", "ploidy", "restart").mapInPandas(search, RESULT)


def _best(tried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The search of the smallest loss for each ``keys``, the earliest of equals."""
    best = tried.groupBy(*keys).agg(F.min(F.struct("loss", "ploidy", "restart")).alias("m")).select(*keys, F.col("m.ploidy").alias("ploidy"), F.col("m.restart").alias("restart"))
    return tried.join(best, [*keys, "ploidy", "restart"]).select(*keys, "ploidy", "restart", "loss", "state", "a", "b")


def integer_copies(states: DataFrame, *, most_ploidy: int = 4, diploid: DataFrame | None = None, restarts: int = 20, off_balance: float = 1.0, off_diploid: float = 10.0, seed: int = 0) -> DataFrame:
    """(clone, ploidy, restart, loss, state, a, b): the best copies of each state, per clone.

    ``states``: (clone, state, bins, log_mu, p[, weight]); ``weight`` is the baseline that a state's
    bins hold, without it each bin holds the same. Without ``diploid`` every ploidy up to ``most_ploidy``
    starts once, from all states alike; with it (clone, state) that state is (1, 1), states far
    off don't move to (1, 1), and each ploidy starts ``restarts`` times from seeded draws.
    """
    return _best(_tries(states, most_ploidy, diploid, restarts, off_balance, off_diploid, seed), ["clone"])


def copy_solutions(states: DataFrame, *, least: float = 0.1, retry: float = 0.02, restarts: int = 20, off_balance: float = 1.0, off_diploid: float = 10.0, seed: int = 0) -> DataFrame:
    """(search, clone, ploidy, restart, loss, state, a, b): all ``SEARCHES`` of all clones in one job.

    ``states`` as in ``integer_copies``. A free search up to a lower ploidy is a part of one up to a
    higher, so each start is climbed once and the searches only choose among starts. The first search
    has no rows for a clone without a diploid state, not even among states with ``retry`` of its bins.
    """
    held = _tries(states, SEARCHES["fixed"], diploid_state(states, least, retry=retry), restarts, off_balance, off_diploid, seed)
    free = _tries(states, max(SEARCHES.values()), None, 1, off_balance, off_diploid, seed)
    names = F.array(*(F.struct(F.lit(k).alias("search"), F.lit(v).alias("most")) for k, v in SEARCHES.items() if k != "fixed"))
    shared = free.select("*", F.explode(names).alias("s")).where("ploidy <= s.most").select("*", "s.search").drop("s")
    return _best(shared.unionByName(held.withColumn("search", F.lit("fixed"))), ["search", "clone"])


def segment_copies(decoded: DataFrame, copies: DataFrame, bins: DataFrame) -> DataFrame:
    """(chr, start, end, clone, state, a, b): copies of every bin of every clone, ``bins``: (bin, chr, start, end)."""
    return decoded.join(copies.select("clone", "state", "a", "b"), ["clone", "state"]).join(bins, "bin").select("chr", "start", "end", "clone", "state", "a", "b")


def gene_copies(segments: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, clone, a, b) of ``genes(gene, chr, start, …)``: copies of the segment that holds a gene's start."""
    held = segments.select("chr", "start", "end", "clone", "a", "b")
    return point_join(genes.select("gene", "chr", "start"), held).select("gene", "clone", "a", "b")


def state_copies(copies: DataFrame, clones: Sequence[int]) -> DataFrame:
    """(state, a_<clone>, b_<clone>, …): clones side by side, for states that all of them have."""
    out = None
    for c in clones:
        own = copies.where(F.col("clone") == c).select("state", F.col("a").alias(f"a_{c}"), F.col("b").alias(f"b_{c}"))
        out = own if out is None else out.join(own, "state")
    return out
