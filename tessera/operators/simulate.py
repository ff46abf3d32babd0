"""Simulation: random partitions, label sweeps, phylogenies and spot counts. All draws are seeded.

A spot's counts depend on the seed and its own id only, so spots are simulated wherever they
stand and a lost executor's spots come out the same again.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import potts_energy
from .storage import keep
from .sweep import Field


def random_rectangles(spots: DataFrame, n_clones: int, seed: int = 0, tries: int = 256) -> DataFrame:
    """Adds ``clone``: a random grid over the inner 5 to 95 percentiles, its cells dealt to clones at random.

    Widths are Dirichlet(10) draws; a draw counts once every clone has over a fifth of its even
    share of spots. Sixteen draws are judged in one pass, and only their counts come to the
    driver. If none of ``tries`` draws counts (spots too few, or on a line), a warning says so and
    the one whose clones are most even is taken.
    """
    from ..functions.columns import digitize

    rng = np.random.default_rng(seed)
    p = int(np.ceil(np.sqrt(n_clones)))
    lo_x, hi_x, lo_y, hi_y, n = spots.agg(F.percentile("x", F.lit(0.05)), F.percentile("x", F.lit(0.95)), F.percentile("y", F.lit(0.05)), F.percentile("y", F.lit(0.95)), F.count(F.lit(1))).head()
    if not n:
        return spots.withColumn("clone", F.lit(0))
    best = (-1, -1, F.lit(0))
    for _ in range(0, tries, 16):
        draws = []
        for _ in range(16):
            cut_x, cut_y = ((lo + (hi - lo) * np.cumsum(rng.dirichlet([10.0] * p))[:-1]).tolist() for lo, hi in ((lo_x, hi_x), (lo_y, hi_y)))
            deal = np.concatenate([np.arange(n_clones), rng.integers(0, n_clones, p * p - n_clones)])
            rng.shuffle(deal)
            draws.append(F.array(*(F.lit(int(c)) for c in deal))[digitize(F.col("x"), cut_x) * p + digitize(F.col("y"), cut_y)])
        tagged = spots.select(F.array(*draws).alias("d")).select(F.posexplode("d").alias("draw", "clone")).groupBy("draw", "clone").agg(F.count(F.lit(1)).alias("n"))
        sizes = tagged.groupBy("draw").agg(F.count(F.lit(1)).alias("clones"), F.min("n").alias("least")).collect()
        top = max(sizes, key=lambda r: (r.clones, r.least, -r.draw))
        best = max(best, (top.clones, top.least, draws[top.draw]), key=lambda t: t[:2])
        if best[0] == n_clones and best[1] > 0.2 * n / n_clones:
            return spots.withColumn("clone", best[2])
    warnings.warn(f"no draw gives {n_clones} clones enough of {n} spots; the most even one is taken", stacklevel=2)
    return spots.withColumn("clone", best[2])


def _other(label: int, most: int, draw: float) -> int:
    """Another label at random, if there is one."""
    return (label + 1 + int(draw * (most - 1))) % most if most > 1 else label


def _field(nodes: DataFrame, edges: DataFrame, coupling: float) -> tuple[Field, DataFrame]:
    field = Field(nodes.select("node", F.col("h").alias("score")), edges, coupling)
    return field, field.start(nodes.select("node", "label"))


def learn_labels(nodes: DataFrame, edges: DataFrame, most: int, *, coupling: float = 1.0, epsilon: float = 1.0, sweeps: int = 20, seed: int = 0) -> DataFrame:
    """(sample, node, label): greedy sweeps that draw another label with probability epsilon / t in sweep t.

    Sweeps end where no label changes or the energy stays the same. Draws hang on seed, sweep and
    node alone, so every run gives the same labels.

    ``nodes``: (sample, node, label, h) with one field value per label.
    """

    def choose(cost: np.ndarray, label: int, draws: np.ndarray, sweep: int) -> int:
        return _other(label, most, draws[1]) if draws[0] < epsilon / sweep else int(cost.argmax())

    held = nodes.select("node", F.posexplode("h").alias("label", "h"))

    def energy(state: DataFrame) -> float:
        return float(potts_energy(edges, state.select("node", F.col("now").alias("label")), coupling, held).first()[0])

    field, state = _field(nodes, edges, coupling)
    before = energy(state)
    for t in range(1, sweeps + 1):
        state, edits = field.sweep(state, choose, t, seed)
        now = energy(state)
        if not edits or abs(now - before) < 1e-12:
            break
        before = now
    return nodes.select("sample", "node").join(state.select("node", F.col("now").alias("label")), "node").select("sample", "node", "label")


def metropolis(nodes: DataFrame, edges: DataFrame, most: int, *, coupling: float = 1.0, beta: float = 1.0, sweeps: int = 1, seed: int = 0) -> DataFrame:
    """(sample, node, label) after Metropolis sweeps at inverse temperature ``beta``; a proposal is always another label."""

    def choose(cost: np.ndarray, label: int, draws: np.ndarray, sweep: int) -> int:
        trial = _other(label, most, draws[1])
        return trial if draws[0] < np.exp(min(0.0, beta * (cost[trial] - cost[label]))) else label

    field, state = _field(nodes, edges, coupling)
    for t in range(1, sweeps + 1):
        state, _ = field.sweep(state, choose, t, seed)
    return nodes.select("sample", "node").join(state.select("node", F.col("now").alias("label")), "node").select("sample", "node", "label")


def poisson_baseline(spark: SparkSession, segments: int, rate: float, seed: int = 0) -> DataFrame:
    """(segment, weight): normalised Poisson draws, each from its own segment's stream."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"segment": pdf["id"], "n": [float(np.random.default_rng((seed, i)).poisson(rate)) for i in pdf["id"]]})

    raw = spark.range(segments).mapInPandas(draw, "segment long, n double")
    total = raw.agg(F.sum("n").alias("total"))
    return raw.join(F.broadcast(total)).select("segment", (F.col("n") / F.nullif("total", F.lit(0.0))).alias("weight"))


def negative_binomial(rng: np.random.Generator, mean: np.ndarray, dispersion: float) -> np.ndarray:
    """Gamma-Poisson draws; 0 where the mean is 0."""
    mean = np.asarray(mean, float)
    rate = rng.gamma(1 / dispersion, np.maximum(mean, 1e-300) * dispersion)
    return np.where(mean > 0, rng.poisson(np.where(mean > 0, rate, 0)), 0)


def segment_draws(rng: np.random.Generator, total: int, weights: np.ndarray) -> np.ndarray:
    """A total dealt to segments in proportion to weights (as many entries as weights)."""
    return rng.multinomial(total, weights / weights.sum())


def profiles(events: DataFrame, segments: DataFrame, size: int) -> DataFrame:
    """(spot, segment, rdr, baf): what a spot's copy-number events make of each segment, mixed by purity.

    ``events``: (spot, purity, ordinal, start, end, a, b); later ones overwrite earlier ones;
    segments without events are diploid.
    """
    hit = events.select("spot", "purity", "ordinal", "a", "b", F.explode(F.sequence(F.floor(F.col("start") / size).cast("long"), F.ceil(F.col("end") / size).cast("long") - 1)).alias("segment"))
    last = hit.groupBy("spot", "segment").agg(F.max_by(F.struct("purity", "a", "b"), "ordinal").alias("e"))
    grid = events.select("spot").distinct().join(segments.select("segment"), how="cross")  # the answer has one row for each
    rows = grid.join(last, ["spot", "segment"], "left")
    pi, total = F.col("e.purity"), F.col("e.a") + F.col("e.b")
    rdr = F.coalesce(1 - pi + pi * total / 2, F.lit(1.0))
    baf = F.coalesce(0.5 * (1 - pi) + pi * F.coalesce(F.least("e.a", "e.b") / F.nullif(total, F.lit(0)), F.lit(0.5)) * rdr, F.lit(0.5))
    return rows.select("spot", "segment", rdr.alias("rdr"), baf.alias("baf"))


def simulate_spots(profile: DataFrame, expression: DataFrame, *, umi: tuple[float, float] = (3.5, 0.16), snp: tuple[float, float] = (2.6, 0.15), dispersion: float = 0.1, concentration: float = 10.0, seed: int = 0) -> DataFrame:
    """(spot, segment, umi, depth, b): counts drawn for ``profile(spot, segment, rdr, baf)``.

    ``expression``: (segment, weight). A spot's totals are log-normal (base 10); reads follow the
    profile, allele reads a beta-binomial around its share.
    """
    held = F.array_sort(F.collect_list(F.struct("segment", "rdr", "baf", "weight")))
    rows = profile.join(expression, "segment").groupBy("spot").agg(held.alias("at"))

    def draw(spot: int, segments: np.ndarray, rdr: np.ndarray, baf: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        rng = np.random.default_rng((seed, spot))
        totals = 10 ** rng.normal(*umi), 10 ** rng.normal(*snp)
        w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
        mean, baf = totals[0] * w * rdr, np.clip(baf, 0, 1)
        depth = segment_draws(rng, int(totals[1]), w)
        share = rng.beta(1 + concentration * baf, 1 + concentration * (1 - baf))
        return [np.full(len(segments), spot), segments, negative_binomial(rng, mean, dispersion), depth, rng.binomial(depth, share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at")
            ends = np.cumsum(np.asarray(at.value_lengths()))
            columns = [np.split(np.asarray(x.cast(kind).fill_null(np.nan) if kind == pa.float64() else x), ends[:-1]) for x, kind in zip(at.flatten().flatten(), (None, *[pa.float64()] * 3), strict=True)]
            drawn = [draw(spot, *own) for spot, *own in zip(batch.column("spot").to_pylist(), *columns, strict=True)]
            names = ["spot", "segment", "umi", "depth", "b"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*drawn, strict=True)], names)

    return rows.mapInArrow(run, "spot long, segment long, umi long, depth long, b long")


def grow_tree(steps: int = 4, *, segments: int = 2181, size: int = 500, parsimony: float = 0.25, passengers: int = 10, seed: int = 0) -> list[dict]:
    """Nodes of a clone tree: id, parent, own events [(a, b, start, end)], and centre and radii of an ellipse.

    In each step a random leaf splits in two; an event is, with probability ``parsimony``, one
    that another lineage has already. Leaves are padded with passenger events.
    """
    rng = np.random.default_rng(seed)
    nodes = [{"id": 0, "parent": None, "events": [], "center": (0.0, 0.0), "radius": 1.0}]
    states = [(1, 0), (2, 0), (2, 1), (3, 1), (2, 2), (0, 1)]

    def lineage(i: int | None) -> list:
        return [] if i is None else lineage(nodes[i]["parent"]) + nodes[i]["events"]

    def event(known: list) -> tuple:
        others = sorted({e for n in nodes for e in n["events"]} - set(known))
        if others and rng.random() < parsimony:
            return others[rng.integers(len(others))]
        start = int(rng.integers(segments - 20))
        a, b = states[rng.integers(len(states))]
        return a, b, start * size, (start + int(rng.integers(5, 20))) * size

    for _ in range(steps):
        inner = {n["parent"] for n in nodes}
        leaves = [n["id"] for n in nodes if n["id"] not in inner]
        top = leaves[rng.integers(len(leaves))]
        for side in (-1, 1):
            r = nodes[top]["radius"] * float(0.5 + 0.2 * rng.random())
            nodes.append({"id": len(nodes), "parent": top, "events": [event(lineage(top))], "center": (nodes[top]["center"][0] + side * r, nodes[top]["center"][1] + float(rng.normal(0, 0.1))), "radius": r})
    inner = {n["parent"] for n in nodes}
    for n in nodes:
        if n["id"] not in inner:
            while len(lineage(n["id"])) < passengers:
                n["events"].append(event(lineage(n["id"])))
    return nodes


def lineages(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(leaf, ancestor, depth) of ``nodes(id, parent)``, by path doubling.

    Each round joins the known paths with those of the largest length, so rounds grow with the
    logarithm of the tree's depth.
    """
    parents = nodes.where("parent is not null").select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("ancestor"))
    paths, length = keep(parents.withColumn("depth", F.lit(1))), 1
    while True:
        longest = paths.where(F.col("depth") == length)
        if longest.isEmpty():
            break
        more = longest.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths, length = keep(paths.unionByName(more)), 2 * length
    own = nodes.select(F.col("id").cast("long").alias("id")).withColumn("ancestor", F.col("id")).withColumn("depth", F.lit(0))
    leaves = own.join(parents.select(F.col("ancestor").alias("id")), "id", "left_anti").select(F.col("id").alias("leaf"))
    every = own.unionByName(paths).withColumnRenamed("id", "leaf")
    return every.join(leaves, "leaf", "left_semi").select("leaf", "ancestor", "depth")


def smallest_ellipse(points: DataFrame, ellipses: DataFrame) -> DataFrame:
    """(…point columns, clone): of the ellipses around a point the one of the smallest area; -1 where none is.

    ``ellipses``: (clone, cx, cy, l11, l12, l21, l22), a few rows.
    """
    from ..functions.columns import ellipse_holds

    e = F.broadcast(ellipses.withColumn("det", F.abs(F.col("l11") * F.col("l22") - F.col("l12") * F.col("l21"))))  # clones of one tree
    inside = ellipse_holds(F.col("x"), F.col("y"), *(F.col(c) for c in ("cx", "cy", "l11", "l12", "l21", "l22")))
    met = points.join(e, inside, "left")
    return met.groupBy(*points.columns).agg(F.coalesce(F.min_by("clone", F.struct("det", "clone")), F.lit(-1)).alias("clone"))
