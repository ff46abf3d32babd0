"""Sequential label sweeps over one large graph, without a group that holds a sample.

In a sweep nodes are visited by rising id, and each sees its smaller neighbours' new labels and its
larger ones' old labels. The new labels are thus the one solution of a system in which a node hangs
on smaller ids only. It is solved tile by tile: every tile (a range of ids of bounded size) sweeps
its own nodes in order, taking the new labels of its neighbours outside from the round before, until
a round changes nothing that a later tile sees. Chains of nodes that hang on each other across tiles
set the number of rounds, and what comes out equals a plain loop over all nodes. Links may join any two nodes, so
stacked slices are one graph.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rank_among
from .storage import keep

#: Nodes of a tile on average.
TILE = 4096
#: (cost of each label, present label, three uniform draws of the node in this sweep, number of the sweep) -> label.
Choice = Callable[[np.ndarray, int, np.ndarray, int], int]
STATE = "tile int, node long, old int, now int, ahead boolean, cost array<double>, moved boolean"


def best(cost: np.ndarray, label: int, draws: np.ndarray, sweep: int) -> int:
    """The label of the highest cost, the first on ties."""
    return int(cost.argmax())


def uniform(nodes: np.ndarray, seed: int, sweep: int) -> np.ndarray:
    """Three draws from [0, 1) for each node: functions of seed, sweep and node alone."""
    out = np.empty((len(nodes), 3))
    with np.errstate(over="ignore"):
        for k in range(3):
            x = nodes.astype(np.uint64) + np.uint64(((seed * 1_000_003 + sweep) * 3 + k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            out[:, k] = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return out


class Field:
    """Nodes with a score for each label and weighted links, dealt to tiles.

    ``nodes``: (node, score array); ``edges``: (src, dst, weight), of which those to unknown nodes
    and loops don't count. Tables of one row a node; each lies in the checkpoint folder.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, weight: float = 1.0, tile: int = TILE) -> None:
        self.weight = weight
        nodes = keep(nodes.select(F.col("node").cast("long").alias("node"), "score"))
        self.size = nodes.count()
        tiles = max(1, -(-self.size // tile))
        cuts = [i / tiles for i in range(1, tiles)]
        bounds = nodes.agg(F.percentile_approx("node", cuts, max(10_000, 4 * tiles)).alias("at")).first()["at"] if cuts else []
        placed = nodes.withColumn("tile", rank_among(sorted(set(bounds)), F.col("node")))
        where = placed.select("node", "tile")
        links = edges.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("w")).where("node <> dst")
        links = links.join(where.select(F.col("node").alias("dst"), F.col("tile").alias("t")), "dst").groupBy("node").agg(F.collect_list(F.struct("dst", "w", "t")).alias("near"))
        self.nodes = keep(placed.join(links, "node", "left").repartition("tile"))
        beyond = self.nodes.select("tile", F.explode("near").alias("n")).where("n.t <> tile").groupBy(F.col("tile").alias("part"), F.col("n.dst").alias("id")).agg(F.first(F.col("n.t") < F.col("tile")).alias("ahead"))
        self.beyond = keep(beyond) if tiles > 1 else None
        self.rounds = 0

    def start(self, labels: DataFrame) -> DataFrame:
        """The state with the labels (node, label) that a sweep begins with; nodes without one have 0. ``ahead``: a later tile sees the node."""
        rows = self.nodes.select("tile", "node").join(labels.select(F.col("node").cast("long").alias("node"), F.col("label").cast("int").alias("label")), "node", "left")
        label = F.coalesce("label", F.lit(0))
        rows = rows.select("tile", "node", label.alias("old"), label.alias("now"))
        if self.beyond is None:
            return rows.withColumn("ahead", F.lit(False))
        seen = self.beyond.where("ahead").select(F.col("id").alias("node"), "ahead").distinct()
        return rows.join(seen, "node", "left").withColumn("ahead", F.coalesce("ahead", F.lit(False)))

    def sweep(self, state: DataFrame, choose: Choice = best, number: int = 1, seed: int = 0) -> tuple[DataFrame, int]:
        """(state after the sweep, labels that it changed)."""
        state = state.select("tile", "node", F.col("now").alias("old"), "now", "ahead")
        run = _tile_sweeper(choose, self.weight, number, seed)
        while True:
            given = state.select(F.col("tile").alias("part"), F.col("node").alias("id"), "old", "now", "ahead")
            if self.beyond is not None:
                given = given.unionByName(self.beyond.drop("ahead").join(given.drop("part"), "id").select("part", "id", "old", "now", "ahead"))
            state = keep(self.nodes.groupBy("tile").cogroup(given.groupBy("part")).applyInArrow(run, STATE))
            self.rounds += 1
            moved, edits = state.agg(F.count_if("moved"), F.count_if(F.col("now") != F.col("old"))).first()
            if not moved or self.beyond is None:
                return state, edits


def _tile_sweeper(choose: Choice, weight: float, number: int, seed: int):
    greedy = choose is best

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        own, given = own.sort_by("node").combine_chunks(), given.sort_by("id").combine_chunks()
        ids, known, old, now, ahead = (c.to_numpy() for c in (own["node"], given["id"], given["old"], given["now"], given["ahead"]))
        n, now = len(ids), now.copy()
        place = np.searchsorted(known, ids)
        before = now[place]
        score = pa.concat_arrays(own["score"].chunks).flatten().to_numpy().reshape(n, -1)
        k = score.shape[1]
        near = pa.concat_arrays(own["near"].chunks)
        links = near.flatten()
        dst, w = (links.field(c).to_numpy() for c in ("dst", "w"))
        ends = np.concatenate([[0], np.cumsum(near.value_lengths().fill_null(0).to_numpy())])
        node, at = np.repeat(np.arange(n), np.diff(ends)), np.searchsorted(known, dst)
        smaller = dst < ids[node]  # these have been visited, larger ones not yet
        draws = uniform(ids, seed, number)
        costs = score + weight * np.bincount(node * k + np.where(smaller, now[at], old[at]), w, n * k).reshape(n, k)
        picks = costs.argmax(axis=1).tolist() if greedy else None

        # Costs hold for the labels of before; a node whose smaller neighbour takes another one here is reckoned anew.
        within = np.flatnonzero(smaller & (dst >= ids[0]))
        within = within[np.argsort(dst[within], kind="stable")]
        first = np.searchsorted(dst[within], [ids, ids + 1]).T.tolist()
        follower, stale, was, label = node[within], np.zeros(n, bool), before.tolist(), old[place].tolist()
        for i in range(n):
            if stale[i]:
                s = slice(ends[i], ends[i + 1])
                costs[i] = score[i] + weight * np.bincount(np.where(smaller[s], now[at[s]], old[at[s]]), w[s], k)
            if not greedy:
                pick = choose(costs[i], label[i], draws[i], number)
            elif stale[i]:
                pick = int(costs[i].argmax())
            else:
                pick = picks[i]
            if pick != was[i]:
                now[place[i]] = pick
                stale[follower[slice(*first[i])]] = True
        found, seen = now[place], ahead[place]
        parts = own["tile"], own["node"], old[place], found, seen, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(costs.ravel())), (found != before) & seen
        return pa.table(dict(zip(("tile", "node", "old", "now", "ahead", "cost", "moved"), parts, strict=True)))

    return run
