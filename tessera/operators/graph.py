"""Spot graphs, lattices and label energies as edge tables.

Neighbour joins are equi-joins on grid cells at least as wide as the radius, over the cell and its
eight neighbours, so that no pair beyond them is ever formed.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import digitize
from .storage import keep

#: Squared distance between neighbours in a hexagonal array with these units.
UNIT = 12.0


def squared_distance(xx: float = 9.0, yy: float = 3.0) -> Column:
    return xx * (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + yy * (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2"))


def near_pairs(spots: DataFrame, reach: float, xx: float = 9.0, yy: float = 3.0) -> DataFrame:
    """(sample, src, dst, d2) of distinct spots of a sample with xx·dx² + yy·dy² <= reach."""
    wx, wy = (max(1e-9, math.sqrt(reach / unit)) for unit in (xx, yy))
    cell = spots.select("sample", "spot", "x", "y", F.floor(F.col("x") / wx).alias("cx"), F.floor(F.col("y") / wy).alias("cy"))
    a = cell.select("sample", F.col("spot").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c"))
    a = a.select("sample", "src", "x1", "y1", "c.cx", "c.cy")
    b = cell.select("sample", "cx", "cy", F.col("spot").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = a.join(b, ["sample", "cx", "cy"]).where(F.col("src") != F.col("dst")).withColumn("d2", squared_distance(xx, yy))
    return met.where(F.col("d2") <= reach).select("sample", "src", "dst", "d2")


def adjacency(spots: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Pairs within ``ratio`` neighbour distances."""
    return near_pairs(spots, ratio * UNIT)


def weighted_adjacency(spots: DataFrame, bandwidth: float = UNIT, decay: float = 5.0, least: float = 1e-4) -> DataFrame:
    """(sample, src, dst, weight): exp(-(d²/bandwidth)^decay) where above ``least``."""
    reach = bandwidth * (-math.log(least)) ** (1 / decay)
    pairs = near_pairs(spots, reach).withColumn("weight", F.exp(-F.pow(F.col("d2") / bandwidth, F.lit(decay))))
    return pairs.where(F.col("weight") > least).select("sample", "src", "dst", "weight")


def adaptive_graph(spots: DataFrame, most: int = 7, least_weight: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """(pooling edges with self, coupling edges) with radii chosen from the spots.

    Pooling: the largest radius in 0 to 9 before the median number of pooled spots exceeds
    ``most``. Coupling: the first bandwidth whose median weight reaches ``least_weight``; pooled
    pairs don't couple. Three rows of medians come to the driver.
    """
    def medians(pairs: DataFrame, values: list[Column]) -> list[float]:
        """Medians over all spots of sums over their pairs, in one job."""
        sums = pairs.groupBy(F.col("src").alias("spot")).agg(*(F.sum(v).alias(f"v{i}") for i, v in enumerate(values)))
        every = spots.select("spot").join(sums, "spot", "left")
        return [x or 0.0 for x in every.agg(*(F.median(F.coalesce(f"v{i}", F.lit(0.0))) for i in range(len(values)))).head()]

    near = near_pairs(spots, 9 * UNIT * 1.5)
    least = near.groupBy("src").agg(F.min("d2").alias("d2")).agg(F.median("d2")).head()[0]
    scale = (least or UNIT) / UNIT
    sizes = medians(near, [(F.col("d2") <= r * scale * UNIT * (1 + 1e-9)).cast("double") for r in range(10)])
    chosen = next((r - 1 for r in range(1, 10) if sizes[r] + 1 > most), 9)
    pool = near.where(F.col("d2") <= chosen * scale * UNIT * (1 + 1e-9)).select("src", "dst")
    widths = [UNIT * step for step in range(1, 15)]
    reach = widths[-1] * (-math.log(1e-4)) ** 0.2
    free = near_pairs(spots, reach).join(pool, ["src", "dst"], "left_anti")
    kernels = [F.exp(-F.pow(F.col("d2") / w, F.lit(5.0))) for w in widths]
    weights = medians(free, [F.when(k > 1e-4, k).otherwise(0.0) for k in kernels])
    width = next((w for w, v in zip(widths, weights, strict=True) if v >= least_weight), widths[-1])
    couple = weighted_adjacency(spots, width).join(pool, ["src", "dst"], "left_anti")
    itself = spots.select(F.col("spot").alias("src"), F.col("spot").alias("dst"))
    return pool.unionByName(itself), couple.select("src", "dst", "weight")


def slice_neighbours(positions: DataFrame, k: int = 1, most: float = math.inf, width: float | None = None) -> DataFrame:
    """(src, dst, d2): the k nearest spots of the slices next to each spot's own, within ``most``.

    Spots ask the grid cells around their own. Who finds k spots no farther than a cell's width is
    done, as nothing nearer can lie beyond; the others ask again on a grid of twice the width,
    until cells are as wide as the slices or ``most``. ``width`` of the first cells: by default such
    that a cell holds about 2k spots. Each round's table has at most nine cells' spots a row.
    """
    a = positions.select(F.col("z").alias("z1"), F.col("spot").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(F.array(F.col("z") - 1, F.col("z") + 1)).alias("z"))
    b = positions.select("z", F.col("spot").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    n, slices, wide, high = positions.agg(F.count(F.lit(1)), F.countDistinct("z"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    extent = max(wide or 0.0, high or 0.0, 1e-9)
    area = max(wide or 0.0, extent * 1e-3) * max(high or 0.0, extent * 1e-3)
    w = width or math.sqrt(2 * k * area * max(slices, 1) / max(n, 1))
    pending, found = a.join(b.select("z").distinct(), "z", "left_semi"), []
    while True:
        w = min(w, max(most, 1e-9))
        last = w >= min(extent, most)
        around = F.array(*(F.struct((F.floor(F.col("x1") / w) + i).alias("i"), (F.floor(F.col("y1") / w) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        cells = b.withColumn("cell", F.struct(F.floor(F.col("x2") / w).alias("i"), F.floor(F.col("y2") / w).alias("j")))
        met = pending.withColumn("cell", F.explode(around)).join(cells, ["z", "cell"]).withColumn("d2", squared_distance(1.0, 1.0)).where(F.col("d2") <= most * most)
        rank = F.row_number().over(Window.partitionBy("src", "z").orderBy("d2", "dst"))
        near = keep(met.withColumn("_r", rank).where(F.col("_r") <= k).select("src", "z", "dst", "d2"))
        if last:
            found.append(near)
            break
        done = near.where(F.col("d2") <= w * w).groupBy("src", "z").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("src", "z")
        found.append(near.join(done, ["src", "z"], "left_semi"))
        pending = keep(pending.join(done, ["src", "z"], "left_anti"))
        if pending.isEmpty():
            break
        w *= 2
    return functools.reduce(DataFrame.unionByName, found).select("src", "dst", "d2")


def best_matches(pi: DataFrame, slack: float = 1e-6) -> DataFrame:
    """(src, dst, weight) both ways: each source's targets within ``slack`` of its best, normalised.

    ``pi``: (src, dst, value); weights are divided by the larger of the source's and target's sums.
    """
    top = pi.withColumn("_m", F.max("value").over(Window.partitionBy("src"))).where((F.col("_m") > slack) & (F.col("value") >= F.col("_m") - slack))
    row, col = (F.sum("value").over(Window.partitionBy(c)) for c in ("src", "dst"))
    kept = top.select("src", "dst", (F.col("value") / F.greatest(row, col)).alias("weight"))
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def grid_partition(spots: DataFrame, nx: int, ny: int) -> DataFrame:
    """Adds ``block``: the cell of a grid of nx by ny over each sample's extent (edges belong to the cell below)."""
    w = Window.partitionBy("sample")
    frame = spots.select("*", F.min("x").over(w).alias("x0"), F.max("x").over(w).alias("x1"), F.min("y").over(w).alias("y0"), F.max("y").over(w).alias("y1"))

    def part(v: str, lo: str, hi: str, n: int) -> Column:
        scaled = (F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))
        return digitize(F.coalesce(scaled, F.lit(0.0)), [k / n for k in range(1, n)])

    return frame.withColumn("block", part("x", "x0", "x1", nx) * ny + part("y", "y0", "y1", ny)).drop("x0", "x1", "y0", "y1")


def lattice(spark: SparkSession, nx: int, ny: int, z: float = 0.0) -> DataFrame:
    """(node, x, y, z) of a triangular lattice."""
    i, j = F.expr(f"id div {nx}"), F.col("id") % nx
    return spark.range(nx * ny).select(F.col("id").alias("node"), (j + 0.5 * i).alias("x"), (i * F.lit(math.sqrt(3) / 2)).alias("y"), F.lit(float(z)).alias("z"))


def lattice_edges(spark: SparkSession, nx: int, ny: int, offset: int = 0) -> DataFrame:
    """(src, dst): the six neighbours of every lattice node."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))))
    at = spark.range(nx * ny).select("id", (F.col("id") % nx).alias("x"), F.expr(f"id div {nx}").alias("y"), F.explode(steps).alias("s"))
    to = at.select("id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
    return to.select((F.col("id") + offset).alias("src"), (F.col("y") * nx + F.col("x") + offset).alias("dst"))


def upsert_edges(edges: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(src, dst, weight, conflict): each edge once; ``conflict`` where its weights differ."""
    return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"), (F.max("weight") - F.min("weight") > slack).alias("conflict"))


def with_links(edges: DataFrame, more: DataFrame | None) -> DataFrame:
    """(src, dst, weight): the graphs of all samples stacked, and links between slices beside them; weights of one pair add up."""
    both = edges.select("src", "dst", "weight")
    if more is not None:
        both = both.unionByName(more.select("src", "dst", "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight) of the listed ``nodes(node)`` alone."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(src, neighbours): sorted (dst, weight) pairs; spots have few neighbours."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def potts_energy(edges: DataFrame, labels: DataFrame, coupling: float = 1.0, field: DataFrame | None = None) -> DataFrame:
    """(energy): coupling · Σ weight over unlike pairs, each once, less the field at the labels (``field(node, label, h)``)."""
    pairs = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("weight").alias("weight")).where("u < v")
    a, b = (labels.select(F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in "uv")
    unlike = pairs.join(a, "u").join(b, "v").agg(F.coalesce(F.sum(F.when(F.col("lu") != F.col("lv"), F.col("weight")).otherwise(0.0)), F.lit(0.0)).alias("e"))
    if field is None:
        return unlike.select((coupling * F.col("e")).alias("energy"))
    held = labels.join(field, ["node", "label"]).agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("h"))
    return unlike.join(held).select((coupling * F.col("e") - F.col("h")).alias("energy"))  # one row each


def random_labels(nodes: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Adds a label from 0 to ``most`` - 1 that depends on the node and the seed only."""
    return nodes.withColumn("label", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(most)).cast("int"))
