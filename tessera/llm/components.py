"""Connected components of a link table, by alternating star operations on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, schema

EDGES = "a long, b long"
#: Links that one task contracts at first: many together, so that few pass its border.
TASK_LINKS = 100_000


class UnionFind:
    """Smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition to stars around their smallest members: as many links or fewer."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
    nodes = sorted(sets.up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([sets.find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)`` that isn't its component's smallest member.

    Partitions first contract their own links. Then large-star and small-star steps alternate,
    each a minimum per node by partial aggregation and a join, until nothing changes; their number
    grows with the logarithm of the longest path. Only two figures per round come to the driver.
    """
    plain = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "links")
    tasks = -(-plain.count() // TASK_LINKS)
    edges = materialise(plain.coalesce(max(1, tasks)).mapInArrow(_contract, schema(EDGES)), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a node joins the smallest one
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its smaller neighbours join the smallest of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = materialise(small.mapInArrow(_contract, schema(EDGES)).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).head()
        if now == before and now[0] == now[2]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = now

