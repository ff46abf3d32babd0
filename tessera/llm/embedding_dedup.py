"""Embedding near-duplicates by sorted projection passes (operator 9).

A pass gives each vector the signs of ``BITS`` random projections, sorts all vectors
lexicographically by them (dealt out by ranges of the sort key, so that equal keys spread) and
compares each with the ``NEAR`` vectors before it. Likely pairs, judged on vectors rounded to 8
bits, are confirmed in double precision. Where a window ends among near ones (a topic whose vectors
are all alike), links can lie beyond it: such crowded vectors are chained to their neighbours too.
Links and chains of all passes unite into regions, and inside a region links are found and counted
exactly, block against block, so that the window bounds no one's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, schema, table
from .components import UnionFind, components

BITS, NEAR = 64, 64
#: Passes at least; beyond that as many as keep the share of missed pairs at the threshold under MISS.
PASSES, MISS = 12, 0.01
#: How far the cosine of rounded vectors may lie from the exact one.
SLACK = 0.03
#: Vectors of a region's block on average; two blocks meet in one task.
BLOCK = 512
#: A vector is crowded if so many of its window's vectors have at least this cosine with it: there a window ends among near ones.
CROWD, LOOSE = NEAR * 3 // 4, 0.5


def n_passes(n: int, threshold: float) -> int:
    """Passes over ``n`` vectors: one brings a pair near if the signs that split n into windows agree."""
    agree = 1 - math.acos(max(-1.0, min(threshold, 1.0))) / math.pi
    met = agree ** math.log2(max(n / NEAR, 1))
    return PASSES if met >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-met)))


def _projection(k: int, dim: int) -> np.ndarray:
    return np.random.default_rng((9, k, dim)).standard_normal((dim, BITS))


def _record(dim: int) -> np.dtype:
    return np.dtype([("order", ">u2"), ("key", "u1", BITS // 8), ("node", "<i8"), ("rounded", "i1", dim)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unit(np.array(column.flatten(), dtype=np.float64).reshape(-1, dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest part first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projector(dim: int, passes: int):
    """One record per vector and pass."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _record(dim)
        planes = [_projection(k, dim) for k in range(passes)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            out = np.zeros((passes, len(x)), kind)
            out["node"] = batch.column(0).to_numpy(zero_copy_only=False)
            out["rounded"] = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127)
            for k, plane in enumerate(planes):
                out["order"][k] = k
                out["key"][k] = np.packbits(x @ plane > 0, axis=1)
            raw, width = out.tobytes(), kind.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())], ["record"])

    return project


def _walker(dim: int, threshold: float):
    """Likely pairs (a, b, chain) among neighbours of the sorted records, and chains between crowded ones.

    A pair is left out only where pairs that are links beyond rounding, or chains, join its two
    vectors anyway: pairs serve to find regions; all links inside are found later.
    """
    least, sure = threshold - SLACK, threshold + SLACK
    loose = min(LOOSE, least)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _record(dim)
        tail = np.zeros(0, kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, old = np.concatenate([tail, np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)]), len(tail)
            for lo in range(old, len(rows), 2048):
                part = rows[max(0, lo - NEAR) : lo + 2048]
                skip = lo - max(0, lo - NEAR)
                x = part["rounded"].astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sets, found, close, loosely = UnionFind(), [], np.zeros(len(part), np.int64), []
                for w in range(1, min(NEAR, len(part) - 1) + 1):
                    i = np.arange(max(w, skip), len(part))
                    cosine = np.einsum("ij,ij->i", x[i], x[i - w])
                    same = part["order"][i] == part["order"][i - w]
                    ok, near = (cosine >= least) & same, (cosine >= loose) & same
                    close[i] += near
                    if ok.any():
                        found.append(np.stack([i[ok], i[ok] - w, cosine[ok] >= sure, np.zeros(ok.sum())]))
                    if w <= 4 and near.any():
                        loosely.append(np.stack([i[near], i[near] - w, np.ones(near.sum()), np.ones(near.sum())]))
                if loosely:
                    chains = np.concatenate(loosely, axis=1)
                    found.append(chains[:, close[chains[0].astype(np.int64)] >= CROWD])
                if found:
                    i, j, firm, chain = np.concatenate(found, axis=1).astype(np.int64)
                    keep = np.ones(len(i), bool)
                    for k in (*np.flatnonzero(firm), *np.flatnonzero(firm == 0)):
                        a, b = sets.find(int(i[k])), sets.find(int(j[k]))
                        keep[k] = a != b
                        if firm[k]:
                            sets.union(a, b)
                    ab = np.stack([part["node"][i[keep]], part["node"][j[keep]]])
                    yield pa.RecordBatch.from_arrays([pa.array(ab.min(axis=0)), pa.array(ab.max(axis=0)), pa.array(chain[keep] > 0)], ["a", "b", "chain"])
            tail = rows[-NEAR:].copy()

    return walk


def _confirmer(threshold: float):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = len(batch.column(2)[0])
            x, y = (_matrix(batch.column(k), dim) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= threshold))

    return confirm


def _linker(threshold: float):
    """Links between (or inside) two blocks of one region: their number for each vector, and pairs that join the same vectors."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(pdf["embedding"].tolist(), np.float64))
        node, weight = pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        left, right = (np.flatnonzero(pdf["block"] == pdf[c]) for c in ("i", "j"))
        linked = x[left] @ x[right].T >= threshold
        out, top = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if same:
            np.fill_diagonal(linked, False)
        out[left] = linked @ weight[right]
        if not same:
            out[right] = weight[left] @ linked
        # Every vector learns the first one that it is joined to here, by whatever path.
        while linked.any():
            before = top.copy()
            top[left] = np.minimum(top[left], np.where(linked, top[right], len(pdf)).min(axis=1))
            top[right] = np.minimum(top[right], np.where(linked, top[left][:, None], len(pdf)).min(axis=0))
            if (top == before).all():
                break
        held = np.flatnonzero(out)
        return pd.DataFrame({"node": node[held], "n": out[held], "joined": node[top[held]]})

    return count


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing;
    vectors of different lengths don't link. Equal vectors are one node with a number of copies,
    all linked with each other. A null vec_id gets no links and no component; rows that share a
    vec_id share its component.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = materialise(rows.select("vec_id", "embedding", F.when(sound, F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))), 256)).alias("key")), "vectors")
    nodes = keyed.where("key is not null").groupBy("key").agg(F.min(F.struct("vec_id", "embedding")).alias("m"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.select("key", F.col("m.vec_id").alias("node"), F.col("m.embedding").alias("embedding"), "copies"), "nodes")

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    likely = None
    for dim, rows_ in sorted(nodes.groupBy(F.size("embedding")).count().collect()):
        own = nodes.where(F.size("embedding") == dim).select("node", "embedding")
        sorted_ = own.mapInArrow(_projector(dim, n_passes(rows_, threshold)), schema("record binary")).repartitionByRange(n, "record").sortWithinPartitions("record")
        pairs = sorted_.mapInArrow(_walker(dim, threshold), schema("a long, b long, chain boolean"))
        likely = pairs if likely is None else likely.unionByName(pairs)
    if likely is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    x, y = (nodes.select(F.col("node").alias(c), F.col("embedding").alias(f"e_{c}")) for c in "ab")
    likely = materialise(likely.where("a < b").groupBy("a", "b").agg(F.max("chain").alias("chain")), "likely")
    links = likely.where("not chain").join(x, "a").join(y, "b").where(F.size("e_a") == F.size("e_b")).select("a", "b", "e_a", "e_b").mapInArrow(_confirmer(threshold), schema("a long, b long"))
    regions = components(links.unionByName(likely.where("chain").select("a", "b")))
    members = regions.unionByName(regions.select(F.col("component").alias("node"), "component").distinct())
    members = materialise(members.join(nodes, "node"), "members")

    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", "node", "embedding", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Dealt anew: else all pairs of blocks of a region would stay where its join brought them.
    found = met.repartition(n, "component", "i", "j").groupBy("component", "i", "j").applyInPandas(_linker(threshold), schema("node long, n long, joined long"))
    found = materialise(found, "found")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = components(found.where("node <> joined").select(F.least("node", "joined").alias("a"), F.greatest("node", "joined").alias("b")).distinct())
    classes = nodes.join(known, "node", "left").join(counted, "node", "left")
    classes = materialise(classes.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "classes")
    return keyed.select("vec_id", "key").join(classes, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    found = embedding_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
