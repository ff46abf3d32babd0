"""Centroid clustering by Hamerly bounds in exact integers (operator 11).

Vectors are packed once into blocks and written bucketed by block. Each round keeps, per vector, its
centroid, an upper bound of the distance to it and a lower bound of the distance to any other
centroid, in a table bucketed alike: a round joins both without a shuffle and writes bounds only,
never vectors. Bounds are loosened by how far the centroids drifted; vectors they don't settle get
all their distances anew, in integers. Sums move by what changed place, so they stay exact.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, new_path, schema, table

#: Vectors of a block, and the largest magnitude of an entry at which 64-bit distances stay exact.
BLOCK, MOST = 4096, 2**27
#: Relative margin of the bounds: far above the rounding of a few dozen double operations.
MARGIN = 1e-9
STATE = "block long, cluster binary, upper binary, lower binary, scanned long, moved array<struct<cluster:int,n:long,total:array<long>>>"


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = np.floor(np.array(column.flatten(), dtype=np.float64).reshape(-1, dim) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"an entry exceeds {MOST} after scaling: squared distances would not fit 64 bits")
    return x.astype(np.int64)


def _packer(dim: int, scale: int):
    """Blocks of vectors: ids, and the integers as bytes (four each: they are at most 2**27)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids, parts, held, made = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(parts).astype("<i4").tobytes()], pa.binary())], ["block", "ids", "x"])

        for batch in batches:
            if batch.num_rows:
                ids += batch.column(0).to_pylist()
                parts.append(_integers(batch.column(1), dim, scale))
                held += batch.num_rows
            if held >= BLOCK:
                yield block()
                ids, parts, held, made = [], [], 0, made + 1
        if held:
            yield block()

    return pack


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    return np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)


def settle(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray, state=None):
    """(cluster, upper, lower, vectors scanned) after the centroids moved by ``drift``."""
    n, k = len(x), len(centroids)
    if state is None:
        cluster, upper, lower, open_ = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        cluster, upper, lower = (a.copy() for a in state)
        others = np.array([np.delete(drift, c).max(initial=0) for c in range(k)])
        apart = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        upper += drift[cluster]
        lower -= others[cluster]
        least = np.maximum(lower, apart.min(axis=1)[cluster] / 2) * (1 - MARGIN)
        open_ = np.flatnonzero(upper * (1 + MARGIN) >= least)
        upper[open_] = np.sqrt(np.square(x[open_] - centroids[cluster[open_]]).sum(axis=1).astype(np.float64))
        open_ = open_[upper[open_] * (1 + MARGIN) >= least[open_]]
    if len(open_):
        found = distances(x[open_], centroids)
        best = found.argmin(axis=1)  # ties: the smaller number
        cluster[open_], upper[open_] = best, np.sqrt(found[np.arange(len(best)), best].astype(np.float64))
        rest = found.astype(np.float64)
        rest[np.arange(len(best)), best] = np.inf
        lower[open_] = np.sqrt(rest.min(axis=1))
    return cluster, upper, lower, len(open_)


def _moved(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> list[dict]:
    """What joined less what left, for each cluster touched."""
    at = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    out = []
    for c in range(k):
        joined, left = at[new[at] == c], at[:0] if old is None else at[old[at] == c]
        if len(joined) or len(left):
            out.append({"cluster": c, "n": len(joined) - len(left), "total": (x[joined].sum(axis=0) - x[left].sum(axis=0)).tolist()})
    return out


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.int64)


def _stepper(centroids: np.ndarray, drift: np.ndarray, first: bool):
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, raw, *old = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                x = _matrix(raw, centroids.shape[1])
                state = None if first else (np.frombuffer(old[0], "<i4").astype(np.int64), np.frombuffer(old[1], "<f8"), np.frombuffer(old[2], "<f8"))
                cluster, upper, lower, scanned = settle(x, centroids, drift, state)
                moved = _moved(x, None if first else state[0], cluster, len(centroids))
                cells = [cluster.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes()]
                arrays = [pa.array([block]), *(pa.array([c], pa.binary()) for c in cells), pa.array([scanned]), pa.array([moved], kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "cluster", "upper", "lower", "scanned", "moved"])

    return step


def _finisher(centroids: np.ndarray):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, raw, cluster = (batch.column(c)[row].as_py() for c in range(3))
                x, cluster = _matrix(raw, centroids.shape[1]), np.frombuffer(cluster, "<i4")
                far = np.square(x - centroids[cluster]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    return finish


class _Buckets:
    """Tables of one run in the shared folder, bucketed by block, gone from the catalogue at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n, self.known = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, df: DataFrame) -> str:
        name, path = f"blocks_{uuid.uuid4().hex}", new_path(self.spark, "blocks")
        df.write.bucketBy(self.n, "block").sortBy("block").option("path", path).saveAsTable(name)
        self.known[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.known.pop(name))


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:", scans: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors(vec_id, embedding)``.

    Rows whose vector is null, holds null or non-finite entries or hasn't ``dim`` of them are left
    out; the others come as often as they stand there, repeated rows, equal vectors and null ids
    included. Entries become floor(scale * entry). The first centroids are the vectors with the
    smallest sha256 of salt and id (equal hashes: by vector; null ids last), fewer if there are
    fewer. An entry beyond 2**27 is an error, never a wrong distance. Once no vector changes place
    the remaining rounds would repeat, and are left out. ``scans`` takes the number of full scans
    of each round. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where((F.size("embedding") == dim) & ~bad)
    hashed = kept.withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    seeds = hashed.orderBy(F.asc_nulls_last("hash"), "embedding").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _integers(pa.array([r.embedding for r in seeds]), dim, scale)

    tables = _Buckets(spark)
    blocks = tables.write(kept.mapInArrow(_packer(dim, scale), schema("block long, ids array<long>, x binary")).repartition(tables.n, "block"))
    vectors_, state = spark.table(blocks), None
    count, total, drift = [0] * len(centroids), [[0] * dim for _ in centroids], np.zeros(len(centroids))
    for done in range(rounds + 1):
        given = vectors_.select("block", "x")
        if state:
            given = given.join(spark.table(state).select("block", "cluster", "upper", "lower").hint("merge"), "block")
        now = tables.write(given.mapInArrow(_stepper(centroids, drift, state is None), schema(STATE)))
        if state:
            tables.drop(state)
        state = now
        if scans is not None:
            scans.append(spark.table(state).agg(F.sum("scanned")).first()[0])
        if done == rounds:
            break
        moved = spark.table(state).select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.total").alias("i", "part"))
        moved = moved.groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n")).collect()
        for r in moved:
            total[r.cluster][r.i] += int(r.part)
            if r.i == 0:
                count[r.cluster] += r.n
        if not moved:
            break
        new = np.array([[s // n for s in sums] if n else old.tolist() for sums, n, old in zip(total, count, centroids, strict=True)], np.int64)
        drift, centroids = np.sqrt(np.square(new - centroids).sum(axis=1).astype(np.float64)), new

    last = vectors_.join(spark.table(state).select("block", F.col("cluster")).hint("merge"), "block").select("ids", "x", "cluster")
    placed = materialise(last.mapInArrow(_finisher(centroids), schema("vec_id long, cluster int, distance long")), "clusters")
    for name in (state, blocks):
        tables.drop(name)
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = sum(inertia.values())
    if every >= 2**63:
        raise ValueError(f"the inertia {every} does not fit a long")
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    groups = F.broadcast(spark.createDataFrame([(c, s, every, digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return placed.join(groups, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"d{r} AS (SELECT row, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{r}),"
            f" a{r} AS MATERIALIZED (SELECT row, min(c) AS c, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY row) AS least FROM d{r}) WHERE d = least GROUP BY row)"
        )
        if r < rounds:
            parts.append(
                f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a{r}.c, unnest(v.x) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{r} USING (row)) GROUP BY c, i),"
                f" m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c),"
                f" c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (row) JOIN c{rounds} USING (c)"
    )


ORACLE_OP11 = _oracle()
