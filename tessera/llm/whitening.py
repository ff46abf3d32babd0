"""Whitening of embeddings by a compensated covariance (operator 13).

Entries are integers, so a centred vector, scaled by the number of fitted vectors, is one too:
y = n * x - S. A block's outer products are summed by matrix products of 21-bit slices of y, each of
which is exact (an error-free transformation of the product), and added to a pair of doubles, high
and low, by error-free additions. Tasks hand on both parts, which are merged in double-double too.
The eigen-solve is LAPACK's ``syevd``: Householder reduction to tridiagonal form, then divide and
conquer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, schema, table

#: Bits of a slice, slices of a 63-bit integer, rows of a block: 2 * 21 + 11 bits fit a double's 53.
SLICE, SLICES, BLOCK = 21, 3, 2048
#: Entries stay below this, so that sums of a block can't pass 64 bits.
MOST = 2**51
#: Eigenvalues up to this share of the largest are rounding: such directions hold nothing to whiten.
FLAT = 1e-12


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and exactly what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double numbers."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(rest, low.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def outer_sum(y: np.ndarray) -> Iterator[np.ndarray]:
    """Exact parts whose sum is the sum of the rows' outer products; at most ``BLOCK`` rows."""
    sign, left = np.sign(y), np.abs(y)
    parts = [(sign * ((left >> (SLICE * k)) & (2**SLICE - 1))).astype(np.float64) for k in range(SLICES)]
    for i in range(SLICES):
        for j in range(i, SLICES):
            if parts[i].any() and parts[j].any():
                product = np.ldexp(parts[i].T @ parts[j], SLICE * (i + j))
                yield product
                if i != j:
                    yield product.T


def _ints(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of one vector length each, ``BLOCK`` rows at most."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column(at)])
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            for lo in range(0, part.num_rows, BLOCK):
                yield int(dim), part.slice(lo, BLOCK)


def _summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and entry sums of a task, by vector length."""
    held: dict[int, list] = {}
    for dim, part in _by_length(batches):
        n, sums = held.get(dim, (0, [0] * dim))
        x = _ints(part.column(0))
        if np.abs(x).max() >= MOST:
            raise ValueError(f"an entry exceeds {MOST}: n * x - S would not fit 64 bits")
        held[dim] = (n + part.num_rows, [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)])
    for dim, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n]), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["dim", "n", "sums"])


class Centre:
    """Number and entry sums of the fitted vectors of one length."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, np.array(sums, dtype=object)
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: the whole part of the mean goes first, so that the product stays small."""
        off = x - self.base
        if len(off) and (int(np.abs(off).max()) + 1) * self.n >= 2**63:
            raise ValueError("n * x - S does not fit 64 bits")
        return off * self.n - self.rest


def _accumulator(centres: dict[int, Centre], project=None):
    """Double-double sums of outer products of a task, one record for each row of the matrix.

    Of centred integers, or of what ``project`` makes of them (``dim``, integers -> doubles); the
    latter's products are split exactly into rounded product and error first.
    """

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for dim, part in _by_length(batches):
            y = centres[dim](_ints(part.column(0)))
            products = outer_sum(y) if project is None else outer_double(project(dim, y))
            for product in products:
                high, low = held.get(dim) or (np.zeros_like(product), np.zeros_like(product))
                held[dim] = add(high, low, product)
        for dim, (high, low) in held.items():
            yield _records([dim] * len(high), range(len(high)), high, low)

    return accumulate


def outer_double(z: np.ndarray) -> Iterator[np.ndarray]:
    """Sum of the rows' outer products of doubles, in exact slices relative to the largest entry."""
    top = np.abs(z).max(initial=0)
    if top:
        unit = 2.0 ** (math.frexp(top)[1] - SLICE * SLICES + 1)
        whole = np.rint(z / unit).astype(np.int64)
        for product in outer_sum(whole):
            yield product * unit**2


def _records(dims, rows, high, low) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip((dims, rows, [list(h) for h in high], [list(x) for x in low]), kinds, strict=True)], ["dim", "i", "high", "low"])


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the tasks merged, high and low parts alike; all of a matrix row come to one task."""
    held: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            key, more = (r["dim"], r["i"]), (np.array(r["high"]), np.array(r["low"]))
            held[key] = add(*held[key], *more) if key in held else more
    if held:
        yield _records([d for d, _ in held], [i for _, i in held], [h for h, _ in held.values()], [x for _, x in held.values()])


def _matrices(fit: DataFrame, centres: dict[int, Centre], project=None) -> dict[int, np.ndarray]:
    """The summed matrix of each vector length, as double-double: shape (2, rows, columns)."""
    kind = schema("dim int, i int, high array<double>, low array<double>")
    n = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = fit.mapInArrow(_accumulator(centres, project), kind).repartition(n, "dim", "i").mapInArrow(_merger, kind).orderBy("dim", "i").collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(r.dim, []).append((r.high, r.low))
    return {dim: np.array(rows).transpose(1, 0, 2) for dim, rows in out.items()}


def components(matrix: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the double-double matrix over n**3."""
    scale = max(float(np.abs(matrix[0]).max()), 1.0)
    v = matrix[0] / scale + matrix[1] / scale
    unit = scale / float(n) ** 3
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > FLAT * max(values.max(), 0)][:most]
    high, low = np.zeros(1), np.zeros(1)
    for i in range(len(v)):
        high, low = add(high, low, matrix[0][i, i : i + 1], matrix[1][i, i : i + 1])
    return values[order] * unit, vectors[:, order], float(high[0] / scale + low[0] / scale) * unit


def _whitener(models: dict[int, tuple], most: int):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_length(batches, 1):
            centre, values, vectors, trace, error = models[dim]
            y = centre(_ints(part.column(1)))
            z, k = project_rows(y, centre.n, values, vectors), len(values)
            top = int(np.abs(y).max(initial=0))
            square = y if top * top * dim < 2**63 else y.astype(object)
            squared = np.repeat(np.array([str(s) for s in (square * square).sum(axis=1).tolist()], dtype=object), k)
            columns = [
                pa.array(np.repeat(np.array(part.column(0).to_pylist(), dtype=object), k).tolist(), pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array([centre.n] * (k * len(y)), pa.int64()), pa.array(squared.tolist(), pa.string()), pa.array(z.ravel()), pa.array(np.tile(values / trace, len(y))),
                pa.array([error] * (k * len(y)), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "squared", "whitened", "explained", "identity_error"])

    return whiten


def project_rows(y: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Centred integers over n on the components, each over the root of its eigenvalue."""
    return (y / n) @ vectors / np.sqrt(values)


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error), a row per vector and component.

    ``vectors(vec_id, embedding)``: rows whose vector is null, empty or holds null or non-finite
    entries are left out; the others come as often as they stand there, null ids included. The fit
    counts equal integer vectors once; vectors of each length are fitted on their own (a few
    lengths). Directions without spread (fewer distinct vectors than dimensions) have no component.
    Entries so large that n * x - S passes 64 bits are an error. Extra columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") > 0) & ~bad)
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(scale * c).cast("long") + shift).alias("x"))
    fit = materialise(rows.select("x").distinct(), "fit")

    sums = fit.mapInArrow(_summer, schema("dim int, n long, sums array<string>")).select("dim", "n", F.posexplode("sums").alias("i", "s"))
    sums = sums.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim", "i").collect()
    lengths: dict[int, list] = {}
    for r in sums:
        lengths.setdefault(r.dim, []).append(r)
    centres = {dim: Centre(rs[0].n, [int(r.s) for r in rs]) for dim, rs in lengths.items()}
    matrices = _matrices(fit, centres) if centres else {}
    solved = {dim: components(m, centres[dim].n, most) for dim, m in matrices.items()}
    solved = {dim: s for dim, s in solved.items() if len(s[0])}

    def project(dim: int, y: np.ndarray) -> np.ndarray:
        return project_rows(y, centres[dim].n, *solved[dim][:2]) if dim in solved else y[:, :0] / 1.0

    covered = _matrices(fit, centres, project) if solved else {}
    models = {}
    for dim, (values, axes, trace) in solved.items():
        spread = (covered[dim][0] + covered[dim][1]) / centres[dim].n
        models[dim] = (centres[dim], values, axes, trace, float(np.abs(spread - np.eye(len(values))).max()))
    kept = rows.where(F.size("x").isin(list(models)))
    made = kept.mapInArrow(_whitener(models, most), schema("vec_id long, component int, n long, squared string, whitened double, explained double, identity_error double"))
    return made.select("vec_id", "component", "n", F.col("squared").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened; a deviation beyond a long is null there and whole in ``deviation_decimal``."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation_decimal", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation_decimal AS bigint)"))
