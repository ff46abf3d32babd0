"""Quality scores from random-indexing word vectors and a two-layer network (operator 7).

Every word (or run of signs) has a sparse random index vector; its word vector is the sum of the
index vectors of its neighbours over all documents, gathered per task and summed by Spark. Words
share ``BUCKETS`` hash buckets, so the table has one size for any corpus. A document pools its
word vectors: their mean, spread and products of neighbours. A two-layer numpy network is fitted
on a bounded sample of labelled documents and its probabilities are calibrated by a temperature
on rows that it wasn't fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, schema, small_batches, table
from .labelled import fold_of, labelled_sample

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
HIDDEN, EPOCHS = 48, 60
#: Words of a text that are pooled at once.
BLOCK = 4096
KNOWN_WORDS = 500_000
VECTORS = "bucket int, n long, vector binary"
_WORD = re.compile(r"\w+|[^\w\s]+")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


_BUCKET = _Buckets()


def words(text: str | None) -> np.ndarray:
    """Bucket of each word of the text."""
    found = _WORD.findall(text or "")
    return np.fromiter(map(_BUCKET.__getitem__, found), np.int32, len(found))


def index_vectors() -> np.ndarray:
    """The sparse random vector of each bucket: ``NONZERO`` entries of 1 or -1."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] = rng.choice([-1.0, 1.0], BUCKETS)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of a task's documents."""
    index = index_vectors()
    total, count = np.zeros((BUCKETS, DIM), np.float64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(1).to_pylist():
            ids = words(text)
            for a in range(0, len(ids), 1 << 16):
                lo, hi = max(0, a - WINDOW), min(len(ids), a + (1 << 16) + WINDOW)
                own = ids[a : a + (1 << 16)]
                near = index[ids[lo:hi]]
                context = np.zeros((len(own), DIM), np.float32)
                for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                    x, y = max(lo, a + step), min(hi, a + step + len(own))
                    context[x - a - step : y - a - step] += near[x - lo : y - lo]
                order = np.argsort(own, kind="stable")
                kinds, first = np.unique(own[order], return_index=True)
                total[kinds] += np.add.reduceat(context[order], first, axis=0)
                count += np.bincount(own, minlength=BUCKETS)
    yield from _vector_rows(total, count)


def _vector_rows(total: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    met = np.flatnonzero(count)
    if len(met):
        rows = [x.tobytes() for x in total[met].astype("<f8")]
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(rows, pa.binary())], ["bucket", "n", "vector"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, count = np.zeros((BUCKETS, DIM), np.float64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if batch.num_rows:
            at = batch.column(0).to_numpy()
            np.add.at(total, at, np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, DIM))
            np.add.at(count, at, batch.column(1).to_numpy())
    yield from _vector_rows(total, count)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, weights) of all buckets, from all documents.

    Tasks emit a row per bucket at most; these are summed bucket by bucket in Spark. The driver
    gets the finished table, whose size is fixed by ``BUCKETS`` and ``DIM``.
    """
    parts = id_text(docs).mapInArrow(_gather, schema(VECTORS))
    summed = parts.repartition("bucket").mapInArrow(_add_up, schema(VECTORS)).collect()
    total, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for r in summed:
        total[r.bucket], count[r.bucket] = np.frombuffer(r.vector, "<f8"), r.n
    seen = count > 0
    share = count / max(1, count.sum())
    total[seen] /= count[seen, None]
    if seen.any():
        total[seen] -= share[seen] @ total[seen]  # what all words share says nothing
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    unit = np.where(norm > 0, total / np.where(norm > 0, norm, 1), 0)
    return unit.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pool(text: str | None, unit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean, spread and neighbour products of a text's word vectors, plain and weighted by rarity."""
    ids = words(text)
    if not len(ids):
        return np.zeros(4 * DIM + 2, np.float32)
    n, sums, total = len(ids), np.zeros((4, DIM)), 0.0
    for k in range(0, n, BLOCK):  # a long text's vectors are never all at hand
        v, w = unit[ids[k : k + BLOCK + 1]], weight[ids[k : k + BLOCK], None]
        own = v[:BLOCK]
        sums += own.sum(axis=0), np.einsum("ij,ij->j", own, own), np.einsum("ij,ij->j", v[1:], v[:-1]), (own * w).sum(axis=0)
        total += w.sum()
    mean = sums[0] / n
    spread = np.sqrt(np.maximum(sums[1] / n - mean * mean, 0))
    return np.concatenate([mean, spread, sums[2] / max(1, n - 1) * 4, sums[3] / total, [np.log1p(n) / 10, len(np.unique(ids)) / n]]).astype(np.float32)


def _pooler(tables):
    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, weight = tables.value
        for batch in batches:
            rows = [pool(t, unit, weight).astype("<f4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    return pooled


class Network:
    """Two layers, tanh between them, one probability out; calibrated by a temperature."""

    def __init__(self, inputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shift, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.w = [rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.shift) / self.scale @ self.w[0] + self.w[1])
        return hidden @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Network":
        """Adam on four fifths of the rows, the temperature on the rest."""
        rng = np.random.default_rng(seed)
        rest = np.arange(len(x)) % 5 == 4
        if not len(x) or y[~rest].min(initial=1) == y[~rest].max(initial=0):  # one class or none: its share, smoothed
            share = (y.sum() + 1) / (len(y) + 2)
            self.w = [np.zeros_like(w) for w in self.w]
            self.w[3][:] = np.log(share / (1 - share))
            return self
        a, b = x[~rest], y[~rest].astype(float)
        self.shift, self.scale = a.mean(axis=0), a.std(axis=0) + 1e-3
        z = (a - self.shift) / self.scale
        m, v = ([np.zeros_like(w) for w in self.w] for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(z))
            rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
            for k in range(0, len(z), 128):
                i = order[k : k + 128]
                hidden = np.tanh(z[i] @ self.w[0] + self.w[1])
                out = 1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30)))
                err = (out - b[i]) / len(i)
                back = np.outer(err, self.w[2]) * (1 - hidden**2)
                grads = [z[i].T @ back + 1e-3 * self.w[0], back.sum(axis=0), hidden.T @ err + 1e-3 * self.w[2], err.sum(keepdims=True)]
                step += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        if rest.any():
            logit, truth = self.logits(x[rest]), y[rest]
            loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).sum()
            self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
        return self


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, weight, network = model.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack([pool(t, unit, weight) for t in batch.column(1).to_pylist()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(x))], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``: how likely ``labels.quality`` is 1.

    Two passes over all texts, one for word vectors and one for scores, and one over the labelled
    sample. Null texts score as empty ones, texts of any length are pooled whole, block by block,
    and rows that repeat or share an id score each; without labels every score is one half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    unit, weight = word_vectors(docs)
    tables = spark.sparkContext.broadcast((unit, weight))  # fixed size
    sample = labelled_sample(docs, labels, "quality", folds, held_out).select("doc_id", "label", "text")
    rows = sorted(tuple(r) for r in sample.mapInArrow(_pooler(tables), schema("doc_id long, label int, features binary")).collect())
    x = np.stack([np.frombuffer(r[2], "<f4") for r in rows]).astype(np.float64) if rows else np.zeros((0, 4 * DIM + 2))
    network = Network(x.shape[1]).fit(x, np.array([r[1] for r in rows], np.int64))
    model = spark.sparkContext.broadcast((unit, weight, network))
    return id_text(docs).mapInArrow(_scorer(model), schema("doc_id long, score double"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
