"""Toxicity by weak supervision (operator 10).

Many voters call a text toxic, clean, or abstain: words and word beginnings of a lexicon, some
given and the rest mined from labelled rows, and patterns such as how many lexicon words occur and
how dense they are. A generative label model holds each voter's chances of its three votes in
toxic and clean texts (its accuracy) and, along a tree of the most dependent pairs within the
classes, how they depend on another voter's vote (their correlations), so that voters which repeat
each other count once. It is fitted by expectation maximisation; the given labels are one more
voter, whose accuracy is estimated too. A linear classifier is trained on the posterior labels
and scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, schema, small_batches, table
from .labelled import fold_of, labelled_sample

#: Insults that the lexicon starts from.
INSULTS = ("idiot", "moron", "stupid", "trash", "worthless", "disgusting", "pathetic", "loser", "clown", "scum", "dumb", "garbage", "imbecile")
#: Lengths in bytes of word beginnings that may become voters, and how many voters are mined.
STEMS, MINED = (5, 6, 7, 8), 256
KNOWN_WORDS = 500_000
#: ASCII signs and digits to spaces; texts come in lower case.
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _marks(word: bytes) -> list[bytes]:
    """What a word can fire: itself, and its beginnings (with a star)."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


def _count_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bytes, list[int]] = {}
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for mark in {m for w in set(words(text)) for m in _marks(w)}:
                found.setdefault(mark, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["mark", "clean", "toxic"])


def mine_marks(sample: DataFrame) -> list[bytes]:
    """The marks of ``sample(doc_id, label, text)`` that speak most clearly for toxic texts."""
    n = {r[0]: r[1] for r in sample.groupBy("label").agg(F.count(F.lit(1))).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    counts = sample.select("doc_id", "label", "text").mapInArrow(_count_marks, schema("mark binary, clean long, toxic long")).groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    strength = odds * F.sqrt(F.col("toxic").cast("double"))
    top = counts.where((F.col("toxic") >= max(4, 0.01 * toxic)) & (odds > 1.5)).select("mark", strength.alias("s")).orderBy(F.desc("s"), "mark").limit(MINED)
    return [bytes(r.mark) for r in top.collect()]


class Voters:
    """Firing of all voters on a text."""

    def __init__(self, mined: list[bytes]):
        given = [w.encode() for w in INSULTS]
        self.marks = [*given, *(m for m in mined if m not in given)]
        self.at = {m: k for k, m in enumerate(self.marks)}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.size = len(self.marks) + 9

    def votes(self, fired: np.ndarray) -> np.ndarray:
        """Votes of rows of fired marks: 1 toxic, -1 clean (no mark at all; marks that are sparse), 0 abstains."""
        out = (fired > 0).astype(np.int8)
        n = len(self.marks)
        out[:, n] = np.where(fired[:, n] > 0, 1, -1)
        out[:, n + 6] = np.where(fired[:, n + 6] > 0, 1, np.where(fired[:, n] > 0, 0, -1))
        return out

    def plain_weights(self) -> np.ndarray:
        """Weights where nothing is known but the given lexicon: texts without its words score 0.05."""
        w = np.zeros(self.size + 1)
        w[: len(INSULTS)], w[-1] = 1.5, np.log(0.05 / 0.95)
        return w

    def of_word(self, word: bytes) -> tuple[int, ...]:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            hit = self.known[word] = tuple(self.at[m] for m in _marks(word) if m in self.at)
        return hit

    def fire(self, text: str | None) -> np.ndarray:
        """1 where a voter fires."""
        out = np.zeros(self.size, np.float32)
        found = words(text)
        fired, given = 0, 0
        total = 0
        of = self.of_word
        for w in set(found):
            if hit := of(w):
                out[list(hit)] = 1
                fired += 1
                given += hit[0] < len(INSULTS)
        if fired:
            total = sum(1 for w in found if self.known.get(w))
        n = len(self.marks)
        out[n : n + 3] = fired >= 1, fired >= 2, fired >= 4
        out[n + 3 : n + 5] = given >= 1, given >= 2
        dense = total / max(1, len(found))
        out[n + 5 : n + 9] = dense >= 0.003, dense >= 0.01, dense >= 0.03, dense >= 0.08
        return out


def _firer(voters):
    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(voters.value.fire(t) > 0).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "votes"])

    return fire


class LabelModel:
    """Accuracies and correlations of voters (votes -1, 0, 1), by expectation maximisation.

    ``gold``: given labels (0 or 1), or None to go by the voters alone. ``posterior``: how likely
    each text is toxic; ``accuracy``: how often a voter is right where it doesn't abstain;
    ``parent``: the voter on which each depends (-1: none), with the strength in ``tie``.
    """

    #: Rows that the priors weigh: of a voter's chances, of its chances given another's vote, of the labels' accuracy.
    WEIGHT, TIED, GOLD = 2.0, 5.0, 50.0

    def __init__(self, votes: np.ndarray, gold: np.ndarray | None, rounds: int = 20):
        n, m = votes.shape
        self.accuracy, self.parent, self.tie = np.full(m, 0.5), np.full(m, -1), np.zeros(m)
        self.posterior = np.zeros(n)
        if not n:
            return
        state = votes.astype(np.int64) + 1
        base = np.stack([np.bincount(state[:, j], minlength=3) for j in range(m)]) / n
        self.posterior = post = np.where(votes.sum(axis=1) > 0, 0.9, 0.05) if gold is None else np.where(gold == 1, 0.9, 0.05)
        for r in range(rounds):
            share = (post.sum() + 1) / (n + 10)
            both = np.stack([1 - post, post])
            chance = np.stack([[np.bincount(state[:, j], w, 3) for j in range(m)] for w in both])
            chance = (chance + self.WEIGHT * base) / (both.sum(axis=1)[:, None, None] + self.WEIGHT)
            chance = np.maximum(chance, 1e-6)
            if r in (0, rounds // 2):
                self._ties(votes > 0, post)
            odds = np.full(n, np.log(share / (1 - share)))
            for j in range(m):
                if (k := self.parent[j]) < 0:
                    odds += np.log(chance[1, j] / chance[0, j])[state[:, j]]
                    continue
                cell = state[:, k] * 3 + state[:, j]
                met = np.stack([np.bincount(cell, w, 9).reshape(3, 3) for w in both])
                given = (met + self.TIED * chance[:, j, None]) / (met.sum(axis=2, keepdims=True) + self.TIED)
                odds += np.log(given[1] / given[0]).ravel()[cell]
            if gold is not None:
                hit = [(w @ gold + self.GOLD * prior) / (w.sum() + self.GOLD) for w, prior in zip(both, (0.02, 0.95), strict=True)]
                odds += np.where(gold == 1, np.log(hit[1] / hit[0]), np.log((1 - hit[1]) / (1 - hit[0])))
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        right = chance[1, :, 2] * share + chance[0, :, 0] * (1 - share)
        self.accuracy = right / (right + chance[0, :, 2] * (1 - share) + chance[1, :, 0] * share)
        self.posterior = post

    def _ties(self, fired: np.ndarray, post: np.ndarray) -> None:
        """The forest of voters with the largest mutual information within the classes."""
        n, m = fired.shape
        x = fired.astype(np.float32)
        info = np.zeros((m, m))
        for w in (1 - post, post):
            total = w.sum() + 1e-9
            on = (w @ x) / total
            pair = (x * w[:, None].astype(np.float32)).T @ x / total
            cells = ((pair, on[:, None], on[None]), (on[:, None] - pair, on[:, None], 1 - on[None]), (on[None] - pair, 1 - on[:, None], on[None]), (1 - on[:, None] - on[None] + pair, 1 - on[:, None], 1 - on[None]))
            for p, a, b in cells:
                p = np.maximum(p, 1e-12)
                info += total / n * p * np.log(p / np.maximum(a * b, 1e-12))
        np.fill_diagonal(info, 0)
        best, parent, done = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, bool)
        for _ in range(m):
            j = int(np.argmax(np.where(done, -np.inf, np.maximum(best, 0))))
            done[j] = True
            closer = ~done & (info[j] > best)
            best[closer], parent[closer] = info[j][closer], j
        firm = 2 * n * best > 30  # far beyond chance for a pair
        self.parent, self.tie = np.where(firm, parent, -1), np.where(firm, best, 0.0)


def fit_linear(votes: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([votes, np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = model.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack([voters.fire(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))], ["doc_id", "score"])

    return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, gold: bool = True) -> tuple[Voters, np.ndarray]:
    """(voters, linear weights), learnt from a bounded sample of labelled documents.

    Without ``gold`` the labels serve to mine the lexicon only, and the voters alone label the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = materialise(labelled_sample(docs, labels, "toxic", folds, held_out).select("doc_id", "label", "text"), "sample")
    voters = Voters(mine_marks(sample))
    shared = spark.sparkContext.broadcast(voters)
    rows = sorted(tuple(r) for r in sample.mapInArrow(_firer(shared), schema("doc_id long, label int, votes binary")).collect())
    if not rows:
        return voters, voters.plain_weights()
    fired = np.stack([np.unpackbits(np.frombuffer(r[2], np.uint8))[: voters.size] for r in rows]).astype(np.float64)
    labels_ = np.array([r[1] for r in rows], np.float64)
    return voters, fit_linear(fired, LabelModel(voters.votes(fired), labels_ if gold else None).posterior)


def score_toxicity(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``: how likely ``labels.toxic`` is 1.

    One pass over all texts and three over the sample. Null texts score as empty ones, texts of
    any length are read whole, and rows that repeat or share an id score each; without labels the
    given lexicon alone decides, and texts without its words score 0.05.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **fit))
    return id_text(docs).mapInArrow(_scorer(model), schema("doc_id long, score double"))


def _filterer(model, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = model.value
        for batch in batches:
            if batch.num_rows:
                text = batch.column("text")
                x = np.stack([voters.fire(t) for t in text.to_pylist()])
                clean = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) < threshold
                yield batch.filter(pa.array(clean | text.is_null().to_numpy(zero_copy_only=False)))

    return keep


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """``docs`` (all its columns) without the rows that score ``threshold`` or more; null texts stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **fit))
    return docs.mapInArrow(_filterer(model, threshold), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
