"""Bounded samples of labelled documents, which the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Labelled rows that a classifier is fitted on at most: those with the lowest hashes of their ids.
SAMPLE_ROWS = 20_000


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds (null id: that of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents outside the held-out fold.

    Several labels of a document count as their rounded mean; null labels don't count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.where(fold_of(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_text(docs).join(F.broadcast(known), "doc_id")  # at most `rows` ids: a proven bound
