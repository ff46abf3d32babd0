"""A training corpus from ``documents``: five stages, each the next one's input.

Toxic documents go, one document of each near-duplicate group stays, benchmark passages are cut
out, secrets are masked, and what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.secrets import redact
from tessera.llm.toxicity import drop_toxic

#: Document scores from which on the toxicity stage rejects.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC``, repeated rows as often as they come; null texts stay, and without labels the given lexicon decides."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, 0.8).

    A group is a component of links, so a near copy under 0.8 of every other text stays. Documents
    without words and those with a null id stay. Rows that share a kept id are one document, and
    all stay.
    """
    found = near_duplicates(docs)
    keep = found.where((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go. Null texts and repeated rows stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked, through a ledger in the shared folder. Null texts and repeated rows stay."""
    return redact(docs, new_path(spark, "ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; a null or empty text is one piece of its end id."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: Trained models, components and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
