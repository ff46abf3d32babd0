"""Tables between the steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder (``spark.checkpoint.dir``): plans stay short and lost executors lose nothing.

    Without such a folder a temporary one stands in where Spark runs in one process; on a cluster
    that is an error.
    """
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again, so that its size is that of its files.

    What ``keep`` gives bears the estimate of the plan behind it, a product over all its joins: where
    each round joins what the round before left, that number's length grows as a power of the rounds.
    """
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
