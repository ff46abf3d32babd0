"""Helpers that the training-data operators share: shared storage, Arrow maps, null handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows an Arrow batch may hold: texts can be long, so batches stay small.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent and Spark runs in one process (tests), a local temporary folder
    stands in; on a cluster, whose executors don't see such a folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts fit in a worker.

    Spark bounds a batch's bytes itself (``spark.sql.execution.arrow.maxBytesPerBatch``). Maps run
    after the operator has returned, so the setting stays in the session; smaller ones are kept.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty); other columns, whatever their names, go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def local_path(uri: str) -> str | None:
    """The mounted path behind a ``file:`` or plain path; None for other stores."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return parts.path
    return None


def open_store(uri: str):
    """The pyarrow filesystem and path of a shared folder, for tasks that write flat files."""
    from pyarrow import fs

    plain = local_path(uri)
    if plain is not None:
        os.makedirs(plain, exist_ok=True)
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(uri)


def schema(text: str) -> T.StructType:
    """A struct type from its DDL."""
    return T.StructType.fromDDL(text)
