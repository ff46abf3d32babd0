"""Writers of the domain's tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_vcf(sites: DataFrame, path: str) -> None:
    """One folder per chromosome of ``sites(CHR, POS, ID, REF, ALT, QUAL, FILTER, INFO, FORMAT, GT)``, sorted by position.

    Each chromosome is one file: header lines and rows are lines of one sorted task.
    """
    # The format's header lines and column names.
    cols = ["CHR", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "GT"]
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols))
    rows = sites.select("CHR", F.col("POS").cast("long").alias("_pos"), line.alias("value"))
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"])
    head = sites.select("CHR").distinct().select("CHR", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("_pos"), F.lit("##fileformat=VCFv4.2").alias("value")), F.struct(F.lit(-1).cast("long").alias("_pos"), F.lit(names).alias("value")))).alias("h")).select("CHR", "h._pos", "h.value")
    rows.unionByName(head).repartition("CHR").sortWithinPartitions("CHR", "_pos").select("CHR", "value").write.partitionBy("CHR").mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Counts, labels and copy-number tables as Parquet."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_commented(df: DataFrame, path: str) -> None:
    """Gzipped tab-separated files, the names in a first line after a ``#`` (one per part)."""
    # With another sign for comments the ``#`` isn't quoted.
    first, *rest = df.columns
    df.withColumnRenamed(first, f"#{first}").write.mode("overwrite").option("comment", "\x01").csv(path, sep="\t", header=True, compression="gzip")


def append_metrics(spark, path: str, rows: list[tuple], schema: str = "model string, size long, states int, start string, runtime double, rounds int, llf double") -> None:
    """Telemetry of fits, appended to a table."""
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def write_clone_labels(labels: DataFrame, spots: DataFrame, path: str) -> None:
    """Tab-separated (barcode, x, y, [tumor_proportion], clone_label) of every spot, as many files as partitions."""
    more = [F.col("tumour").alias("tumor_proportion")] if "tumour" in spots.columns else []
    rows = spots.join(labels.select("spot", F.col("label").alias("clone_label")), "spot", "left")
    rows.select(F.col("spot").alias("barcode"), "x", "y", *more, "clone_label").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_copies(folder: str, *, segments: DataFrame, genes: DataFrame, states: DataFrame, labels: DataFrame, spots: DataFrame) -> None:
    """The tables of a finished inference: copies of segments, genes and states, and labels of spots."""
    for name, df in (("cnv_seglevel", segments), ("cnv_genelevel", genes), ("cnv_perstate", states)):
        df.write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True)
    write_clone_labels(labels, spots, f"{folder}/clone_labels")
