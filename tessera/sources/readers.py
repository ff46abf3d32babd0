"""Readers of the domain's files. Schemas are fixed: no file is read twice to guess them."""

from __future__ import annotations

import json
import re
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VCF = "CHR string, POS long, ID string, REF string, ALT string, QUAL string, FILTER string, INFO string"


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, snp_dir, spaceranger_dir) of a tab-separated sheet with a header."""
    return spark.read.csv(path, sep="\t", header=True).select("sample_id", "snp_dir", "spaceranger_dir")


def split_barcode(label):
    """(barcode, sample): what is before the first and after the last underscore."""
    parts = F.split(label, "_")
    return F.element_at(parts, 1).alias("barcode"), F.element_at(parts, -1).alias("sample")


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(label, barcode, sample) of a list of ``barcode_sample`` lines."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.trim("value").alias("label"), *split_barcode(F.trim("value")))


def positions(spark: SparkSession, folder: str, in_tissue: bool = True) -> DataFrame:
    """(barcode, in_tissue, x, y, pixel_row, pixel_col) of either file layout; an error where neither is there."""
    from pyspark.errors import AnalysisException

    names = "barcode string, in_tissue int, x int, y int, pixel_row double, pixel_col double"
    for name, header in (("tissue_positions.csv", True), ("tissue_positions_list.csv", False)):
        try:
            rows = spark.read.schema(names).csv(f"{folder}/{name}", header=header, enforceSchema=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        return rows.where("in_tissue = 1") if in_tissue else rows
    raise FileNotFoundError(f"no tissue positions in {folder}")


def count_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample, barcode, gene, umi) in long Parquet form; NaN and null count as 0 and go.

    This stands for binary count matrices, which need a library that isn't here.
    """
    rows = spark.read.parquet(path)
    return rows.withColumn("umi", F.coalesce(F.nanvl(F.col("umi").cast("double"), F.lit(0.0)), F.lit(0.0)).cast("long")).where("umi != 0")


def _sparse(batches):
    """Entries of compressed sparse row (or column) files, one file a row of (path, content)."""
    import io

    import numpy as np
    import pandas as pd

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                kind, major = z["format"].item(), np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                kind = kind.decode() if isinstance(kind, bytes) else kind
                row, col = (major, z["indices"]) if kind == "csr" else (z["indices"], major)
                for k in range(0, len(row), 1 << 20):
                    part = slice(k, k + (1 << 20))
                    yield pd.DataFrame({"file": path, "row": row[part].astype("int64"), "col": col[part].astype("int64"), "value": z["data"][part].astype("float64")})


def _dense(batches):
    """Entries of array files of one or two dimensions; texts as they are, numbers that are zero left out."""
    import io

    import numpy as np
    import pandas as pd

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            x = np.load(io.BytesIO(content), allow_pickle=False)
            x = x.reshape(len(x), -1)
            text = x.dtype.kind in "US"
            row, col = (np.indices(x.shape).reshape(2, -1)) if text else np.nonzero(x)
            held = x[row, col]
            yield pd.DataFrame({"file": path, "row": row.astype("int64"), "col": col.astype("int64"), "value": np.zeros(len(row)) if text else held.astype("float64"), "text": held.astype(str) if text else None})


def sparse_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, value) of ``.npz`` files of sparse allele counts (a glob); each file is read by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_sparse, "file string, row long, col long, value double")


def dense_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, value, text) of ``.npy`` files such as SNP ids and slice alignments (a glob)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_dense, "file string, row long, col long, value double, text string")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a coordinate file, indices from 0.

    The line with the dimensions follows the comments; it is the only one of three whole numbers
    that stands first, and is told by its place in the file's first block.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = lines.head(1)
    cut = F.split(F.trim("value"), r"\s+")
    rows = lines.select((cut[0].cast("long") - 1).alias("row"), (cut[1].cast("long") - 1).alias("col"), cut[2].cast("double").alias("value"), F.col("value").alias("line"))
    if not first:
        return rows.drop("line")
    n_rows, n_cols, n = re.split(r"\s+", first[0][0].strip())[:3]
    # An entry equal to the dimensions line would be the matrix's last corner with the count of entries as its value.
    head = (F.col("line") == first[0][0]) & (F.col("row") == int(n_rows) - 1) & (F.col("col") == int(n_cols) - 1) & (F.col("value") == float(n))
    return rows.where(~head).drop("line")


def vcf(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Rows of VCF files (a glob, plain or gzipped); with ``extra`` further columns such as ``FORMAT string, PHASE string``."""
    return spark.read.schema(VCF + (", " + extra if extra else "")).csv(path, sep="\t", comment="#")


def phased_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(snp_id, gt, …) of phased files; of rows with one id the last one in the files' order counts."""
    rows = vcf(spark, path, "FORMAT string, PHASE string").withColumn("_at", F.monotonically_increasing_id())
    ids = rows.withColumn("snp_id", F.concat_ws("_", "CHR", "POS", "REF", "ALT"))
    return ids.groupBy("snp_id").agg(F.max_by("PHASE", "_at").alias("gt"))


def haplotype_counts(sites: DataFrame, ad: DataFrame, dp: DataFrame, samples: DataFrame, phase: DataFrame) -> DataFrame:
    """(snp_id, barcode, a, b): reads of both haplotypes.

    ``sites``: (row, snp_id); ``ad`` and ``dp``: (row, col, value); ``samples``: (col, barcode);
    ``phase``: (snp_id, gt). Sites without a phase go.
    """
    from ..functions.columns import phased_count

    both = dp.withColumnRenamed("value", "dp").join(ad.withColumnRenamed("value", "ad"), ["row", "col"], "left").fillna(0, ["ad"])
    rows = both.join(sites, "row").join(phase, "snp_id").join(samples, "col")
    b = phased_count(F.col("gt"), F.col("ad"), F.col("dp")).cast("long")
    return rows.select("snp_id", "barcode", (F.col("dp").cast("long") - b).alias("a"), b.alias("b"))


def genes(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, gene) on chromosomes 1 to 22 of a gene table."""
    rows = spark.read.csv(path, sep="\t", header=True)
    held = rows.where(F.col("chrom").isin(*(f"chr{k}" for k in range(1, 23))))
    return held.select(F.regexp_replace("chrom", "^chr", "").cast("int").alias("chr"), F.col("cdsStart").cast("long").alias("start"), F.col("cdsEnd").cast("long").alias("end"), F.col("name2").alias("gene")).orderBy("chr", "start", "end", "gene")


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, cm), chromosomes as numbers (so that they sort as such)."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.regexp_replace("chrom", "^chr", "").try_cast("int").alias("chr"), F.col("pos").cast("long").alias("pos"), F.col("pos_cm").cast("double").alias("cm")).where("chr is not null").orderBy("chr", "pos")


def filter_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene): one a line."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene != ''")


def filter_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end) without the chr prefix."""
    rows = spark.read.schema("c string, start long, end long").csv(path, sep="\t")
    return rows.select(F.regexp_replace("c", "^chr", "").alias("chr"), "start", "end").orderBy("chr", "start", "end")


def alignment(spark: SparkSession, path: str, first: int, second: int) -> DataFrame:
    """(src, dst, value) of a dense slice alignment of ``first`` by ``second`` spots, from an array file or a long Parquet table; spots of the second slice follow those of the first."""
    rows = dense_arrays(spark, path) if path.endswith(".npy") else spark.read.parquet(path)
    return rows.select(F.col("row").alias("src"), (F.col("col") + first).alias("dst"), "value").where((F.col("src") < first) & (F.col("dst") < first + second))


def commented_table(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) tab-separated file whose first line names its columns after a ``#``."""
    head = spark.read.text(path).where(F.col("value").startswith("#")).head(1)
    names = re.split(r"\s+", head[0][0].lstrip("#").strip()) if head else []
    return spark.read.csv(path, sep="\t", comment="#").toDF(*names)


def config(path: str) -> SimpleNamespace:
    """A YAML or JSON file as nested attributes; the text ``none`` is None, JSON lines that start with // are comments."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads("\n".join(x for x in text.split("\n") if not x.lstrip().startswith("//")))
    else:
        import yaml

        data = yaml.safe_load(text)

    def nest(v):
        if isinstance(v, dict):
            return SimpleNamespace(**{k: nest(x) for k, x in v.items()})
        return None if isinstance(v, str) and v.lower() == "none" else v

    return nest(data)
