"""From files to the tables of an inference: phased allele reads of a pile-up, and filtered counts of all slices."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import genome as G
from ..operators import hmrf as R
from ..operators.storage import keep
from ..sources import readers


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of text files with ``row``: each line's place among the lines read, from 0, files in order of their paths.

    A task numbers the lines of its blocks; blocks follow each other in their files' order. Only
    counts of blocks are sorted in one task.
    """
    tagged = keep(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
    blocks = tagged.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of 128 MB
    blocks = blocks.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = tagged.join(blocks, ["_file", "_block"]).withColumn("row", F.col("_first") + F.col("_id") - F.col("_least"))
    return placed.select(*rows.columns, "row")


def phased_files(spark: SparkSession, folder: str, chromosomes: Iterable[int] = range(1, 23)) -> dict[int, str]:
    """The phased file of each chromosome, the first by name; an error where one is missing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.phased.vcf.gz").load(folder).select("path")
    found: dict[int, str] = {}
    for path in sorted(r.path for r in listed.collect()):  # a file or a few for each chromosome
        named = re.search(r"chr(\d+)\.phased\.vcf\.gz$", path)
        if named:
            found.setdefault(int(named[1]), path)
    missing = [c for c in chromosomes if c not in found]
    if missing:
        raise FileNotFoundError(f"no phased file of chromosomes {missing} in {folder}")
    return {c: found[c] for c in chromosomes}


def phases(spark: SparkSession, files: dict[int, str]) -> DataFrame:
    """(snp_id, gt) of heterozygous sites. The file's name tells the chromosome; of repeated sites the last counts."""
    rows = readers.vcf(spark, list(files.values()), "FORMAT string, PHASE string")
    chr_ = F.regexp_extract(F.col("_metadata.file_path"), r"chr(\d+)\.phased\.vcf\.gz$", 1)
    rows = rows.select(F.concat_ws("_", chr_, "POS", "REF", "ALT").alias("snp_id"), F.col("PHASE").alias("gt"), F.monotonically_increasing_id().alias("_id"))
    return rows.where(F.col("gt").isin("0|1", "1|0")).groupBy("snp_id").agg(F.max_by("gt", "_id").alias("gt"))


def allele_matrices(spark: SparkSession, pileup: str, phased: str, barcodes: str, chromosomes: Iterable[int] = range(1, 23)) -> DataFrame:
    """(snp_id, label, a, b): reads of both haplotypes at phased sites, for the spots that the file ``barcodes`` lists.

    ``pileup`` holds a site file, a sample list and the matrices of alternative and all reads;
    ``phased`` a file for each chromosome. Sites without a heterozygous phase go, and so do entries
    without reads. Lines of the site file and of the sample list number the matrices' rows and columns.
    """
    sites = numbered(readers.vcf(spark, f"{pileup}/cellSNP.base*")).select("row", F.concat_ws("_", "CHR", "POS", "REF", "ALT").alias("snp_id"))
    lines = numbered(spark.read.text(f"{pileup}/cellSNP.samples.tsv"))
    samples = lines.select(F.col("row").alias("col"), F.trim(F.split("value", ",")[0]).alias("barcode"))
    wanted = readers.barcodes(spark, barcodes).select(F.col("label").alias("barcode")).distinct()
    ad, dp = (readers.matrix_market(spark, f"{pileup}/cellSNP.tag.{tag}.mtx") for tag in ("AD", "DP"))
    found = readers.haplotype_counts(sites, ad, dp, samples.join(wanted, "barcode", "left_semi"), phases(spark, phased_files(spark, phased, chromosomes)))
    return found.withColumnRenamed("barcode", "label").where("a != 0 or b != 0")


@dataclass(frozen=True)
class Inputs:
    """Spots (label, sample, x, y), counts (label, gene, umi) and alleles (snp_id, label, a, b) that passed all filters."""

    spots: DataFrame
    counts: DataFrame
    alleles: DataFrame


def load_inputs(spark: SparkSession, sheet: str, barcodes: str, alleles: DataFrame, *, genes: str | None = None, ranges: str | None = None, least: int = 50, share: float = 0.005, outliers: bool = True, counts: str = "counts.parquet") -> Inputs:
    """Counts, positions and allele reads of every slice of a sample sheet, joined on spots and filtered.

    A spot is a barcode and its slice; the list names slices by what follows the first dash of the
    sheet's name. ``alleles``: (snp_id, label, a, b), labels as in the list. Spots need a place in the
    tissue, a line in the list, and ``least`` reads of genes and of alleles; genes must show in
    ``share`` of the spots. ``genes`` and ``ranges`` are files of genes and of regions to leave
    out (regions of sites). With ``outliers``, genes whose totals are local outliers go.
    """
    slices = readers.sample_sheet(spark, sheet).collect()  # a row for each slice
    where, umis = [], []
    for s in slices:
        tag = F.lit(s.sample_id)
        where.append(readers.positions(spark, s.spaceranger_dir).select(F.concat_ws("_", "barcode", tag).alias("label"), tag.alias("sample"), "x", "y"))
        umis.append(readers.count_table(spark, f"{s.spaceranger_dir}/{counts}").select(F.concat_ws("_", "barcode", tag).alias("label"), "gene", "umi"))
    places, table = functools.reduce(DataFrame.unionByName, where), functools.reduce(DataFrame.unionByName, umis)
    full = F.create_map(*(F.lit(v) for s in slices for v in (s.sample_id.split("-", 2)[1], s.sample_id)))
    # The list's own labels, and those of the slices.
    named = readers.barcodes(spark, barcodes).select(F.col("label").alias("_old"), F.concat_ws("_", "barcode", F.try_element_at(full, F.col("sample"))).alias("label")).distinct()
    reads = alleles.withColumnRenamed("label", "_old").join(named, "_old").select("snp_id", "label", "a", "b")
    rows = keep(table.groupBy("label", "gene").agg(F.sum("umi").alias("umi")))
    spots = places.join(rows.select("label").distinct(), "label", "left_semi").join(named, "label", "left_semi")

    both = rows.select(F.col("label").alias("spot"), "umi", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(reads.select(F.col("label").alias("spot"), F.lit(0).cast("long").alias("umi"), "a", "b"))
    enough = A.keep_spots(both, least, least).select(F.col("spot").alias("label"))
    spots = keep(spots.join(enough, "label", "left_semi"))
    rows, reads = (df.join(spots, "label", "left_semi") for df in (rows, reads))

    shown = A.keep_genes(rows.select(F.col("label").alias("spot"), F.col("gene").alias("feature"), "umi"), share)
    if genes is not None:
        shown = shown.join(readers.filter_genes(spark, genes).distinct(), F.col("feature") == F.col("gene"), "left_anti")
    totals = shown.select(F.col("feature").alias("gene"), F.col("umi").alias("n"))
    if outliers:
        # Factors are keyed by numbers; a hash of the name decides nothing but the order of equal totals.
        numbered_genes = totals.select("gene", "n", F.xxhash64("gene").alias("feature"))
        factors = R.outlier_features(numbered_genes).where("not outlier").select("feature")
        totals = numbered_genes.join(factors, "feature", "left_semi")
    rows = rows.join(totals.select("gene"), "gene", "left_semi")
    if ranges is not None:
        cut = F.split("snp_id", "_")
        sites = reads.select("snp_id").distinct().select("snp_id", F.try_element_at(cut, F.lit(1)).try_cast("int").alias("chr"), F.try_element_at(cut, F.lit(2)).try_cast("long").alias("start"))
        regions = readers.filter_ranges(spark, ranges).select(F.col("chr").try_cast("int").alias("chr"), "start", "end")
        reads = reads.join(G.range_anti(sites, regions).select("snp_id"), "snp_id", "left_semi")
    return Inputs(spots, rows.select("label", "gene", "umi"), reads.select("snp_id", "label", "a", "b"))
