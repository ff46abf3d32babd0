"""What plots of a finished inference draw, as tables: tracks along the genome and maps of spots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import copy_colour
from .genome import run_length

#: Red, green and blue of the eight colours of clones, and of the grey of normal spots.
CLONE_COLOURS = [(102, 194, 165), (252, 141, 98), (141, 160, 203), (231, 138, 195), (166, 216, 84), (255, 217, 47), (229, 196, 148), (179, 179, 179)]
GREY = (211, 211, 211)
#: Columns between the slices of a map.
GAP = 10


def chromosome_marks(bins: DataFrame) -> DataFrame:
    """(chr, first, n, place) of ``bins(chr, bin)``, each once: a chromosome's first place, its bins, and where its name stands."""
    sizes = bins.groupBy("chr").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chromosome
    marks = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return marks.select("chr", "first", "n", (0.55 * F.col("first") + 0.45 * (F.col("first") + F.col("n"))).alias("place"))


def bin_places(bins: DataFrame) -> DataFrame:
    """(chr, bin, place): places of ``bins(chr, bin)`` on one axis from 0, chromosome after chromosome."""
    own = bins.select("chr", "bin", F.row_number().over(Window.partitionBy("chr").orderBy("bin")).alias("_i"))
    marks = chromosome_marks(bins).select("chr", "first")
    return own.join(F.broadcast(marks), "chr").select("chr", "bin", (F.col("first") + F.col("_i") - 1).alias("place"))


def clone_tracks(bulk: DataFrame, places: DataFrame, segments: DataFrame) -> DataFrame:
    """(clone, chr, bin, place, rdr, baf, state, major, minor, colour): a point for each bin of each clone that has allele reads.

    ``bulk``: (clone, chr, bin, umi, base, k, depth); ``segments``: (clone, bin, state, a, b). Ratios
    without reads to divide by are null, as are states, copies and colours of bins without a segment.
    """
    held = bulk.groupBy("clone").agg(F.sum("depth").alias("_n")).where("_n > 0").select("clone")
    rows = bulk.join(F.broadcast(held), "clone").join(places.select("chr", "bin", "place"), ["chr", "bin"])  # a row for each clone
    rows = rows.join(segments.select("clone", "bin", "state", "a", "b"), ["clone", "bin"], "left")
    zero = F.lit(0)
    rdr, baf = F.col("umi") / F.nullif("base", zero), F.col("k") / F.nullif("depth", zero)
    return rows.select("clone", "chr", "bin", "place", rdr.alias("rdr"), baf.alias("baf"), "state", F.greatest("a", "b").alias("major"), F.least("a", "b").alias("minor"), copy_colour(F.col("a"), F.col("b")).alias("colour"))


def clone_lines(paths: DataFrame, places: DataFrame, states: DataFrame) -> DataFrame:
    """(clone, state, first, end, rdr, baf, mirrored): stretches of one state, across chromosomes, at the state's means.

    ``paths``: (clone, bin, state); ``states``: (state, log_mu, p), few rows. ``end`` is the place after the last.
    """
    runs = run_length(paths.join(places.select("bin", "place"), "bin"), "state", ["clone"], "place")
    lines = runs.join(F.broadcast(states.select("state", "log_mu", "p")), "state")
    return lines.select("clone", "state", "first", (F.col("last") + 1).alias("end"), F.exp("log_mu").alias("rdr"), F.col("p").alias("baf"), (1 - F.col("p")).alias("mirrored"))


def spot_map(spots: DataFrame, labels: DataFrame) -> DataFrame:
    """(spot, px, py, label, legend, shade, colour) of ``spots(spot, sample, x, y[, tumour])`` with a label.

    Slices stand side by side, upside down. Clone 0 is grey, the others take the colours in the order
    of their names as texts (10 before 2), again from the first after the eighth. With ``tumour``
    a spot's colour is that far from grey; unknown proportions count as one half.
    """
    wide = spots.groupBy("sample").agg((F.max("x") + GAP).alias("_w"))
    before = Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    shift = wide.select("sample", F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_x"))
    known = labels.where("label is not null").select("spot", "label")
    names = Window.orderBy(F.col("label") != 0, F.col("label").cast("string"))
    legend = known.select("label").distinct().withColumn("legend", F.row_number().over(names) - 1)  # a row for each clone
    # Without a clone 0 the first name takes the first colour.
    normal = F.coalesce(F.max(F.col("label") == 0).over(Window.partitionBy()), F.lit(False)).cast("int")
    legend = legend.withColumn("_c", F.when(F.col("label") == 0, -1).otherwise(F.pmod(F.col("legend") - normal, F.lit(len(CLONE_COLOURS)))))
    shade = F.coalesce(F.nanvl(F.col("tumour").cast("double"), F.lit(0.5)), F.lit(0.5)) if "tumour" in spots.columns else F.lit(1.0)

    def part(i: int):
        full = F.when(F.col("_c") < 0, F.lit(GREY[i])).otherwise(F.element_at(F.array(*(F.lit(c[i]) for c in CLONE_COLOURS)), F.greatest(F.col("_c"), F.lit(0)).cast("int") + 1))
        return F.floor(GREY[i] + (full - GREY[i]) * F.col("shade") + 0.5).cast("int")

    rows = spots.join(known, "spot").join(F.broadcast(shift), "sample").join(F.broadcast(legend), "label").withColumn("shade", shade)
    return rows.select("spot", (F.col("x") + F.col("_x")).alias("px"), (-F.col("y")).alias("py"), "label", "legend", "shade", F.format_string("#%02x%02x%02x", *(part(i) for i in range(3))).alias("colour"))
