"""Aggregations of count tables in long form: absent rows are zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep


def dedup_sites(sites: DataFrame, key: str = "snp_id", order: Sequence[str] = ("line", "number")) -> DataFrame:
    """One row per site: first chr and position, sums of reads."""
    first = F.struct(*order)
    return sites.groupBy(key).agg(F.min_by("chr", first).alias("chr"), F.min_by("pos", first).alias("pos"), *(F.sum(c).alias(c) for c in ("ad", "dp", "oth")))


def block_sums(counts: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, spot, umi, a, b): counts of the features of each block, a feature once per block."""
    return counts.join(members.select(*keys, "feature").distinct(), "feature").groupBy(*keys, "spot").agg(*(F.sum(c).alias(c) for c in ("umi", "a", "b")))


def bin_phase_sums(blocks: DataFrame, phase: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums per bin with the second haplotype's reads flipped where ``phase`` is false, and what a bin spans.

    ``blocks``: (block, depth, b, umi), a row or more for each block; ``phase``: (block, keys, phase, start, end, rn).
    """
    spans = phase.groupBy(*keys).agg(F.min_by("start", "rn").alias("first_start"), F.max_by("end", "rn").alias("last_end"), F.countDistinct("block").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))
    sums = blocks.join(phase.select("block", "phase", *keys), "block").groupBy(*keys).agg(F.sum(F.when(F.col("phase"), F.col("b")).otherwise(F.col("depth") - F.col("b"))).alias("b"), F.sum("depth").alias("depth"), F.sum("umi").alias("umi"))
    return spans.join(sums, list(keys))


def pseudobulk(counts: DataFrame, clones: DataFrame, keys: Sequence[str], least_purity: float | None = None, every: DataFrame | None = None) -> DataFrame:
    """(clone, keys, umi, a, b, n_spots, purity): sums over the spots of each clone.

    ``clones``: (spot, clone, tumour); with ``least_purity`` only spots above it count. Clones and
    keys that never meet have no row (read as zeros) or, with ``every(clone)``, a row of zeros.
    """
    held = clones if least_purity is None else clones.where(F.col("tumour") > least_purity)
    sizes = held.groupBy("clone").agg(F.count(F.lit(1)).alias("n_spots"), F.avg("tumour").alias("purity"))
    sums = counts.join(held.select("spot", "clone"), "spot").groupBy("clone", *keys).agg(*(F.sum(c).alias(c) for c in ("umi", "a", "b")))
    if every is None:
        return sums.join(sizes, "clone")
    grid = counts.select(*keys).distinct().join(F.broadcast(every.select("clone")), how="cross")  # clones are a dimension; the answer has one row for each
    return grid.join(sums, ["clone", *keys], "left").join(F.broadcast(sizes), "clone", "left").fillna(0, ["umi", "a", "b", "n_spots"])


def ordered_by(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """``rows`` with their ``place`` in a list of names, in that order; rows that aren't in the list come last."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(list(names),)], "names array<string>").select(F.posexplode("names").alias("place", key))
    listed = listed.groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(listed, key, "left").orderBy(F.col("place").asc_nulls_last(), key)


def pooled(counts: DataFrame, edges: DataFrame, keys: Sequence[str], values: Sequence[str] = ("umi", "a", "b")) -> DataFrame:
    """Unweighted sums over the neighbours that ``edges(src, dst)`` lists for each spot (itself, if listed)."""
    return edges.join(counts, edges["dst"] == counts["spot"]).groupBy(F.col("src").alias("spot"), *keys).agg(*(F.sum(v).alias(v) for v in values))


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """(size, n): how many keys have so many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def unique_pairs(obs: DataFrame, k: str, n: str, weights: Sequence[str], decimals: int = 3) -> DataFrame:
    """Distinct (k, rounded n) with their summed weights: what the likelihood of a fit needs."""
    return obs.groupBy(F.col(k).alias("k"), F.round(F.col(n), decimals).alias("n")).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(w).alias(w) for w in weights))


def dispersion_over_bins(counts: DataFrame, n_bins: int, value: str = "umi") -> DataFrame:
    """(spot, std): population deviation of log1p over all ``n_bins``, absent ones included."""
    x = F.log1p(F.col(value).cast("double"))
    m = F.sum(x) / n_bins
    return counts.groupBy("spot").agg(F.sqrt(F.greatest(F.sum(x * x) / n_bins - m * m, F.lit(0.0))).alias("std"))


#: Cells of a histogram that looks for a rank.
CELLS = 1024


def order_statistics(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = ()) -> list[tuple]:
    """[(keys, quantiles …)] with linear interpolation, of a few groups; None where a group has no value.

    Selection by refined histograms: a pass counts the values of a rank's range in ``CELLS`` cells,
    the next one looks into the cell that holds the rank, between the smallest and the largest value
    there, until these are one. Nothing is sorted, and no task holds more than counts. Null and NaN
    aren't values. Passes read one kept copy of the values: sums of doubles differ in their last
    digits from one run to the next, and a rank would be lost between two runs.
    """
    spark, v = df.sparkSession, F.col(value).cast("double")
    every = keep(df.select(*keys, v.alias("_v")))
    rows = every.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = every.select(*keys).distinct().collect() if keys else [()]
    ends = {tuple(r[: len(keys)]): tuple(r[len(keys) :]) for r in rows.groupBy(*keys).agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).collect()}
    ends = {g: e for g, e in ends.items() if e[0]}
    wanted = {(g, r): (r, lo, hi) for g, (n, lo, hi) in ends.items() for q in at for r in {int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1)}}
    known: dict[tuple, float] = {}
    while wanted:
        known |= {k: lo for k, (_, lo, hi) in wanted.items() if lo == hi}
        wanted = {k: t for k, t in wanted.items() if t[1] != t[2]}
        if not wanted:
            break
        number = {k: i for i, k in enumerate(wanted)}
        table = [(*g, i, lo, hi) for (g, r), i in number.items() for _, lo, hi in [wanted[g, r]]]
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
        ranges = F.broadcast(spark.createDataFrame(table, ", ".join([*kinds, "_i int", "_lo double", "_hi double"])))  # a few rows a group
        met = rows.join(ranges, [rows[c].eqNullSafe(ranges[c]) for c in keys] or F.lit(True)).where("_v between _lo and _hi")
        cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1))
        counted: dict[int, list] = {}
        for r in met.groupBy("_i", cell.alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
            counted.setdefault(r["_i"], []).append((r["_c"], r["n"], r["lo"], r["hi"]))
        later = {}
        for key, i in number.items():
            left = wanted[key][0]
            for _, n, lo, hi in sorted(counted[i]):
                if left < n:
                    later[key] = (left, lo, hi)
                    break
                left -= n
        wanted = later
    out = []
    for g in map(tuple, groups):
        if g not in ends:
            out.append((*g, *(None for _ in at)))
            continue
        n, found = ends[g][0], []
        for q in at:
            r = int(q * (n - 1))
            lo, hi = known[g, r], known[g, min(r + 1, n - 1)]
            found.append(lo + (q * (n - 1) - r) * (hi - lo))
        out.append((*g, *found))
    return out


def percentiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles of a few groups with linear interpolation, one column each (``p50`` …)."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    return df.sparkSession.createDataFrame(order_statistics(df, value, at, keys), ", ".join([*kinds, *(f"p{round(100 * q)} double" for q in at)]))


def clone_log_weights(labels: DataFrame, clones: DataFrame) -> DataFrame:
    """(sample, clone, log_weight): log share of each clone in a sample, -50 for none, normalised."""
    n = labels.groupBy("sample", "clone").agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select("sample").distinct().join(F.broadcast(clones), how="cross")  # samples x clones: both are dimensions
    total = F.sum("n").over(Window.partitionBy("sample"))
    raw = grid.join(n, ["sample", "clone"], "left").fillna(0, ["n"]).withColumn("w", F.when(F.col("n") > 0, F.log(F.col("n") / total)).otherwise(F.lit(-50.0)))
    return raw.select("sample", "clone", (F.col("w") - F.log(F.sum(F.exp("w")).over(Window.partitionBy("sample")))).alias("log_weight"))


def keep_spots(counts: DataFrame, least_umi: int = 50, least_allele: int = 50) -> DataFrame:
    """Spots with enough gene and allele counts."""
    return counts.groupBy("spot").agg(F.sum("umi").alias("umi"), F.sum(F.col("a") + F.col("b")).alias("allele")).where((F.col("umi") >= least_umi) & (F.col("allele") >= least_allele))


def keep_genes(counts: DataFrame, share: float = 0.005) -> DataFrame:
    """Features expressed in at least ``share`` of the spots that ``counts`` holds."""
    spots = counts.agg(F.countDistinct("spot").alias("spots"))
    met = counts.groupBy("feature").agg(F.count_if(F.col("umi") > 0).alias("n_spots"), F.sum("umi").alias("umi"))
    return met.join(F.broadcast(spots)).where(F.col("n_spots") >= share * F.col("spots")).drop("spots")  # one row


def fold_changes(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(feature, cpm_in, cpm_out, log_fc) of spots inside against outside ``groups(spot, inside)``; 10 where either is 0."""
    sums = counts.join(groups, "spot").groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("umi")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("umi"))).alias("o"))
    total = sums.agg(F.sum("i").alias("ti"), F.sum("o").alias("to"))
    scaled = sums.join(F.broadcast(total)).select("feature", (F.col("i") * 1e6 / F.nullif("ti", F.lit(0))).alias("cpm_in"), (F.col("o") * 1e6 / F.nullif("to", F.lit(0))).alias("cpm_out"))
    positive = (F.col("cpm_in") > 0) & (F.col("cpm_out") > 0)
    return scaled.withColumn("log_fc", F.when(positive, F.log2(F.when(positive, F.col("cpm_in") / F.col("cpm_out")))).otherwise(F.lit(10.0)))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(ari, n): adjusted Rand index of two labellings, 1 where both are trivial."""
    def two(c: Column) -> Column:
        return c * (c - 1) / 2

    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name)) for c, name in ((a, "sa"), (b, "sb")))
    both = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(rows).join(cols)  # one row each
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("n")), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return both.select(F.coalesce((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"), "n")


def normal_baseline(counts: DataFrame, normal: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """(keys, spot, base): expected counts from the profile of ``normal(spot)`` and each spot's total; thin bins have 0."""
    profile = counts.join(normal, "spot", "left_semi").groupBy(*keys).agg(F.sum("umi").alias("n")).where(F.col("n") >= least)
    share = profile.join(F.broadcast(profile.agg(F.sum("n").alias("total")))).select(*keys, (F.col("n") / F.col("total")).alias("share"))
    totals = counts.groupBy("spot").agg(F.sum("umi").alias("spot_total"))
    return counts.select(*keys, "spot", "umi").join(share, list(keys), "left").join(totals, "spot").select(*keys, "spot", "umi", (F.coalesce("share", F.lit(0.0)) * F.col("spot_total")).alias("base"))


def weighted_share(df: DataFrame, value: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """Σ weight · value / Σ weight; null without weight."""
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.nullif(F.sum(weight), F.lit(0))).alias("share"))


def interval_mean(df: DataFrame, value: str, n: int, keys: Sequence[str], order: str) -> DataFrame:
    """Means of ``n`` consecutive rows; a short rest is dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = df.withColumn("part", F.floor((F.row_number().over(w) - 1) / n))
    return at.groupBy(*keys, "part").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")


def top_shares(counts: DataFrame, k: int = 25) -> DataFrame:
    """The k features with the largest share of all counts (a top-k report)."""
    sums = counts.groupBy("feature").agg(F.sum("umi").alias("umi"))
    return sums.join(F.broadcast(sums.agg(F.sum("umi").alias("total")))).select("feature", "umi", (F.col("umi") / F.col("total")).alias("share")).orderBy(F.desc("umi"), "feature").limit(k)
