"""Registered queries of the copy-number operators over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import aggregate as A
from .operators import copynumber as N
from .operators import fit as FIT
from .operators import genome as G
from .operators import graph as X
from .operators import hmm as H
from .operators import hmrf as R
from .operators import simulate as S
from .operators.storage import keep
from .plans import bindings as B
from .plans import pipeline as P
from .sources.readers import split_barcode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Bases in a block of the bound tables.
BLOCK = 1000
#: States of the queries with fixed parameters.
THREE = H.States(p=(0.5, 0.3, 0.15), tau=(30.0, 30.0, 30.0), log_mu=(0.0, 0.3, -0.4), alpha=(0.1, 0.1, 0.1), log_start=(-0.6931471805599453, -1.3862943611198906, -1.3862943611198906), log_trans=((-0.1053605156578263, -2.995732273553991, -2.995732273553991), (-2.995732273553991, -0.1053605156578263, -2.995732273553991), (-2.995732273553991, -2.995732273553991, -0.1053605156578263)))


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.genome(spark, d).withColumn("block", F.floor(F.col("start") / BLOCK))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """(chr, block, spot, umi, a, b): reads of genes, allele reads of SNPs, a row for each feature and spot.

    Sums of single columns over more than a block's spot take these rows: sums by block and spot beforehand hardly shrink them.
    """
    members = _blocks(spark, d).select("chr", "block", "feature", "is_interval")
    if B.task_number(spark, d):
        members = members.hint("shuffle_hash")  # lines lie by feature already: a task's features meet them unsorted, and none are broadcast
    gene = F.col("is_interval")
    own = {"umi": F.when(gene, F.col("umi")).otherwise(0), "a": F.when(gene, 0).otherwise(F.col("a")), "b": F.when(gene, 0).otherwise(F.col("b"))}
    return B.counts(spark, d).join(members, "feature").select("chr", "block", "spot", *(v.alias(c) for c, v in own.items()))


def _in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Counts per (chr, block, spot): reads of genes, allele reads of SNPs."""
    rows, parts = _reads(spark, d), B.task_number(spark, d)
    if parts:
        rows = rows.repartition(parts, "spot", "chr")  # sums by spot and chromosome that follow need no further shuffle
    return rows.groupBy("chr", "block", "spot").agg(*(F.sum(c).alias(c) for c in ("umi", "a", "b")))


#: The same for DuckDB.
_IN_BLOCKS = f"cells AS (SELECT g.chr, g.start // {BLOCK} AS block, c.spot, CAST(sum(CASE WHEN g.is_interval THEN c.umi ELSE 0 END) AS BIGINT) AS umi, CAST(sum(CASE WHEN g.is_interval THEN 0 ELSE c.a END) AS BIGINT) AS a, CAST(sum(CASE WHEN g.is_interval THEN 0 ELSE c.b END) AS BIGINT) AS b FROM counts c JOIN genome g USING (feature) GROUP BY ALL)"


def _nb_sql(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {p} > 0 AND {p} < 1 AND {n} > 0 AND {k} >= 0 THEN lgamma({k} + {n}) - lgamma({n}) - lgamma({k} + 1.0) + {n} * ln({p}) + {k} * ln(1 - {p}) ELSE 0.0 END)"


def _bb_sql(k: str, n: str, a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 AND {b} > 0 AND {n} >= 0 AND {k} >= 0 AND {k} <= {n} THEN lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0) + lgamma({k} + {a}) + lgamma({n} - {k} + {b}) - lgamma({n} + {a} + {b}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) ELSE 0.0 END)"


@query(B.with_views("counts genome spots", "SELECT s.clone, c.chr, c.block, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, round(sum(b) / nullif(CAST(sum(a) + sum(b) AS DOUBLE), 0), 6) AS baf FROM cells c JOIN spots s USING (spot) GROUP BY s.clone, c.chr, c.block", _IN_BLOCKS))
def pseudobulk_baf(spark: SparkSession, d: str) -> DataFrame:
    """Counts and allele share of every clone and block."""
    bulk = A.pseudobulk(_reads(spark, d), B.spots(spark, d).select("spot", "clone", "tumour"), ["chr", "block"])
    return bulk.select("clone", "chr", "block", "umi", "a", "b", F.round(F.col("b") / F.nullif((F.col("a") + F.col("b")).cast("double"), F.lit(0.0)), 6).alias("baf"))


@query(B.with_views("sites", "SELECT line, number, feature, spot, ad, dp, oth, CASE WHEN ad = dp THEN '1/1' WHEN ad > 0 AND dp - ad > 0 THEN '0/1' ELSE '0/0' END AS gt FROM sites WHERE dp > 0 AND ((ad >= 2 AND dp - ad >= 2 AND ad >= 0.1 * dp AND ad <= 0.9 * dp) OR (dp >= 10 AND (ad = dp OR ad = 0)))"))
def info_parse_genotype(spark: SparkSession, d: str) -> DataFrame:
    """Informative sites from INFO strings, with genotypes."""
    rows = B.site_counts(spark, d).select("line", "number", "feature", "spot", C.info_fields(F.col("info")))
    return rows.where(C.informative_snp(F.col("ad"), F.col("dp"))).withColumn("gt", C.genotype(F.col("ad"), F.col("dp")))


@query(B.with_views("sites genome", "SELECT chr || '_' || start || '_' || CASE WHEN feature % 2 = 0 THEN 'A' ELSE 'C' END || '_G' AS snp_id, CAST(min(chr) AS INTEGER) AS chr, min(start) AS pos, CAST(sum(ad) AS BIGINT) AS ad, CAST(sum(dp) AS BIGINT) AS dp, CAST(sum(oth) AS BIGINT) AS oth FROM sites JOIN genome USING (feature) GROUP BY ALL"))
def snp_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Reads of each site id, repeated records summed."""
    rows = B.site_counts(spark, d).join(B.genome(spark, d).select("feature", "chr", F.col("start").alias("pos")), "feature")
    ref = F.when(F.col("feature") % 2 == 0, "A").otherwise("C")
    return A.dedup_sites(rows.withColumn("snp_id", F.concat_ws("_", "chr", "pos", ref, F.lit("G"))))


@query(B.with_views("sites", "SELECT feature, spot, CAST(sum(dp - CASE WHEN gt = '0|1' THEN ad ELSE dp - ad END) AS BIGINT) AS a, CAST(sum(CASE WHEN gt = '0|1' THEN ad ELSE dp - ad END) AS BIGINT) AS b FROM sites JOIN (SELECT p_partkey AS feature, CASE WHEN p_size % 2 = 0 THEN '0|1' ELSE '1|0' END AS gt FROM part WHERE p_partkey % 3 <> 0) USING (feature) GROUP BY feature, spot"))
def phase_select(spark: SparkSession, d: str) -> DataFrame:
    """Reads of both haplotypes of phased sites."""
    phase = B.genome(spark, d).where(~F.col("is_interval")).select("feature", F.when(F.col("size") % 2 == 0, "0|1").otherwise("1|0").alias("gt"))
    rows = B.site_counts(spark, d).join(phase, "feature")
    b = C.phased_count(F.col("gt"), F.col("ad"), F.col("dp"))
    return rows.groupBy("feature", "spot").agg(F.sum(F.col("dp") - b).alias("a"), F.sum(b).alias("b"))


@query("SELECT o_orderkey AS k, split_part(label, '_', 1) AS barcode, CASE split_part(label, '_', -1) WHEN 'U1' THEN 'sample-U1' WHEN 'U2' THEN 'sample-U2' ELSE split_part(label, '_', -1) END AS sample FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || 'AC_' || o_orderpriority || '_U' || (o_custkey % 3) AS label FROM orders)")
def barcode_split(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes and samples of joined labels, short sample names made full."""
    label = F.concat(F.col("o_orderkey").cast("string"), F.lit("AC_"), "o_orderpriority", F.lit("_U"), (F.col("o_custkey") % 3).cast("string"))
    rows = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), label.alias("label")).select("k", *split_barcode(F.col("label")))
    names = F.create_map(F.lit("U1"), F.lit("sample-U1"), F.lit("U2"), F.lit("sample-U2"))
    return rows.withColumn("sample", F.coalesce(F.try_element_at(names, F.col("sample")), F.col("sample")))


@query("SELECT feature, name, regexp_matches(name, '^MT-|^S100A6$|^B2M$|^HLA-B$|^TPT1$|^FTL$|^FTH1$|^RPL|^RPS') AS cancer FROM (SELECT p_partkey AS feature, ['MT-CO', 'S100A6', 'B2M', 'HLA-B', 'HLA-C', 'RPL', 'RPS', 'FTLX', 'GENE', 'TPT1'][1 + p_partkey % 10] || CASE WHEN p_partkey % 10 IN (0, 5, 6, 8) THEN CAST(p_size AS VARCHAR) ELSE '' END AS name FROM part)")
def gene_class_regex(spark: SparkSession, d: str) -> DataFrame:
    """Genes by the expression-class patterns."""
    stems = F.array(*map(F.lit, ("MT-CO", "S100A6", "B2M", "HLA-B", "HLA-C", "RPL", "RPS", "FTLX", "GENE", "TPT1")))
    at = (F.col("feature") % 10).cast("int")
    name = F.concat(stems[at], F.when(at.isin(0, 5, 6, 8), F.col("size").cast("string")).otherwise(""))
    return B.genome(spark, d).select("feature", name.alias("name"), C.is_cancer_gene(name).alias("cancer"))


@query(B.with_views("counts spots", "SELECT DISTINCT s.spot, s.sample FROM spots s WHERE s.spot IN (SELECT spot FROM counts WHERE umi > 0) AND s.spot IN (SELECT spot FROM counts WHERE a + b > 0)"))
def shared_barcodes(spark: SparkSession, d: str) -> DataFrame:
    """Spots with positions, reads and allele reads."""
    c = B.counts(spark, d)
    both = B.spots(spark, d).select("spot", "sample").join(c.where("umi > 0").select("spot"), "spot", "left_semi")
    return both.join(c.where("a + b > 0").select("spot"), "spot", "left_semi").distinct()


@query(B.with_views("counts", "SELECT feature, spot, umi FROM counts WHERE feature NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')"))
def blacklist_anti(spark: SparkSession, d: str) -> DataFrame:
    """Counts without listed genes."""
    return B.counts(spark, d).select("feature", "spot", "umi").join(B.genome(spark, d).where("brand = 'Brand#13'").select("feature"), "feature", "left_anti")


@query(B.with_views("genome ranges", "SELECT feature, g.chr, g.start FROM genome g WHERE NOT is_interval AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.chr = g.chr AND r.start <= g.start AND g.start < r.\"end\")"))
def range_filter_anti(spark: SparkSession, d: str) -> DataFrame:
    """SNPs outside all listed ranges."""
    return G.range_anti(B.genome(spark, d).where("not is_interval").select("feature", "chr", "start"), B.ranges(spark, d))


@query(B.with_views("genome", "SELECT s.feature, s.chr, s.start, arg_max(g.feature, g.rn) AS gene FROM r s JOIN r g ON g.chr = s.chr AND g.rn < s.rn AND g.rn >= s.rn - 50 AND g.is_interval AND g.start <= s.start AND s.start < g.\"end\" WHERE NOT s.is_interval GROUP BY ALL", "r AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY start, is_interval DESC, feature) AS rn FROM genome)"))
def gene_lookback(spark: SparkSession, d: str) -> DataFrame:
    """The gene around each SNP among the 50 rows before it."""
    return G.look_back(G.ordinal(B.genome(spark, d))).select("feature", "chr", "start", "gene")


_ISLANDS = "flag AS (SELECT chr, feature, start, \"end\", CASE WHEN start < max(\"end\") OVER (PARTITION BY chr ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM genome WHERE is_interval AND \"end\" > start), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM flag), merged AS (SELECT chr, CAST(island AS BIGINT) AS island, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM isl GROUP BY ALL)"


@query(B.with_views("genome", "SELECT * FROM merged", _ISLANDS))
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Islands of overlapping genes."""
    return G.merge_intervals(B.genome(spark, d).where("is_interval"))


@query(B.with_views("genome", "SELECT g.feature, g.chr, m.island FROM genome g JOIN merged m ON m.chr = g.chr AND greatest(g.start, m.start) < least(g.\"end\", m.\"end\")", _ISLANDS))
def block_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the genome with the islands they overlap."""
    rows = B.genome(spark, d)
    return G.overlap_join(rows.select("feature", "chr", "start", "end"), G.merge_intervals(rows.where("is_interval"))).select("feature", "chr", "island")


def _ordered_totals(spark: SparkSession, d: str) -> DataFrame:
    """(chr, feature, rn, u, len): allele reads of each row of the genome, in order."""
    totals = B.counts(spark, d).groupBy("feature").agg(F.sum(F.col("a") + F.col("b")).alias("u"))
    rows = G.ordinal(B.genome(spark, d)).join(totals, "feature", "left").fillna(0, ["u"])
    return rows.select("chr", "feature", "rn", "u", (F.col("end") - F.col("start")).alias("len"), "start", "end")


_TOTALS = "tot AS (SELECT feature, sum(a + b) AS u FROM counts GROUP BY feature), r AS (SELECT g.chr, g.feature, row_number() OVER (PARTITION BY chr ORDER BY start, is_interval DESC, g.feature) AS rn, CAST(coalesce(u, 0) AS BIGINT) AS u, g.\"end\" - g.start AS len, g.start, g.\"end\" FROM genome g LEFT JOIN tot USING (feature))"


@query(B.with_views("counts genome", "SELECT w.chr, w.feature, w.block - CASE WHEN w.block = l.last AND l.last > 0 AND l.total < 600 THEN 1 ELSE 0 END AS block FROM w JOIN (SELECT chr, arg_max(block, rn) AS last, arg_max(acc, rn) AS total FROM w GROUP BY chr) l USING (chr)", _TOTALS + ", w AS (SELECT chr, feature, rn, u AS acc, CAST(0 AS BIGINT) AS block FROM r WHERE rn = 1 UNION ALL SELECT r.chr, r.feature, r.rn, CASE WHEN w.acc >= 600 THEN r.u ELSE w.acc + r.u END, CASE WHEN w.acc >= 600 THEN w.block + 1 ELSE w.block END FROM w JOIN r ON r.chr = w.chr AND r.rn = w.rn + 1)", recursive=True))
def greedy_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at least 600 allele reads."""
    return G.greedy_blocks(_ordered_totals(spark, d), least=600).select("chr", "feature", "block")


@query(B.with_views("counts genome", "SELECT w.chr, w.segment, w.feature, w.bin - CASE WHEN w.bin = l.last AND l.last > 0 AND l.total < 450 AND l.size < 400 THEN 1 ELSE 0 END AS bin FROM w JOIN (SELECT chr, segment, arg_max(bin, k) AS last, arg_max(acc, k) AS total, arg_max(size, k) AS size FROM w GROUP BY ALL) l USING (chr, segment)", _TOTALS + ", cut AS (SELECT *, CASE WHEN len > 400 OR coalesce(lag(len > 400) OVER (PARTITION BY chr ORDER BY rn), false) THEN 1 ELSE 0 END AS c FROM r), seg AS (SELECT *, CAST(sum(c) OVER (PARTITION BY chr ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM cut), s AS (SELECT *, row_number() OVER (PARTITION BY chr, segment ORDER BY rn) AS k FROM seg), w AS (SELECT chr, segment, feature, k, u AS acc, len AS size, CAST(0 AS BIGINT) AS bin FROM s WHERE k = 1 UNION ALL SELECT s.chr, s.segment, s.feature, s.k, CASE WHEN w.acc >= 900 OR w.size + s.len >= 800 THEN s.u ELSE w.acc + s.u END, CASE WHEN w.acc >= 900 OR w.size + s.len >= 800 THEN s.len ELSE w.size + s.len END, CASE WHEN w.acc >= 900 OR w.size + s.len >= 800 THEN w.bin + 1 ELSE w.bin END FROM w JOIN s ON s.chr = w.chr AND s.segment = w.segment AND s.k = w.k + 1)", recursive=True))
def greedy_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins inside segments that long rows bound."""
    rows = G.break_points(_ordered_totals(spark, d), longest=400)
    return G.greedy_bins(rows, least=900, longest=800, keys=("chr", "segment")).select("chr", "segment", "feature", "bin")


@query(B.with_views("chains", "SELECT chain, t, segment FROM w", "v AS (SELECT chain, t, list_value(least(k / n, 1 - k / n), least((n - k) / (n + 1), 1 - (n - k) / (n + 1))) AS m FROM chains), w AS (SELECT chain, t, m, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS segment FROM v WHERE t = 1 UNION ALL SELECT v.chain, v.t, v.m, CASE WHEN v.t - 1 > w.last + 10 AND (abs(v.m[1] - w.m[1]) > 0.1 OR abs(v.m[2] - w.m[2]) > 0.1) THEN v.t - 1 ELSE w.last END, CASE WHEN v.t - 1 > w.last + 10 AND (abs(v.m[1] - w.m[1]) > 0.1 OR abs(v.m[2] - w.m[2]) > 0.1) THEN w.segment + 1 ELSE w.segment END FROM w JOIN v ON v.chain = w.chain AND v.t = w.t + 1)", recursive=True))
def profile_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of chains where any of two shares jumps."""
    rows = B.chains(spark, d).withColumn("bafs", F.array(F.col("k") / F.col("n"), (F.col("n") - F.col("k")) / (F.col("n") + 1)))
    return G.profile_segments(rows).select("chain", "t", "segment")


@query("SELECT chain, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(t) AS first, max(t) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY chain ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY chain ORDER BY t) OR t = 1 THEN 1 ELSE 0 END AS c FROM (SELECT user_id AS chain, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events))) GROUP BY chain, run")
def run_length(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one type of event."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return G.run_length(B.read(spark, d, "events").select(F.col("user_id").alias("chain"), t.alias("t"), "event_type"), "event_type", ["chain"], "t")


@query(B.with_views("chains", "SELECT chain, t, round(last_value(CASE WHEN t % 3 = 0 THEN NULL ELSE k / n END IGNORE NULLS) OVER (PARTITION BY chain ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS baf FROM chains"))
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Shares with gaps filled from the row before."""
    gap = F.when(F.col("t") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("k") / F.col("n"))
    return G.forward_fill(B.chains(spark, d).select("chain", F.col("t").cast("long").alias("t"), gap.alias("baf")), "baf", ["chain"], "t").withColumn("baf", F.round("baf", 6))


_CM = "m AS (SELECT chr, pos, max(cm) AS cm FROM gmap GROUP BY ALL), pts AS (SELECT feature, chr, start AS pos FROM genome WHERE NOT is_interval), placed AS (SELECT p.feature, p.chr, p.pos, CASE WHEN a.pos IS NULL THEN CASE WHEN b.pos = 0 THEN b.cm ELSE b.cm * p.pos / b.pos END WHEN b.pos IS NULL OR a.pos = b.pos THEN a.cm ELSE a.cm + (b.cm - a.cm) * (p.pos - a.pos) / (b.pos - a.pos) END AS cm FROM pts p ASOF LEFT JOIN m a ON a.chr = p.chr AND a.pos <= p.pos ASOF LEFT JOIN m b ON b.chr = p.chr AND b.pos >= p.pos)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    points = B.genome(spark, d).where("not is_interval").select("feature", "chr", F.col("start").alias("pos"))
    return G.centimorgans(points, B.genetic_map(spark, d))


@query(B.with_views("genome gmap", "SELECT feature, chr, pos, round(cm, 6) AS cm FROM placed", _CM))
def cm_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Genetic positions of SNPs."""
    return _placed(spark, d).withColumn("cm", F.round("cm", 6))


@query(B.with_views("genome gmap", "SELECT chr, block, round(log10(p), 5) AS log_p, round(least(ln(0.5), ln(p) + 2), 5) AS log_switch FROM (SELECT chr, block, coalesce(greatest((1 - exp(-2 * (lead(f) OVER (PARTITION BY chr ORDER BY block) - l))) / 2, 1e-20), 1e-20) AS p FROM (SELECT chr, pos // 1000 AS block, arg_min(cm, pos * 1000000 + feature) AS f, arg_max(cm, pos * 1000000 + feature) AS l FROM placed GROUP BY ALL))", _CM))
def phase_switch_prob(spark: SparkSession, d: str) -> DataFrame:
    """Switch probabilities between blocks."""
    at = F.struct("pos", "feature")
    blocks = _placed(spark, d).groupBy("chr", F.floor(F.col("pos") / BLOCK).alias("rn")).agg(F.min_by("cm", at).alias("cm_first"), F.max_by("cm", at).alias("cm_last"))
    return G.site_transitions(blocks).select("chr", F.col("rn").alias("block"), F.round(F.log10("p_switch"), 5).alias("log_p"), F.round("log_switch", 5).alias("log_switch"))


@query(B.with_views("counts genome", "SELECT chr, bin, min(block) * 1000 AS first_start, max(block) * 1000 + 1000 AS last_end, count(DISTINCT block) AS n_blocks, string_agg(DISTINCT CAST(block AS VARCHAR), ',' ORDER BY CAST(block AS VARCHAR)) AS blocks, CAST(sum(CASE WHEN block % 2 = 0 THEN b ELSE a END) AS BIGINT) AS b, CAST(sum(a + b) AS BIGINT) AS depth, CAST(sum(umi) AS BIGINT) AS umi FROM (SELECT *, block // 3 AS bin FROM cells) GROUP BY chr, bin", _IN_BLOCKS))
def bin_phase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bins of three blocks, every other block's phase flipped."""
    cells = _in_blocks(spark, d).groupBy("chr", "block").agg(F.sum(F.col("a") + F.col("b")).alias("depth"), F.sum("b").alias("b"), F.sum("umi").alias("umi"))  # a bin's sums don't tell spots apart
    cells = keep(cells.select(F.concat_ws(":", "chr", "block").alias("id"), "chr", "block", "depth", "b", "umi"))
    phase = cells.select("id", "chr", F.col("block").alias("number")).select(F.col("id").alias("block"), "chr", F.floor(F.col("number") / 3).alias("bin"), (F.col("number") % 2 == 0).alias("phase"), (F.col("number") * BLOCK).alias("start"), ((F.col("number") + 1) * BLOCK).alias("end"), F.col("number").alias("rn"))
    out = A.bin_phase_sums(cells.select(F.col("id").alias("block"), "depth", "b", "umi"), phase, ["chr", "bin"])
    return out.withColumn("blocks", F.array_join(F.transform(F.split("blocks", ","), lambda x: F.element_at(F.split(x, ":"), 2)), ","))


@query(B.with_views("counts", "SELECT feature, n_spots, CAST(umi AS BIGINT) AS umi FROM (SELECT feature, count(*) FILTER (umi > 0) AS n_spots, sum(umi) AS umi FROM c GROUP BY feature) WHERE n_spots >= 0.005 * (SELECT count(DISTINCT spot) FROM c)", "c AS (SELECT * FROM counts WHERE spot IN (SELECT spot FROM counts GROUP BY spot HAVING sum(umi) >= 50 AND sum(a + b) >= 50))"))
def spot_gene_filter(spark: SparkSession, d: str) -> DataFrame:
    """Genes expressed in enough of the spots that have enough counts."""
    c = B.counts(spark, d)
    return A.keep_genes(c.join(A.keep_spots(c), "spot", "left_semi"))


@query(B.with_views("counts", "SELECT size, count(*) AS n FROM (SELECT spot, count(*) AS size FROM counts GROUP BY spot) GROUP BY size"))
def count_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many spots have how many features."""
    return A.count_of_counts(B.counts(spark, d), "spot")


@query(B.with_views("counts genome spots", "SELECT sample, round(quantile_cont(std, 0.4), 6) AS p40, round(quantile_cont(std, 0.5), 6) AS p50, round(quantile_cont(std, 0.9), 6) AS p90 FROM (SELECT spot, sqrt(greatest(sum(ln(1 + umi) * ln(1 + umi)) / 40 - (sum(ln(1 + umi)) / 40) * (sum(ln(1 + umi)) / 40), 0)) AS std FROM (SELECT spot, chr * 2 + block % 2 AS bin, sum(umi) AS umi FROM cells GROUP BY ALL) GROUP BY spot) JOIN spots USING (spot) GROUP BY sample", _IN_BLOCKS))
def percentiles_std(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles, per sample, of the spots' deviation over bins."""
    bins = _reads(spark, d).groupBy("spot", (F.col("chr") * 2 + F.col("block") % 2).alias("bin")).agg(F.sum("umi").alias("umi"))
    rows = A.dispersion_over_bins(bins, 40).join(B.spots(spark, d).select("spot", "sample"), "spot")
    out = A.percentiles(rows, "std", (0.4, 0.5, 0.9), ["sample"])
    return out.select("sample", *(F.round(c, 6).alias(c) for c in ("p40", "p50", "p90")))


@query(B.with_views("spots", "SELECT sample, clone, round(w - ln(sum(exp(w)) OVER (PARTITION BY sample)), 6) AS log_weight FROM (SELECT s.sample, c.clone, CASE WHEN n IS NULL THEN -50.0 ELSE ln(n / sum(coalesce(n, 0)) OVER (PARTITION BY s.sample)) END AS w FROM (SELECT DISTINCT sample FROM spots) s CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS clone) c LEFT JOIN (SELECT sample, clone, count(*) AS n FROM spots GROUP BY ALL) USING (sample, clone))"))
def clone_log_weights(spark: SparkSession, d: str) -> DataFrame:
    """Log weights of four clones in each sample."""
    return A.clone_log_weights(B.spots(spark, d), spark.range(4).select(F.col("id").cast("int").alias("clone"))).withColumn("log_weight", F.round("log_weight", 6))


@query("SELECT round((s - sa * sb / nn) / ((sa + sb) / 2 - sa * sb / nn), 6) AS ari, CAST(n AS BIGINT) AS n FROM (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n, sum(n) * (sum(n) - 1) / 2 AS nn FROM c), (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))".join(["WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL) ", ""]))
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labellings of orders."""
    return A.adjusted_rand(B.read(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("ari", 6).alias("ari"), "n")


@query(B.with_views("counts genome spots", "SELECT c.chr, c.block, c.spot, c.umi, round(coalesce(n / total, 0) * spot_total, 4) AS base FROM cells c LEFT JOIN (SELECT chr, block, n, sum(n) OVER () AS total FROM (SELECT chr, block, sum(umi) AS n FROM cells WHERE spot IN (SELECT spot FROM spots WHERE clone = 0) GROUP BY ALL) WHERE n >= 20) USING (chr, block) JOIN (SELECT spot, sum(umi) AS spot_total FROM cells GROUP BY spot) USING (spot)", _IN_BLOCKS))
def normal_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Expected counts from the profile of clone 0."""
    out = A.normal_baseline(_in_blocks(spark, d), B.spots(spark, d).where("clone = 0").select("spot"), ["chr", "block"])
    return out.withColumn("base", F.round("base", 4))


@query(B.with_views("counts genome spots", "SELECT chr, clone, round(sum(baf * n) / nullif(sum(n), 0), 6) AS share FROM (SELECT chr, block, clone, CAST(sum(a + b) AS DOUBLE) AS n, sum(b) / nullif(CAST(sum(a + b) AS DOUBLE), 0) AS baf FROM cells JOIN spots USING (spot) GROUP BY ALL) GROUP BY chr, clone", _IN_BLOCKS))
def population_baf(spark: SparkSession, d: str) -> DataFrame:
    """Depth-weighted allele share of each chromosome and clone."""
    bulk = pseudobulk_rows(spark, d).withColumn("n", (F.col("a") + F.col("b")).cast("double"))
    return A.weighted_share(bulk.withColumn("baf", F.col("b") / F.nullif("n", F.lit(0.0))), "baf", "n", ["chr", "clone"]).withColumn("share", F.round("share", 6))


def pseudobulk_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.pseudobulk(_reads(spark, d), B.spots(spark, d).select("spot", "clone", "tumour"), ["chr", "block"])


@query(B.with_views("chains", "SELECT chain, part, round(avg(k), 6) AS mean FROM (SELECT chain, (t - 1) // 4 AS part, k FROM chains) GROUP BY ALL HAVING count(*) = 4"))
def interval_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means of four rows each."""
    return A.interval_mean(B.chains(spark, d), "k", 4, ["chain"], "t").withColumn("mean", F.round("mean", 6))


@query(B.with_views("counts", "SELECT feature, umi, round(umi / total, 8) AS share FROM (SELECT feature, CAST(sum(umi) AS BIGINT) AS umi, sum(sum(umi)) OVER () AS total FROM counts GROUP BY feature) ORDER BY umi DESC, feature LIMIT 25"))
def top_genes(spark: SparkSession, d: str) -> DataFrame:
    """The 25 genes with most counts."""
    return A.top_shares(B.counts(spark, d)).withColumn("share", F.round("share", 8))


@query(B.with_views("chains", "SELECT k, CAST(n AS DOUBLE) AS n, count(*) AS rows, round(sum(1.0 / (1 + t)), 6) AS w0, round(sum(t / (1.0 + t)), 6) AS w1 FROM chains GROUP BY k, n"))
def unique_pair_compression(spark: SparkSession, d: str) -> DataFrame:
    """Distinct observations with summed weights of two states."""
    rows = B.chains(spark, d).select("k", F.col("n").cast("double").alias("n"), (1 / (1 + F.col("t"))).alias("w0"), (F.col("t") / (1.0 + F.col("t"))).alias("w1"))
    return A.unique_pairs(rows, "k", "n", ["w0", "w1"]).select("k", "n", "rows", F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"))


@query(B.with_views("genome", "SELECT feature FROM genome WHERE is_interval AND type LIKE 'ECONOMY%' UNION SELECT feature FROM genome WHERE is_interval AND brand = 'Brand#13' EXCEPT SELECT feature FROM genome WHERE size > 40"))
def gene_union(spark: SparkSession, d: str) -> DataFrame:
    """Genes of either list that aren't in a third."""
    g = B.genome(spark, d)
    own = g.where("is_interval")
    either = own.where(F.col("type").startswith("ECONOMY")).select("feature").unionByName(own.where("brand = 'Brand#13'").select("feature")).distinct()
    return either.join(g.where("size > 40").select("feature"), "feature", "left_anti")


@query(B.with_views("counts genome spots", "SELECT feature, round(log_fc, 6) AS log_fc FROM (SELECT feature, CASE WHEN i > 0 AND o > 0 THEN log2((i * 1e6 / sum(i) OVER ()) / (o * 1e6 / sum(o) OVER ())) ELSE 10 END AS log_fc FROM (SELECT feature, CAST(sum(CASE WHEN clone = 0 THEN umi ELSE 0 END) AS DOUBLE) AS i, CAST(sum(CASE WHEN clone = 0 THEN 0 ELSE umi END) AS DOUBLE) AS o FROM counts JOIN spots USING (spot) GROUP BY feature))"))
def log_fold_change(spark: SparkSession, d: str) -> DataFrame:
    """Expression of clone 0 against the others."""
    groups = B.spots(spark, d).select("spot", (F.col("clone") == 0).alias("inside"))
    return A.fold_changes(B.counts(spark, d), groups).select("feature", F.round("log_fc", 6).alias("log_fc"))


@query(B.with_views("spots", "SELECT spot, sample, (CASE WHEN fx > 1.0 / 3 THEN 1 ELSE 0 END + CASE WHEN fx > 2.0 / 3 THEN 1 ELSE 0 END) * 2 + CASE WHEN fy > 0.5 THEN 1 ELSE 0 END AS block FROM (SELECT *, coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0) AS fx, coalesce((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 0) AS fy FROM spots WINDOW w AS (PARTITION BY sample))"))
def grid_partition(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a 3 x 2 grid over each sample."""
    return X.grid_partition(B.spots(spark, d), 3, 2).select("spot", "sample", "block")


_PAIRS = "p AS (SELECT a.sample, a.spot AS src, b.spot AS dst, 9 * (a.x - b.x) * (a.x - b.x) + 3 * (a.y - b.y) * (a.y - b.y) AS d2 FROM spots a JOIN spots b ON a.sample = b.sample AND a.spot <> b.spot)"


@query(B.with_views("spots", "SELECT sample, src, dst, d2 FROM p WHERE d2 <= 36", _PAIRS))
def radius_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spots within three neighbour distances."""
    return X.adjacency(B.spots(spark, d), 3.0)


@query(B.with_views("spots", "SELECT sample, src, dst, round(exp(-power(d2 / 36, 5)), 6) AS weight FROM p WHERE exp(-power(d2 / 36, 5)) > 1e-4", _PAIRS))
def kernel_graph(spark: SparkSession, d: str) -> DataFrame:
    """Weighted pairs of spots."""
    return X.weighted_adjacency(B.spots(spark, d), 36.0).withColumn("weight", F.round("weight", 6))



@query("SELECT src, dst, d2 FROM (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, (a.s_suppkey % 10 - b.s_suppkey % 10) ** 2.0 + (a.s_suppkey // 10 - b.s_suppkey // 10) ** 2.0 AS d2, row_number() OVER (PARTITION BY a.s_suppkey, b.s_nationkey ORDER BY (a.s_suppkey % 10 - b.s_suppkey % 10) ** 2.0 + (a.s_suppkey // 10 - b.s_suppkey // 10) ** 2.0, b.s_suppkey) AS r FROM supplier a JOIN supplier b ON abs(a.s_nationkey - b.s_nationkey) = 1 WHERE (a.s_suppkey % 10 - b.s_suppkey % 10) ** 2.0 + (a.s_suppkey // 10 - b.s_suppkey // 10) ** 2.0 <= 16) WHERE r <= 2")
def slice_knn(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest spots in each slice next to a spot's own."""
    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("spot"), F.col("s_nationkey").alias("z"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.expr("cast(s_suppkey div 10 as double)").alias("y"))
    return X.slice_neighbours(s, 2, 4.0)


@query("SELECT src, dst, d2 FROM (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, (a.s_suppkey % 10 - b.s_suppkey % 10) ** 2.0 + (a.s_suppkey // 10 - b.s_suppkey // 10) ** 2.0 AS d2, row_number() OVER (PARTITION BY a.s_suppkey, b.s_nationkey ORDER BY (a.s_suppkey % 10 - b.s_suppkey % 10) ** 2.0 + (a.s_suppkey // 10 - b.s_suppkey // 10) ** 2.0, b.s_suppkey) AS r FROM supplier a JOIN supplier b ON abs(a.s_nationkey - b.s_nationkey) = 1) WHERE r <= 2")
def slice_knn_any(spark: SparkSession, d: str) -> DataFrame:
    """The same however far they are."""
    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("spot"), F.col("s_nationkey").alias("z"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.expr("cast(s_suppkey div 10 as double)").alias("y"))
    return X.slice_neighbours(s, 2)


@query(B.with_views("counts spots", "SELECT src, dst, round(weight, 6) AS weight FROM (SELECT src, dst, weight FROM k UNION ALL SELECT dst, src, weight FROM k)", "pi AS (SELECT feature AS src, 1000000 + spot AS dst, umi / 1000.0 AS value FROM counts), t AS (SELECT *, max(value) OVER (PARTITION BY src) AS m FROM pi QUALIFY m > 1e-6 AND value >= m - 1e-6), k AS (SELECT src, dst, value / greatest(sum(value) OVER (PARTITION BY src), sum(value) OVER (PARTITION BY dst)) AS weight FROM t)"))
def align_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Best matches of features among spots, both ways."""
    pi = B.counts(spark, d).select(F.col("feature").alias("src"), (F.col("spot") + 1000000).alias("dst"), (F.col("umi") / 1000).alias("value"))
    return X.best_matches(pi).withColumn("weight", F.round("weight", 6))


_ELLIPSES = [(0, 4.0, 4.0, 3.0, 0.0, 0.0, 3.0), (1, 5.0, 5.0, 2.0, 0.5, 0.0, 1.5), (2, 3.0, 200.0, 4.0, 1.0, -1.0, 150.0)]


@query(B.with_views("spots", "SELECT spot, sample, coalesce(arg_min(e.clone, abs(l11 * l22 - l12 * l21)), -1) AS clone FROM spots s LEFT JOIN (VALUES (0, 4.0, 4.0, 3.0, 0.0, 0.0, 3.0), (1, 5.0, 5.0, 2.0, 0.5, 0.0, 1.5), (2, 3.0, 200.0, 4.0, 1.0, -1.0, 150.0)) e(clone, cx, cy, l11, l12, l21, l22) ON power((l22 * (x - cx) - l12 * (y - cy)) / (l11 * l22 - l12 * l21), 2) + power((l11 * (y - cy) - l21 * (x - cx)) / (l11 * l22 - l12 * l21), 2) <= 1 GROUP BY spot, sample"))
def clone_ellipse(spark: SparkSession, d: str) -> DataFrame:
    """The smallest ellipse around each spot."""
    e = spark.createDataFrame(_ELLIPSES, "clone int, cx double, cy double, l11 double, l12 double, l21 double, l22 double")
    return S.smallest_ellipse(B.spots(spark, d).select("spot", "sample", "x", "y"), e).select("spot", "sample", "clone")


@query(B.with_views("spots", "SELECT spot, segment, round(coalesce(1 - pi + pi * (a + b) / 2.0, 1.0), 6) AS rdr, round(coalesce(0.5 * (1 - pi) + pi * coalesce(least(a, b) / nullif(CAST(a + b AS DOUBLE), 0), 0.5) * (1 - pi + pi * (a + b) / 2.0), 0.5), 6) AS baf FROM (SELECT DISTINCT spot FROM ev) CROSS JOIN (SELECT unnest(range(30)) AS segment) LEFT JOIN (SELECT spot, segment, arg_max(purity, o) AS pi, arg_max(a, o) AS a, arg_max(b, o) AS b FROM (SELECT *, unnest(range(s // 100, CAST(ceil(e / 100.0) AS BIGINT))) AS segment FROM ev) GROUP BY ALL) USING (spot, segment)", "ev AS (SELECT spot, tumour AS purity, o, (spot * 37 + o * 911) % 2000 AS s, (spot * 37 + o * 911) % 2000 + 150 + 100 * o AS e, 1 + (spot + o) % 3 AS a, spot % 2 AS b FROM spots, (SELECT unnest([0, 1, 2]) AS o))"))
def cna_profile(spark: SparkSession, d: str) -> DataFrame:
    """Depth ratio and share of 30 segments under three events a spot."""
    ev = B.spots(spark, d).select("spot", F.col("tumour").alias("purity"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    start = (F.col("spot") * 37 + F.col("ordinal") * 911) % 2000
    ev = ev.select("spot", "purity", "ordinal", start.alias("start"), (start + 150 + 100 * F.col("ordinal")).alias("end"), (1 + (F.col("spot") + F.col("ordinal")) % 3).alias("a"), (F.col("spot") % 2).alias("b"))
    out = S.profiles(ev, spark.range(30).withColumnRenamed("id", "segment"), 100)
    return out.select("spot", "segment", F.round("rdr", 6).alias("rdr"), F.round("baf", 6).alias("baf"))


_NBP = "SELECT feature, spot, umi, base, base * 1.2 AS mu, sqrt(base * 1.2 + 0.2 * base * 1.2 * base * 1.2) AS sd FROM (SELECT feature, spot, umi, 1.0 + spot % 7 AS base FROM counts)"


@query(B.with_views("counts", f"SELECT feature, spot, round({_nb_sql('umi', 'mu * (mu / (sd * sd)) / (1 - mu / (sd * sd))', '(mu / (sd * sd))')}, 6) AS logp FROM ({_NBP})"))
def nb_logpmf(spark: SparkSession, d: str) -> DataFrame:
    """Negative binomial log-probabilities of counts."""
    base = 1.0 + F.col("spot") % 7
    mu = base * 1.2
    n, p = C.nb_params(mu, F.sqrt(mu + 0.2 * mu * mu))
    return B.counts(spark, d).select("feature", "spot", F.round(C.nb_logpmf(F.col("umi").cast("double"), n, p), 6).alias("logp"))


@query(B.with_views("chains", f"SELECT chain, t, round({_bb_sql('k', 'n', '6.25', '18.75')}, 6) + 0.0 AS logp, round({_bb_sql('k', 'n', '18.75', '6.25')}, 6) + 0.0 AS switched FROM chains"))
def bb_phase_switch(spark: SparkSession, d: str) -> DataFrame:
    """Beta-binomial log-probabilities under a phase and, from these, under the other."""
    k, n, a, b = F.col("k").cast("double"), F.col("n").cast("double"), F.lit(6.25), F.lit(18.75)
    one = C.bb_logpmf(k, n, a, b)
    return B.chains(spark, d).select("chain", F.col("t").cast("long").alias("t"), (F.round(one, 6) + 0.0).alias("logp"), (F.round(C.bb_switched(one, k, n, a, b), 6) + 0.0).alias("switched"))


@query(B.with_views("counts", f"SELECT feature, spot, round({_bb_sql('b', '(a + b)', '(2 + spot % 3 - 1.5)', '3.0')}, 6) + 0.0 AS logp FROM counts"))
def bb_logpmf(spark: SparkSession, d: str) -> DataFrame:
    """Beta-binomial log-probabilities of allele counts."""
    b, n = F.col("b").cast("double"), (F.col("a") + F.col("b")).cast("double")
    return B.counts(spark, d).select("feature", "spot", (F.round(C.bb_logpmf(b, n, 0.5 + F.col("spot") % 3, F.lit(3.0)), 6) + 0.0).alias("logp"))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Chains with read counts beside their allele counts."""
    return B.chains(spark, d).select("chain", "t", "k", F.col("n").alias("depth"), ((F.col("n") * 3 + F.col("t")) % 40).alias("umi"), (5.0 + F.col("t") % 9).alias("base"))


def _emission_sql(i: int, purity: str | None = None) -> str:
    """DuckDB log-emission of a state of ``THREE``; columns k, depth, umi, base."""
    rate = repr(math.exp(THREE.log_mu[i])) if purity is None else f"({purity} * {math.exp(THREE.log_mu[i])!r} + 1 - {purity})"
    share = repr(THREE.p[i]) if purity is None else f"({THREE.p[i]} * {purity} + 0.5 * (1 - {purity}))"
    mu = f"(base * {rate})"
    p = f"({mu} / ({mu} + {THREE.alpha[i]} * {mu} * {mu}))"
    nb = _nb_sql("umi", f"({mu} * {p} / (1 - {p}))", p)
    bb = _bb_sql("k", "depth", f"({share} * 30.0)", f"((1 - {share}) * 30.0)")
    return f"({nb} + {bb})"


_OBSERVED = "o AS (SELECT chain, t, k, n AS depth, (n * 3 + t) % 40 AS umi, 5.0 + t % 9 AS base FROM chains), e AS (SELECT *, " + ", ".join(f"{_emission_sql(i)} AS e{i}" for i in range(3)) + " FROM o)"


@query(B.with_views("chains", "SELECT chain, t, round(e0, 5) AS e0, round(e1, 5) AS e1, round(e2, 5) AS e2, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS state FROM e", _OBSERVED))
def state_emission_decode(spark: SparkSession, d: str) -> DataFrame:
    """Emissions of three states and the best of them."""
    rows = _observed(spark, d).withColumn("em", H.emission(THREE))
    return rows.select("chain", F.col("t").cast("long").alias("t"), *(F.round(F.col("em")[i], 5).alias(f"e{i}") for i in range(3)), H.decode_independent(F.col("em")).alias("state"))


@query(B.with_views("chains", "SELECT chain, t, " + ", ".join(f"round({_emission_sql(i, '((t % 10) / 10.0)')}, 5) AS e{i}" for i in range(3)) + " FROM o", _OBSERVED.split(", e AS")[0]))
def purity_emission(spark: SparkSession, d: str) -> DataFrame:
    """Emissions of mixtures of tumour and normal cells."""
    em = H.emission(THREE, purity=F.col("t") % 10 / 10)
    return _observed(spark, d).withColumn("em", em).select("chain", F.col("t").cast("long").alias("t"), *(F.round(F.col("em")[i], 5).alias(f"e{i}") for i in range(3)))


def _step_sql(j: int) -> str:
    terms = [f"(a{i} + {THREE.log_trans[i][j]!r})" for i in range(3)]
    top = f"greatest({', '.join(terms)})"
    return f"e{j} + {top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)})"


@query(B.with_views("chains", "SELECT chain, round(greatest(a0, a1, a2) + ln(exp(a0 - greatest(a0, a1, a2)) + exp(a1 - greatest(a0, a1, a2)) + exp(a2 - greatest(a0, a1, a2))), 4) AS llf FROM (SELECT *, max(t) OVER (PARTITION BY chain) AS m FROM f) WHERE t = m", _OBSERVED + ", f AS (SELECT chain, t, " + ", ".join(f"e{j} + {THREE.log_start[j]!r} AS a{j}" for j in range(3)) + " FROM e WHERE t = 1 UNION ALL SELECT e.chain, e.t, " + ", ".join(_step_sql(j) for j in range(3)) + " FROM f JOIN e ON e.chain = f.chain AND e.t = f.t + 1)", recursive=True))
def forward_llf(spark: SparkSession, d: str) -> DataFrame:
    """Forward log-likelihood of every chain."""
    return H.forward_llf(_observed(spark, d).withColumn("em", H.emission(THREE)), THREE, ["chain"]).withColumn("llf", F.round("llf", 4))



_SIX = range(6)


def _phased_step(terms: list[str]) -> str:
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def _phased_move(i: int, j: int, at: str) -> str:
    """Log transition between states of ``THREE`` in two phases, out of a row of table ``at``."""
    return f"({THREE.log_trans[i % 3][j % 3]!r} + {at}.{'stay' if i // 3 == j // 3 else 'turn'})"


_PHASED = (
    _OBSERVED.split(", e AS")[0]
    + ", oo AS (SELECT chain, t, k, depth, umi, base, false AS flip FROM o UNION ALL SELECT chain, t, depth - k, depth, umi, base, true FROM o)"
    + ", fe AS (SELECT chain, t, flip, " + ", ".join(f"{_emission_sql(i)} AS e{i}" for i in range(3)) + " FROM oo)"
    + ", pe AS (SELECT x.chain, x.t, ln(0.01 * (1 + x.t % 5)) AS turn, ln(1 - 0.01 * (1 + x.t % 5)) AS stay, x.e0, x.e1, x.e2, y.e0 AS e3, y.e1 AS e4, y.e2 AS e5 FROM fe x JOIN fe y ON y.chain = x.chain AND y.t = x.t AND y.flip WHERE NOT x.flip)"
    + ", pf AS (SELECT chain, t, turn, stay, " + ", ".join(f"e{j} + {THREE.log_start[j % 3]!r} + ln(0.5) AS a{j}" for j in _SIX) + " FROM pe WHERE t = 1"
    + " UNION ALL SELECT pe.chain, pe.t, pe.turn, pe.stay, " + ", ".join(f"pe.e{j} + " + _phased_step([f"(pf.a{i} + {_phased_move(i, j, 'pf')})" for i in _SIX]) for j in _SIX) + " FROM pf JOIN pe ON pe.chain = pf.chain AND pe.t = pf.t + 1)"
    + ", pm AS (SELECT chain, max(t) AS m FROM pe GROUP BY chain)"
    + ", pw AS (SELECT pe.*, " + ", ".join(f"0.0::DOUBLE AS b{j}" for j in _SIX) + " FROM pe JOIN pm ON pm.chain = pe.chain AND m = t"
    + " UNION ALL SELECT pe.*, " + ", ".join(_phased_step([f"({_phased_move(i, j, 'pe')} + pw.e{j} + pw.b{j})" for j in _SIX]) for i in _SIX) + " FROM pw JOIN pe ON pe.chain = pw.chain AND pe.t = pw.t - 1)"
    + ", pt AS (SELECT pf.chain, " + _phased_step([f"a{j}" for j in _SIX]) + " AS llf FROM pf JOIN pm ON pm.chain = pf.chain AND m = t)"
    + ", pg AS (SELECT pf.chain, pf.t, " + ", ".join(f"exp(a{j} + b{j} - llf) AS g{j}" for j in _SIX) + " FROM pf JOIN pw USING (chain, t) JOIN pt USING (chain))"
)
_PHASED_OUT = "SELECT chain, t, CAST(list_position([g0 + g3, g1 + g4, g2 + g5], greatest(g0 + g3, g1 + g4, g2 + g5)) - 1 AS INTEGER) AS state, round(g0 + g1 + g2, 5) AS in_phase FROM pg"


def _phases(spark: SparkSession, d: str, cut=None) -> DataFrame:
    """State with both phases together, and the probability of the first phase."""
    rows = _observed(spark, d).withColumn("em", H.emission(THREE, phased=True)).withColumn("switch", F.log(F.lit(0.01) * (1 + F.col("t") % 5)))
    g = F.transform("log_gamma", lambda x: F.exp(x))
    both = F.array(*(g[i] + g[i + 3] for i in range(3)))
    found = H.posteriors(rows, THREE, ["chain"], switch="switch", cut=cut)
    return found.select("chain", F.col("t").cast("long").alias("t"), (F.array_position(both, F.array_max(both)) - 1).cast("int").alias("state"), F.round(g[0] + g[1] + g[2], 5).alias("in_phase"))


@query(B.with_views("chains", _PHASED_OUT, _PHASED, recursive=True))
def phased_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Posterior state and phase where the phase may switch between rows."""
    return _phases(spark, d)


@query(B.with_views("chains", _PHASED_OUT, _PHASED, recursive=True))
def blocked_lattice(spark: SparkSession, d: str) -> DataFrame:
    """The same with every chain cut into blocks that a scan joins."""
    return _phases(spark, d, F.floor(F.col("t") / 16))


def _fitted(spark: SparkSession, kind: str, found) -> DataFrame:
    rows = spark.createDataFrame([(kind, i, float(a), float(b)) for i, (a, b) in enumerate(found)], "kind string, state int, location double, dispersion double")
    return rows.select("kind", "state", F.round("location", 4).alias("location"), F.round("dispersion", 3).alias("dispersion"))


def _psi(x: str) -> str:
    z = f"({x} + 8)"
    return f"(ln({z}) - 0.5 / {z} - 1 / ({z} * {z}) * (1 / 12.0 - 1 / ({z} * {z}) * (1 / 120.0 - 1 / ({z} * {z}) * (1 / 252.0 - 1 / ({z} * {z}) / 240.0))) - " + " - ".join(f"1 / ({x} + {k})" for k in range(8)) + ")"


def _psi1(x: str) -> str:
    z = f"({x} + 8)"
    return f"(1 / {z} + 0.5 / ({z} * {z}) + 1 / ({z} * {z} * {z}) * (1 / 6.0 - 1 / ({z} * {z}) * (1 / 30.0 - 1 / ({z} * {z}) * (1 / 42.0 - 1 / ({z} * {z}) / 30.0))) + " + " + ".join(f"1 / (({x} + {k}) * ({x} + {k}))" for k in range(8)) + ")"


#: Rows of one step of a fit in SQL, with columns l, d (logit or log mean, log dispersion), x, n, w: gradient gl, gd and curvature ll, ld, dd.
_BB_ROWS = (
    "SELECT *, t * f * (a1 - b1) AS gl, a * a1 + b * b1 + t * t1 AS gd, t * f * t * f * (a2 + b2) + t * f * (1 - 2 * p) * (a1 - b1) AS ll, t * f * (a * a2 - b * b2 + a1 - b1) AS ld, a * a * a2 + b * b * b2 + t * t * t2 + a * a1 + b * b1 + t * t1 AS dd FROM ("
    f"SELECT *, {_psi('(x + a)')} - {_psi('a')} AS a1, {_psi('(n - x + b)')} - {_psi('b')} AS b1, {_psi('t')} - {_psi('(n + t)')} AS t1, {_psi1('(x + a)')} - {_psi1('a')} AS a2, {_psi1('(n - x + b)')} - {_psi1('b')} AS b2, {_psi1('t')} - {_psi1('(n + t)')} AS t2 FROM ("
    "SELECT *, p * (1 - p) AS f, p * t AS a, (1 - p) * t AS b FROM (SELECT *, 1 / (1 + exp(-l)) AS p, exp(d) AS t FROM r JOIN st USING (state) WHERE it < 60)))"
)
_NB_ROWS = (
    "SELECT *, m1 * m AS gl, -r * r1 AS gd, m2 * m * m + m1 * m AS ll, -r * c * m AS ld, r * r * r2 + r * r1 AS dd FROM ("
    f"SELECT *, x / m - (x + r) / (r + m) AS m1, {_psi('(x + r)')} - {_psi('r')} + ln(r / (r + m)) + 1 - (x + r) / (r + m) AS r1, -x / (m * m) + (x + r) / ((r + m) * (r + m)) AS m2, -1 / (r + m) + (x + r) / ((r + m) * (r + m)) AS c, {_psi1('(x + r)')} - {_psi1('r')} + 1 / r - 2 / (r + m) + (x + r) / ((r + m) * (r + m)) AS r2 FROM ("
    "SELECT *, n * exp(l) AS m, exp(-d) AS r FROM r JOIN st USING (state) WHERE it < 60))"
)


def _newton_sql(source: str, views: str, more: str, rows: str, kinds: list[str], start: tuple[float, float], back: str) -> str:
    """Parameters after sixty plain Newton steps in SQL; ``source``: rows (state, x, n, w). Curvatures count as negative, steps as one at most."""
    step = lambda v: f"greatest(-1, least(1, {v}))"
    blocks = " UNION ALL ".join(f"SELECT '{k}' AS kind, state, {'state' if k == 'free' else '0'} AS block FROM (SELECT unnest([0, 1]) AS state)" for k in kinds)
    return B.with_views(views, f"SELECT kind, CAST(state AS INTEGER) AS state, round({back}, 4) AS location, round(exp(d), 3) AS dispersion FROM r WHERE it = 60", (
        f"{more}st AS MATERIALIZED ({source}), r AS (SELECT 0 AS it, kind, state, block, {start[0]!r}::DOUBLE AS l, {start[1]!r}::DOUBLE AS d FROM ({blocks})"
        f" UNION ALL SELECT it + 1, kind, state, block, l + {step('-(gl + ld * dd) / ll')}, d + dd FROM ("
        f"SELECT it, kind, state, block, l, d, gl, ll, ld, {step('-sum(gd - ld * gl / ll) OVER w / (-abs(sum(dd - ld * ld / ll) OVER w))')} AS dd FROM ("
        f"SELECT it, kind, state, block, l, d, sum(w * gl) AS gl, sum(w * gd) AS gd, -abs(sum(w * ll)) AS ll, sum(w * ld) AS ld, sum(w * dd) AS dd FROM ({rows}) GROUP BY it, kind, state, block, l, d) WINDOW w AS (PARTITION BY it, kind, block)))"
    ), recursive=True)


@query(_newton_sql("SELECT chain % 2 AS odd, 1 - chain % 2 AS state, CAST(k AS DOUBLE) AS x, CAST(n AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS w FROM chains GROUP BY ALL", "chains", "", _BB_ROWS, ["free", "shared"], (0.0, 3.0), "1 / (1 + exp(-l))"))
def bb_fit(spark: SparkSession, d: str) -> DataFrame:
    """Beta-binomial parameters of two weightings, dispersion free and shared."""
    rows = B.chains(spark, d)
    w = F.array((F.col("chain") % 2).cast("double"), 1.0 - F.col("chain") % 2)
    stats = FIT.compressed(rows, F.col("k").cast("double"), F.col("n"), w, 2).persist()
    import numpy as np

    start = np.array([[0.5, 20.0]] * 2)
    out = _fitted(spark, "free", FIT.maximise(stats, "bb", start, shared=False)).unionByName(_fitted(spark, "shared", FIT.maximise(stats, "bb", start, shared=True)))
    stats.unpersist()
    return out


@query(_newton_sql("SELECT 1 - chain % 2 AS state, CAST(umi AS DOUBLE) AS x, base AS n, CAST(count(*) AS DOUBLE) AS w FROM o GROUP BY ALL", "chains", _OBSERVED.split(", e AS")[0] + ", ", _NB_ROWS, ["free"], (0.5, -2.0), "l"))
def nb_fit(spark: SparkSession, d: str) -> DataFrame:
    """Negative binomial parameters of two weightings."""
    rows = _observed(spark, d)
    w = F.array((F.col("chain") % 2).cast("double"), 1.0 - F.col("chain") % 2)
    stats = FIT.compressed(rows, F.col("umi").cast("double"), F.col("base"), w, 2).persist()
    import numpy as np

    out = _fitted(spark, "free", FIT.maximise(stats, "nb", np.array([[0.1, 0.01]] * 2), shared=False))
    stats.unpersist()
    return out


@query(B.with_views("chains", "SELECT CAST(t % 3 AS INTEGER) AS part, " + ", ".join(f"round(sum({c}), 3) AS {c}" for c in ("gl", "gd", "ll", "ld", "dd")) + " FROM (" + _BB_ROWS + ") GROUP BY t_ % 3", "st AS (SELECT 0 AS state, t AS t_, CAST(k AS DOUBLE) AS x, CAST(n AS DOUBLE) AS n FROM chains), r AS (SELECT 0 AS it, 0 AS state, -0.5::DOUBLE AS l, 1.5::DOUBLE AS d)").replace("CAST(t % 3 AS INTEGER) AS part", "CAST(t_ % 3 AS INTEGER) AS part"))
def bb_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Gradient and curvature of beta-binomial likelihoods, by digamma and trigamma as columns."""
    k, n, p, t = F.col("k").cast("double"), F.col("n").cast("double"), F.lit(1 / (1 + math.exp(0.5))), F.lit(math.exp(1.5))
    a, b, f = p * t, (1 - p) * t, p * (1 - p)
    first = {"a1": C.digamma(k + a) - C.digamma(a), "b1": C.digamma(n - k + b) - C.digamma(b), "t1": C.digamma(t) - C.digamma(n + t), "a2": C.trigamma(k + a) - C.trigamma(a), "b2": C.trigamma(n - k + b) - C.trigamma(b), "t2": C.trigamma(t) - C.trigamma(n + t)}
    rows = B.chains(spark, d).select((F.col("t") % 3).cast("int").alias("part"), *(v.alias(c) for c, v in first.items()))
    a1, b1, t1, a2, b2, t2 = (F.col(c) for c in first)
    gd = a * a1 + b * b1 + t * t1
    terms = {"gl": t * f * (a1 - b1), "gd": gd, "ll": t * f * t * f * (a2 + b2) + t * f * (1 - 2 * p) * (a1 - b1), "ld": t * f * (a * a2 - b * b2 + a1 - b1), "dd": a * a * a2 + b * b * b2 + t * t * t2 + gd}
    return rows.groupBy("part").agg(*(F.round(F.sum(v), 3).alias(c) for c, v in terms.items()))


@query()
def baum_welch(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of three states after a whole fit."""
    states, trail = H.baum_welch(_observed(spark, d), THREE, ["chain"])
    return spark.createDataFrame([(i, states.log_mu[i], states.alpha[i], states.p[i], states.tau[i], trail[-1]) for i in range(3)], "state int, log_mu double, alpha double, p double, tau double, llf double")


@query()
def gmm_init(spark: SparkSession, d: str) -> DataFrame:
    """Start values of three states from a Gaussian mixture, and by careful seeding."""
    rows = [(kind, i, float(s.log_mu[i]), float(s.p[i])) for kind, s in (("mixture", H.gmm_states(_observed(spark, d), 3)), ("seeding", H.spread_states(_observed(spark, d), 3))) for i in range(3)]
    return spark.createDataFrame(rows, "kind string, state int, log_mu double, p double")


_STEP = (
    _OBSERVED.split(", e AS")[0]
    + ", cl AS (SELECT round(least(umi / base, 20.0) / 0.05) * 0.05 AS rdr, round(least(greatest(k / depth, 0.1), 0.9) / 0.01) * 0.01 AS baf, count(*) AS n FROM o GROUP BY ALL)"
    ", g0 AS (SELECT unnest([0, 1, 2]) AS state, unnest([1.0, 3.0, 5.0]) AS mx, unnest([0.5, 0.3, 0.7]) AS my)"
    ", lg AS (SELECT rdr, baf, n, state, exp(-0.5 * (power(rdr - mx, 2) / 2.0 + power(baf - my, 2) / 0.05)) AS d FROM cl, g0)"
    ", rs AS (SELECT *, n * d / sum(d) OVER (PARTITION BY rdr, baf) AS h FROM lg)"
)


@query(B.with_views("chains", "SELECT CAST(state AS INTEGER) AS state, round(sum(h) / (SELECT sum(n) FROM cl), 6) AS weight, round(sum(h * rdr) / sum(h), 5) AS rdr, round(sum(h * baf) / sum(h), 6) AS baf, round(sum(h * rdr * rdr) / sum(h) - power(sum(h * rdr) / sum(h), 2) + 0.0001, 4) AS spread_rdr, round(sum(h * rdr * baf) / sum(h) - sum(h * rdr) / sum(h) * sum(h * baf) / sum(h), 5) AS spread_both FROM rs GROUP BY state", _STEP))
def mixture_step(spark: SparkSession, d: str) -> DataFrame:
    """One step of a Gaussian mixture over cells, from a fixed start."""
    import numpy as np

    cells = np.array([tuple(r) for r in H.mixture_cells(_observed(spark, d)).orderBy("rdr", "baf").collect()], float)  # a bounded grid
    weight, mean, cov, _ = H.mixture_step(cells[:, :2], cells[:, 2], np.full(3, 1 / 3), np.array([[1.0, 0.5], [3.0, 0.3], [5.0, 0.7]]), np.array([np.diag([2.0, 0.05])] * 3))
    rows = [(i, *map(float, (weight[i], *mean[i], cov[i, 0, 0], cov[i, 0, 1]))) for i in range(3)]
    found = spark.createDataFrame(rows, "state int, weight double, rdr double, baf double, spread_rdr double, spread_both double")
    return found.select("state", *(F.round(c, n).alias(c) for c, n in (("weight", 6), ("rdr", 5), ("baf", 6), ("spread_rdr", 4), ("spread_both", 5))))


@query()
def initial_phase(spark: SparkSession, d: str) -> DataFrame:
    """Phase and segments of blocks from a first fit of each clone."""
    return P.initial_phase(P.clone_observations(_in_blocks(spark, d), B.spots(spark, d)), k=3, least=200)


@query(B.with_views("counts genome spots", "SELECT src AS spot, clone, round(sum(llf), 3) AS llf FROM (SELECT q.src, st.clone, q.ratio * " + _nb_sql("q.umi", "(m * pp / (1 - pp))", "pp") + " + CASE WHEN q.depth > 0 THEN " + _bb_sql("q.k", "q.depth", "(q.p * 30.0)", "((1 - q.p) * 30.0)") + " ELSE 0 END AS llf FROM (SELECT q.*, st.clone, st.p, base * st.rate AS m, (base * st.rate) / (base * st.rate + 0.1 * base * st.rate * base * st.rate) AS pp FROM pooled q JOIN paths st USING (bin)) q JOIN (SELECT DISTINCT clone FROM paths) st ON st.clone = q.clone) GROUP BY src, clone", _IN_BLOCKS + ", cb AS (SELECT spot, chr AS bin, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(b) AS BIGINT) AS k, CAST(sum(a + b) AS BIGINT) AS depth, CAST(10 + chr AS DOUBLE) AS base FROM cells GROUP BY spot, chr), ed AS (SELECT a.spot AS src, b.spot AS dst FROM spots a JOIN spots b ON a.sample = b.sample AND 9 * (a.x - b.x) * (a.x - b.x) + 3 * (a.y - b.y) * (a.y - b.y) <= 12), pooled AS (SELECT src, bin, sum(umi) AS umi, sum(base) AS base, sum(k) AS k, sum(depth) AS depth, any_value(ratio) AS ratio FROM ed JOIN cb ON cb.spot = ed.dst JOIN (SELECT src, CASE WHEN count(*) FILTER (depth > 0) > 0 THEN count(*) FILTER (depth > 0) / CAST(count(*) AS DOUBLE) ELSE 1.0 END AS ratio FROM ed JOIN cb ON cb.spot = ed.dst GROUP BY src) USING (src) GROUP BY src, bin), paths AS (SELECT clone, bin, CAST([0.5, 0.3, 0.15][1 + (clone + bin) % 3] AS DOUBLE) AS p, CAST([1.0, 1.3498588075760032, 0.6703200460356393][1 + (clone + bin) % 3] AS DOUBLE) AS rate FROM (SELECT unnest([0, 1, 2]) AS clone), (SELECT DISTINCT bin FROM cb))"))
def spot_llf(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of each spot's neighbourhood under three clones' paths."""
    counts, edges, decoded = _field(spark, d)
    return R.spot_llf(counts, edges, decoded, R.states_table(spark, THREE)).withColumn("llf", F.round("llf", 3))


def _field(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts per chromosome, pooling edges with self, and fixed paths of three clones."""
    counts = _in_blocks(spark, d).groupBy("spot", F.col("chr").alias("bin")).agg(F.sum("umi").alias("umi"), F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth")).withColumn("base", 10.0 + F.col("bin"))
    counts, spots = keep(counts), B.spots(spark, d)  # all that follows reads sums by spot, not lines
    edges = keep(X.adjacency(spots).select("src", "dst").unionByName(spots.select(F.col("spot").alias("src"), F.col("spot").alias("dst"))))
    bins = counts.select("bin").distinct()
    decoded = bins.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("clone"), "bin").withColumn("state", ((F.col("clone") + F.col("bin")) % 3).cast("int"))
    return counts, edges, decoded


def icm_sql(edges: str, final: str, tol: float = 0.1, raw: str | None = None) -> str:
    """DuckDB query that visits spot after spot until a sweep changes too few; ``edges``: rows (src, dst, w), ``final``: columns of the last state, ``raw``: query for (spot, clone, llf)."""
    raw = raw or ORACLE["spot_llf"].replace("round(sum(llf), 3)", "sum(llf)")
    prior = "cw AS (SELECT sample, clone, CASE WHEN n > 0 THEN ln(n / sum(n) OVER (PARTITION BY sample)) ELSE -50.0 END AS w FROM (SELECT sample, c.clone, (SELECT count(*) FROM spots z WHERE z.sample = s.sample AND z.clone = c.clone) AS n FROM (SELECT DISTINCT sample FROM spots) s, (SELECT unnest([0, 1, 2]) AS clone) c))"
    return B.with_views("spots", f"SELECT {final} FROM last, ix ORDER BY ix.spot", (
        f"raw AS ({raw}), {_PAIRS}, ed AS ({edges}), {prior}"
        ", sc AS (SELECT spot, sample, any_value(s.clone) AS label, list(llf + w - lse ORDER BY raw.clone) AS score FROM raw JOIN spots s USING (spot) JOIN cw USING (sample) JOIN (SELECT sample, ln(sum(exp(w))) AS lse FROM cw GROUP BY sample) USING (sample) WHERE cw.clone = raw.clone GROUP BY spot, sample)"
        ", ix AS MATERIALIZED (SELECT row_number() OVER (ORDER BY spot) AS i, * FROM sc), nn AS (SELECT count(*) AS n FROM ix)"
        ", nb AS MATERIALIZED (SELECT a.i, list({'j': b.i, 'w': w}) AS near FROM ed JOIN ix a ON a.spot = src JOIN ix b ON b.spot = dst WHERE src <> dst GROUP BY a.i)"
        ", r AS (SELECT 0 AS step, 0::BIGINT AS i, (SELECT list(label + 1 ORDER BY i) FROM ix) AS l, 0::BIGINT AS edits"
        " UNION ALL SELECT step + 1, k, list_transform(l, lambda x, q: CASE WHEN q = k THEN new ELSE x END), CASE WHEN k = 1 THEN 0 ELSE edits END + CASE WHEN l[k] <> new THEN 1 ELSE 0 END FROM"
        " (SELECT step, k, l, edits, list_position(cost, list_max(cost)) AS new FROM (SELECT step, ix.i AS k, l, edits, list_transform(score, lambda v, c: v + coalesce(list_sum(list_transform(near, lambda m: CASE WHEN l[m.j] = c THEN m.w ELSE 0.0 END)), 0.0)) AS cost"
        f" FROM r, nn JOIN ix ON ix.i = r.i % nn.n + 1 LEFT JOIN nb ON nb.i = ix.i WHERE NOT (r.i = nn.n AND edits < {tol} * nn.n))))"
        ", last AS (SELECT arg_max(l, step) AS l FROM r)"
    ), recursive=True)


_NEAR = "SELECT src, dst, exp(-power(d2 / 36, 5)) AS w FROM p WHERE exp(-power(d2 / 36, 5)) > 1e-4"
_LABEL = "ix.sample, ix.spot, CAST(l[ix.i] - 1 AS INTEGER) AS label"


def _fixed_field(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spot likelihoods under fixed paths, present labels, and log shares of clones."""
    counts, edges, decoded = _field(spark, d)
    spots = B.spots(spark, d)
    llf = keep(R.spot_llf(counts, edges, decoded, R.states_table(spark, THREE)))
    prior = A.clone_log_weights(spots, spark.range(3).select(F.col("id").cast("int").alias("clone")))
    return llf, spots.select("sample", "spot", F.col("clone").alias("label")), prior


@query(icm_sql(_NEAR, _LABEL))
def icm_labels(spark: SparkSession, d: str) -> DataFrame:
    """Clone labels of spots after conditional-mode sweeps."""
    llf, labels, prior = _fixed_field(spark, d)
    return R.icm(llf, X.weighted_adjacency(B.spots(spark, d), 36.0), labels, log_prior=prior).select("sample", "spot", "label")


def slice_links(spots: DataFrame) -> DataFrame:
    """(src, dst, weight): links both ways between spots a row apart, samples aside."""
    up = spots.alias("a").join(spots.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") + 1 == F.col("b.y"))).select(F.col("a.spot").alias("src"), F.col("b.spot").alias("dst"), F.lit(0.25).alias("weight"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


_LINKS = "SELECT src, dst, sum(w) AS w FROM (" + _NEAR + " UNION ALL SELECT a.spot, b.spot, 0.25 FROM spots a JOIN spots b ON a.x = b.x AND a.y + 1 = b.y UNION ALL SELECT b.spot, a.spot, 0.25 FROM spots a JOIN spots b ON a.x = b.x AND a.y + 1 = b.y) GROUP BY src, dst"


@query(icm_sql(_LINKS, _LABEL, 1e-9))
def icm_slices(spark: SparkSession, d: str) -> DataFrame:
    """Clone labels where links between samples count like those within, swept until nothing changes."""
    llf, labels, prior = _fixed_field(spark, d)
    spots = B.spots(spark, d)
    return R.icm(llf, X.with_links(X.weighted_adjacency(spots, 36.0), slice_links(spots)), labels, tol=1e-9, log_prior=prior).select("sample", "spot", "label")


@query()
def hmrf_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Labels after rounds of model and labelling, until they agree."""
    counts = P.bins_with_baseline(_in_blocks(spark, d), B.spots(spark, d))
    spots = B.spots(spark, d)
    pool, couple = X.adaptive_graph(spots)
    labels, _, _ = R.hmrf_loop(counts, pool, couple, spots.select("sample", "spot", F.col("clone").alias("label")), k=3, rounds=20, em_rounds=30)
    return labels


_CLONE_LLF = "cl AS (SELECT s.clone, c.chr AS bin, CAST(sum(b) AS BIGINT) AS k, CAST(sum(a + b) AS BIGINT) AS depth FROM cells c JOIN spots s USING (spot) GROUP BY ALL), st AS (SELECT unnest([0, 1, 2]) AS state, unnest([0.5, 0.3, 0.15]) AS p), lf AS (SELECT clone, bin, state, CASE WHEN depth > 0 THEN " + _bb_sql("k", "depth", "(p * 30.0)", "((1 - p) * 30.0)") + " ELSE 0 END AS llf FROM cl, st), own AS (SELECT clone, bin, state, llf FROM lf WHERE state = (clone + bin) % 3)"


def _clone_llf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bulk = _in_blocks(spark, d).join(B.spots(spark, d).select("spot", "clone"), "spot").groupBy("clone", F.col("chr").alias("bin")).agg(F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth"))
    rows = bulk.select("clone", "bin", F.posexplode(H.emission(THREE, reads=False)).alias("state", "llf"))
    return rows, bulk.select("clone", "bin", ((F.col("clone") + F.col("bin")) % 3).cast("int").alias("state"))


@query(B.with_views("counts genome spots", "SELECT x.clone AS c1, y.clone AS c2, x.state AS s1, y.state AS s2, count(*) AS n, round(avg((x.llf - sx.llf + y.llf - sy.llf) / 2), 4) AS t FROM own x JOIN own y ON x.bin = y.bin AND x.clone < y.clone AND x.state <> y.state JOIN lf sx ON sx.clone = x.clone AND sx.bin = x.bin AND sx.state = y.state JOIN lf sy ON sy.clone = y.clone AND sy.bin = y.bin AND sy.state = x.state GROUP BY ALL", _IN_BLOCKS + ", " + _CLONE_LLF))
def clone_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each pair of clones and states."""
    return R.similarity_statistics(*_clone_llf(spark, d)).withColumn("t", F.round("t", 4))


@query()
def similar_clone_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of clones alike, and paths with similar states combined."""
    rows, decoded = _clone_llf(spark, d)
    stats = [tuple(r) for r in R.similarity_statistics(rows, decoded).collect()]  # a row for each pair of clones and of states
    depth = {r[0]: r[1] for r in _in_blocks(spark, d).join(B.spots(spark, d), "spot").groupBy("clone").agg(F.sum(F.col("a") + F.col("b"))).collect()}
    groups = R.merge_groups(stats, sorted(depth), threshold=1.0, least_bins=3)
    merged = spark.createDataFrame([(c, g) for g, members in enumerate(groups) for c in members], "clone int, grp int")
    return R.combine_similar_states(decoded, stats, depth, threshold=0.5).join(F.broadcast(merged), "clone").select("clone", "grp", "bin", "state")


@query(B.with_views("counts spots", "SELECT spot, CASE WHEN ok THEN label ELSE target END AS label FROM l JOIN z USING (label), (SELECT arg_max(label, CASE WHEN ok THEN 1e15 ELSE 0 END + n) AS target FROM z)", "l AS (SELECT spot, CASE WHEN spot % 5 = 0 THEN 7 ELSE clone END AS label FROM spots), z AS (SELECT label, count(*) >= 3 AND sum(n) >= 20 AND label <> 7 AND count(*) > (SELECT count(*) // 5 FROM spots) AS ok, sum(n) AS n FROM l JOIN (SELECT spot, sum(umi) AS n FROM counts GROUP BY spot) USING (spot) GROUP BY label)"))
def merge_small_clones(spark: SparkSession, d: str) -> DataFrame:
    """Clones of a fifth of the spots or fewer join the deepest one."""
    labels = B.spots(spark, d).select("spot", F.when(F.col("spot") % 5 == 0, 7).otherwise(F.col("clone")).alias("label"))
    totals = B.counts(spark, d).groupBy("spot").agg(F.sum("umi").alias("n"))
    return R.merge_small_clones(labels, totals, labels.count() // 5 + 1, 20)


@query(B.with_views("counts genome spots", "SELECT spot, new AS label FROM spots JOIN (SELECT clone, row_number() OVER (ORDER BY clone <> (SELECT arg_min(clone, o) FROM off), clone) - 1 AS new FROM off) USING (clone)", _IN_BLOCKS + ", off AS (SELECT clone, sum(greatest(abs(baf - 0.5) - 0.05, 0)) AS o FROM (SELECT clone, chr, sum(b) / nullif(CAST(sum(a + b) AS DOUBLE), 0) AS baf FROM cells JOIN spots USING (spot) GROUP BY ALL) GROUP BY clone)"))
def reindex_normal(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the most balanced clone as 0."""
    spots = B.spots(spark, d)
    shares = _in_blocks(spark, d).join(spots.select("spot", "clone"), "spot").groupBy("clone", "chr").agg((F.sum("b") / F.nullif(F.sum(F.col("a") + F.col("b")).cast("double"), F.lit(0.0))).alias("baf"))
    return R.reindex_normal(spots.select("spot", F.col("clone").alias("label")), shares).select("spot", F.col("label").cast("long").alias("label"))



@query()
def bin_filter_bb(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose allele share fits a balanced genome."""
    obs = _in_blocks(spark, d).groupBy((F.col("chr") * 1000 + F.col("block")).alias("bin")).agg(F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth"))
    return R.normal_bins(obs)


@query()
def diffexp_filter(spark: SparkSession, d: str) -> DataFrame:
    """Genes that differ between normal-like and other spots."""
    return R.differential_genes(B.counts(spark, d), B.spots(spark, d).where("clone = 0").select("spot"))



_STATES_SQL = "sx AS (SELECT chain % 4 AS clone, CAST(t % 3 AS INTEGER) AS state, count(*) AS bins, CAST((avg(n) - 50) / 200 AS DOUBLE) AS log_mu, CAST(sum(k) / sum(n) AS DOUBLE) AS p FROM chains GROUP BY ALL)"


def _state_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.chains(spark, d).groupBy((F.col("chain") % 4).cast("int").alias("clone"), (F.col("t") % 3).cast("int").alias("state")).agg(F.count(F.lit(1)).alias("bins"), ((F.avg("n") - 50) / 200).alias("log_mu"), (F.sum("k") / F.sum("n")).alias("p"))


@query(B.with_views("chains", "SELECT CAST(clone AS INTEGER) AS clone, arg_min(state, log_mu) AS state FROM sx JOIN (SELECT clone, sum(bins) AS total FROM sx GROUP BY clone) USING (clone) WHERE bins >= 0.1 * total AND abs(p - 0.5) <= 0.05 GROUP BY clone", _STATES_SQL))
def diploid_state(spark: SparkSession, d: str) -> DataFrame:
    """The diploid state of each clone."""
    return N.diploid_state(_state_rows(spark, d))


@query()
def integer_copy(spark: SparkSession, d: str) -> DataFrame:
    """Integer copies of each clone's states: free, and with the diploid state fixed."""
    rows = _state_rows(spark, d)
    rows = N.adjusted_log_mu(rows, rows.select("clone", "state", F.col("bins").cast("double").alias("weight")))
    free = N.integer_copies(rows).withColumn("kind", F.lit("free"))
    fixed = N.integer_copies(rows, diploid=N.diploid_state(rows), restarts=20).withColumn("kind", F.lit("fixed"))
    return free.unionByName(fixed).withColumn("colour", C.copy_colour(F.col("a"), F.col("b")))


_LATTICE = "l AS (SELECT i AS node, i % 12 AS x, i // 12 AS y FROM range(96) r(i))"


@query(f"WITH {_LATTICE} SELECT a.node AS src, b.node AS dst, round(CAST(a.x AS DOUBLE) + CAST(a.y AS DOUBLE) / 2, 6) AS px, round(a.y * sqrt(3.0) / 2, 6) AS py FROM l a JOIN l b ON (b.x - a.x, b.y - a.y) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))")
def lattice_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a 12 x 8 lattice with the positions of their starts."""
    at = X.lattice(spark, 12, 8).select(F.col("node").alias("src"), F.round("x", 6).alias("px"), F.round("y", 6).alias("py"))
    return X.lattice_edges(spark, 12, 8).join(at, "src").select("src", "dst", "px", "py")


@query("SELECT l_partkey AS src, l_suppkey AS dst, min(l_discount) AS weight, max(l_discount) - min(l_discount) > 1e-12 AS conflict FROM lineitem GROUP BY ALL")
def edge_upsert_check(spark: SparkSession, d: str) -> DataFrame:
    """Edges once each, with conflicts of weights."""
    return X.upsert_edges(B.read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("weight")))


@query(B.with_views("spots", "SELECT round((SELECT coalesce(sum(CASE WHEN a.clone <> b.clone THEN 0.5 + (p.src % 3) * 0 ELSE 0 END), 0) FROM p JOIN spots a ON a.spot = p.src JOIN spots b ON b.spot = p.dst WHERE p.d2 <= 36 AND p.src < p.dst) * 2 - (SELECT sum(tumour) FROM spots), 6) AS energy", _PAIRS))
def potts_energy(spark: SparkSession, d: str) -> DataFrame:
    """Energy of the clone labels on the spot graph."""
    spots = B.spots(spark, d)
    edges = X.adjacency(spots, 3.0).select("src", "dst", F.lit(0.5).alias("weight"))
    labels = spots.select(F.col("spot").alias("node"), F.col("clone").alias("label"))
    field = spots.select(F.col("spot").alias("node"), F.col("clone").alias("label"), F.col("tumour").alias("h"))
    return X.potts_energy(edges, labels, 2.0, field).select(F.round("energy", 6).alias("energy"))



@query()
def metropolis(spark: SparkSession, d: str) -> DataFrame:
    """Labels after Metropolis sweeps, and after greedy learning, from random ones."""
    spots = B.spots(spark, d)
    edges = X.adjacency(spots, 3.0).select("src", "dst", F.lit(1.0).alias("weight"))
    nodes = X.random_labels(spots.select("sample", F.col("spot").alias("node"), "tumour"), 3).select("sample", "node", "label", F.array(F.col("tumour"), F.lit(0.2), F.lit(0.1)).alias("h"))
    a = S.metropolis(nodes, edges, 3, sweeps=3).withColumn("kind", F.lit("metropolis"))
    return a.unionByName(S.learn_labels(nodes, edges, 3).withColumn("kind", F.lit("greedy")))


@query()
def random_clones(spark: SparkSession, d: str) -> DataFrame:
    """Spots dealt to three clones by random rectangles."""
    return S.random_rectangles(B.spots(spark, d).drop("clone"), 3).select("spot", "sample", "clone")


@query("WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), up AS (SELECT id AS leaf, id AS ancestor, 0 AS depth FROM n WHERE id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL) UNION ALL SELECT leaf, parent, depth + 1 FROM up JOIN n ON n.id = up.ancestor WHERE parent IS NOT NULL) SELECT leaf, ancestor, depth FROM up")
def phylogeny_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of every leaf of a binary tree."""
    return S.lineages(spark, B.genome(spark, d).select(F.col("feature").alias("id"), F.when(F.col("feature") > 1, F.expr("feature div 2")).alias("parent")))


@query()
def simulate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Simulated counts of every spot under the leaves of a grown tree."""
    return P.simulated(spark, B.spots(spark, d), segments=60, seed=1)


@query(B.with_views("spots", "SELECT spot, round(CASE WHEN s < 0 OR s - 2.5 < 0 THEN 0 ELSE power(s - 2.5, 1.25) END, 6) AS field FROM (SELECT spot, (x * 3 + y * 4) / 5 AS s FROM spots)"))
def power_law_field(spark: SparkSession, d: str) -> DataFrame:
    """A field that grows along a direction."""
    return B.spots(spark, d).select("spot", F.round(C.power_law_field(F.col("x"), F.col("y"), (3.0, 4.0), 1.25), 6).alias("field"))


@query(B.with_views("counts genome spots", "SELECT chr, block, max(CASE WHEN clone = 0 THEN umi END) AS umi_0, max(CASE WHEN clone = 1 THEN umi END) AS umi_1, max(CASE WHEN clone = 2 THEN umi END) AS umi_2, CAST(sum(a + b) AS BIGINT) AS depth FROM (SELECT clone, chr, block, CAST(sum(umi) AS BIGINT) AS umi, sum(a) AS a, sum(b) AS b FROM cells JOIN spots USING (spot) GROUP BY ALL) GROUP BY chr, block", _IN_BLOCKS))
def cnv_report(spark: SparkSession, d: str) -> DataFrame:
    """Clones side by side for every block."""
    bulk = pseudobulk_rows(spark, d)
    wide = bulk.groupBy("chr", "block").pivot("clone", [0, 1, 2]).agg(F.sum("umi"))
    depth = bulk.groupBy("chr", "block").agg(F.sum(F.col("a") + F.col("b")).alias("depth"))
    return wide.join(depth, ["chr", "block"]).select("chr", "block", *(F.col(str(c)).alias(f"umi_{c}") for c in range(3)), "depth")


@query()
def inferred_clones(spark: SparkSession, d: str) -> DataFrame:
    """The whole inference on simulated genomes of all spots: planted and inferred clone of each."""
    return P.round_trip(spark, B.spots(spark, d), seed=3)


from . import catalogue_more  # noqa: E402, F401  registers its queries
