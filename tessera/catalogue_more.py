"""More registered queries: purity and phase variants, final labels, reports, graphs between slices, and lattices in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _CLONE_LLF, _IN_BLOCKS, _NEAR as NEAR, _OBSERVED, _PAIRS, _STATES_SQL, _state_rows, BLOCK, ORACLE, THREE, _bb_sql, _blocks, _field, _in_blocks, _nb_sql, _observed, _reads, _step_sql, icm_sql, query, slice_links
from .functions import columns as C
from .operators import aggregate as A
from .operators import copynumber as N
from .operators import graph as X
from .operators import hmm as H
from .operators import hmrf as R
from .operators import plots as PLOT
from .operators.storage import keep
from .plans import bindings as B
from .sources import readers

K = range(3)


def _lse_sql(terms: list[str]) -> str:
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def _back_sql(i: int) -> str:
    return _lse_sql([f"({THREE.log_trans[i][j]!r} + bw.e{j} + bw.b{j})" for j in K])


#: Forward and backward sums of every chain, and from them posteriors g0 to g2.
_LATTICE = (
    _OBSERVED
    + ", f AS (SELECT chain, t, " + ", ".join(f"e{j} + {THREE.log_start[j]!r} AS a{j}" for j in K) + " FROM e WHERE t = 1"
    + " UNION ALL SELECT e.chain, e.t, " + ", ".join(_step_sql(j) for j in K) + " FROM f JOIN e ON e.chain = f.chain AND e.t = f.t + 1)"
    + ", ends AS (SELECT chain, max(t) AS m FROM e GROUP BY chain)"
    + ", bw AS (SELECT e.chain, e.t, e0, e1, e2, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM e JOIN ends ON ends.chain = e.chain AND m = t"
    + " UNION ALL SELECT e.chain, e.t, e.e0, e.e1, e.e2, " + ", ".join(_back_sql(i) for i in K) + " FROM bw JOIN e ON e.chain = bw.chain AND e.t = bw.t - 1)"
    + ", total AS (SELECT f.chain, " + _lse_sql([f"a{j}" for j in K]) + " AS llf FROM f JOIN ends ON ends.chain = f.chain AND m = t)"
    + ", post AS (SELECT f.chain, f.t, a0, a1, a2, b0, b1, b2, bw.e0, bw.e1, bw.e2, llf, " + ", ".join(f"exp(a{j} + b{j} - llf) AS g{j}" for j in K) + " FROM f JOIN bw USING (chain, t) JOIN total USING (chain))"
)


@query(B.with_views("chains", "SELECT chain, t, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS state, round(greatest(g0, g1, g2), 6) AS posterior FROM post", _LATTICE, recursive=True))
def posterior_decode(spark: SparkSession, d: str) -> DataFrame:
    """Posterior state of every row."""
    post = H.posteriors(_observed(spark, d).withColumn("em", H.emission(THREE)), THREE, ["chain"])
    return post.select("chain", F.col("t").cast("long").alias("t"), "state", F.round(F.exp(F.array_max("log_gamma")), 6).alias("posterior"))


@query(B.with_views("chains", "SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS state, round(ln(unnest([s0, s1, s2]) / (s0 + s1 + s2)), 6) AS log_p FROM (SELECT sum(g0) AS s0, sum(g1) AS s1, sum(g2) AS s2 FROM post WHERE t = 1)", _LATTICE, recursive=True))
def startprob_update(spark: SparkSession, d: str) -> DataFrame:
    """Posterior start probabilities."""
    post = H.posteriors(_observed(spark, d).withColumn("em", H.emission(THREE)), THREE, ["chain"])
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(H.start_update(post, 3))], "state int, log_p double").withColumn("log_p", F.round("log_p", 6))


_XI = ", x AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(exp(p.a{i} + {THREE.log_trans[i][j]!r} + n.e{j} + n.b{j} - p.llf)) AS m FROM post p JOIN post n ON n.chain = p.chain AND n.t = p.t + 1" for i in K for j in K) + "), s AS (SELECT sum(m) FILTER (i = j) / sum(m) AS stay FROM x)"


@query(B.with_views("chains", "SELECT 'free' AS kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(ln(m / sum(m) OVER (PARTITION BY i)), 6) AS log_p FROM x UNION ALL SELECT 'tied', CAST(i AS INTEGER), CAST(j AS INTEGER), round(ln(CASE WHEN i = j THEN stay ELSE (1 - stay) / 2 END), 6) FROM x, s", _LATTICE + _XI, recursive=True))
def transition_update(spark: SparkSession, d: str) -> DataFrame:
    """Expected transitions, normalised, free and with a tied diagonal."""
    post = H.posteriors(_observed(spark, d).withColumn("em", H.emission(THREE)), THREE, ["chain"]).persist()
    rows = [(kind, i, j, float(v)) for kind, tied in (("free", False), ("tied", True)) for i, row in enumerate(H.transition_update(post, 3, tied)) for j, v in enumerate(row)]
    post.unpersist()
    return spark.createDataFrame(rows, "kind string, i int, j int, log_p double").withColumn("log_p", F.round("log_p", 6))


@query(B.with_views("spots", "SELECT src, CAST(count(*) AS INTEGER) AS degree, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM p WHERE exp(-power(d2 / 36, 5)) > 1e-4 GROUP BY src", _PAIRS))
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour list of every spot."""
    lists = X.adjacency_lists(X.weighted_adjacency(B.spots(spark, d), 36.0))
    return lists.select("src", F.size("neighbours").alias("degree"), F.array_join(F.transform("neighbours", lambda n: n["dst"].cast("string")), ",").alias("neighbours"))


_SPREAD = _IN_BLOCKS + ", bn AS (SELECT spot, chr AS bin, sum(umi) AS umi FROM cells GROUP BY ALL), dv AS (SELECT spot, sqrt(greatest(sum(ln(1 + umi) * ln(1 + umi)) / 22 - (sum(ln(1 + umi)) / 22) * (sum(ln(1 + umi)) / 22), 0)) AS std, sum(umi) AS n FROM bn GROUP BY spot), ct AS (SELECT unnest(range(7)) AS i, unnest(quantile_cont(std, [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS cut FROM dv), sm AS (SELECT i, cut, (SELECT sum(n) FROM dv WHERE std <= cut) AS n FROM ct)"


@query(B.with_views("counts genome spots", "SELECT spot FROM dv WHERE std <= (SELECT arg_min(cut, CASE WHEN n > 4400 THEN i ELSE 100 - i END) FROM sm)", _SPREAD))
def near_normal_spots(spark: SparkSession, d: str) -> DataFrame:
    """Spots whose counts vary least over bins, enough of them."""
    bins = _reads(spark, d).groupBy("spot", F.col("chr").alias("bin")).agg(F.sum("umi").alias("umi"))
    return R.near_normal_spots(A.dispersion_over_bins(bins, 22), bins.groupBy("spot").agg(F.sum("umi").alias("n")), 200 * 22)


_ADAPTIVE = (
    "near AS (SELECT a.spot AS src, b.spot AS dst, 9 * (a.x - b.x) * (a.x - b.x) + 3 * (a.y - b.y) * (a.y - b.y) AS d2 FROM spots a JOIN spots b ON a.sample = b.sample AND a.spot <> b.spot)"
    ", sc AS (SELECT coalesce(median(d2), 12) / 12 AS scale FROM (SELECT min(d2) AS d2 FROM near WHERE d2 <= 162 GROUP BY src))"
    ", sizes AS (SELECT r, median(n) AS m FROM (SELECT r, spot, count(d2) AS n FROM (SELECT unnest(range(10)) AS r) CROSS JOIN spots CROSS JOIN sc LEFT JOIN near ON src = spot AND d2 <= 162 AND d2 <= r * scale * 12 * (1 + 1e-9) GROUP BY r, spot) GROUP BY r)"
    ", chosen AS (SELECT coalesce(min(r) - 1, 9) AS r FROM sizes WHERE r > 0 AND m + 1 > 7)"
    ", pool AS (SELECT src, dst FROM near, sc, chosen WHERE d2 <= 162 AND d2 <= r * scale * 12 * (1 + 1e-9))"
    ", free AS (SELECT * FROM near WHERE (src, dst) NOT IN (SELECT (src, dst) FROM pool))"
    ", wd AS (SELECT w, median(v) AS m FROM (SELECT w, spot, coalesce(sum(CASE WHEN exp(-power(d2 / w, 5)) > 1e-4 THEN exp(-power(d2 / w, 5)) END), 0) AS v FROM (SELECT unnest(range(12, 169, 12)) AS w) CROSS JOIN spots LEFT JOIN free ON src = spot GROUP BY w, spot) GROUP BY w)"
    ", width AS (SELECT coalesce(min(w), 168) AS w FROM wd WHERE m >= 6)"
)


@query(B.with_views("spots", "SELECT src, dst, 'pool' AS kind, 1.0::DOUBLE AS weight FROM pool UNION ALL SELECT spot, spot, 'pool', 1.0 FROM spots UNION ALL SELECT src, dst, 'couple', round(exp(-power(d2 / w, 5)), 6) FROM free, width WHERE exp(-power(d2 / w, 5)) > 1e-4", _ADAPTIVE))
def adaptive_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pooling and coupling edges with radii chosen from the spots."""
    pool, couple = X.adaptive_graph(B.spots(spark, d))
    return pool.select("src", "dst", F.lit("pool").alias("kind"), F.lit(1.0).alias("weight")).unionByName(couple.select("src", "dst", F.lit("couple").alias("kind"), F.round("weight", 6).alias("weight")))


_LOF = (
    "o AS (SELECT feature, n, row_number() OVER (ORDER BY n, feature) AS place, count(*) OVER () AS size FROM (SELECT feature, CAST(sum(umi) AS BIGINT) AS n FROM counts GROUP BY feature))"
    ", nn AS (SELECT * FROM (SELECT a.feature, a.place, b.place AS other, abs(a.n - b.n) AS d, least(200, a.size - 1) AS m, row_number() OVER (PARTITION BY a.place ORDER BY abs(a.n - b.n), b.place) AS r FROM o a JOIN o b ON b.place BETWEEN a.place - 200 AND a.place + 200 AND a.place <> b.place) WHERE r <= m)"
    ", far AS (SELECT place, max(d) AS k FROM nn GROUP BY place)"
    ", density AS (SELECT nn.place, 1 / (avg(greatest(d, k)) + 1e-10) AS v FROM nn JOIN far ON far.place = nn.other GROUP BY nn.place)"
    ", lf AS (SELECT nn.place, avg(b.v) / any_value(a.v) AS lof FROM nn JOIN density a ON a.place = nn.place JOIN density b ON b.place = nn.other GROUP BY nn.place)"
)


@query(B.with_views("counts", "SELECT feature, n, round(lof, 5) AS lof, lof > 1.5 AS outlier FROM o JOIN lf USING (place)", _LOF))
def lof_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Local outlier factor of genes' totals."""
    return R.outlier_features(B.counts(spark, d).groupBy("feature").agg(F.sum("umi").alias("n"))).withColumn("lof", F.round("lof", 5))


_BALANCED = _IN_BLOCKS + ", ob AS (SELECT chr * 1000 + block AS bin, CAST(sum(b) AS BIGINT) AS k, CAST(sum(a + b) AS BIGINT) AS depth FROM cells GROUP BY ALL), dd AS (SELECT DISTINCT depth FROM ob WHERE depth > 0), px AS (SELECT depth, x, " + _bb_sql("x", "depth", "25.0", "25.0") + " AS l FROM (SELECT depth, unnest(range(0, depth + 1)) AS x FROM dd)), cd AS (SELECT depth, x, sum(exp(l)) OVER (PARTITION BY depth ORDER BY x) AS c FROM px), bd AS (SELECT depth, min(x) FILTER (c >= 0.05) AS lo, coalesce(min(x) FILTER (c >= 0.95), depth) AS hi FROM cd GROUP BY depth), jd AS (SELECT bin, k, ob.depth, coalesce(k BETWEEN lo AND hi, true) AS kept FROM ob LEFT JOIN bd ON bd.depth = ob.depth)"


@query(B.with_views("counts genome", "SELECT bin, k, depth, kept, CASE WHEN kept THEN CAST(dense_rank() OVER (PARTITION BY kept ORDER BY bin) - 1 AS INTEGER) END AS renumbered FROM jd", _BALANCED))
def balanced_bins(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose allele share fits a balanced genome of a given dispersion."""
    obs = _in_blocks(spark, d).groupBy((F.col("chr") * 1000 + F.col("block")).alias("bin")).agg(F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth"))
    return R.normal_bins(obs, tau=50.0)


@query("SELECT major, minor, CASE " + " ".join(f"WHEN greatest(major, minor) = {a} AND least(major, minor) = {b} THEN '{colour}'" for (a, b), colour in C.PALETTE.items()) + " END AS colour FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS major), (SELECT CAST(unnest(range(7)) AS INTEGER) AS minor)")
def copy_colours(spark: SparkSession, d: str) -> DataFrame:
    """Palette colour of each pair of copies."""
    pairs = spark.range(49).select(F.expr("cast(id div 7 as int)").alias("major"), (F.col("id") % 7).cast("int").alias("minor"))
    return pairs.withColumn("colour", C.copy_colour(F.col("major"), F.col("minor")))


@query(B.with_views("counts genome", "SELECT block, spot, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT DISTINCT start // 1000 AS block, feature FROM genome WHERE is_interval) JOIN counts USING (feature) GROUP BY block, spot"))
def block_sums(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the genes of each block, listed twice but counted once."""
    genes = _blocks(spark, d).where("is_interval").select("block", "feature")
    return A.block_sums(B.counts(spark, d), genes.unionByName(genes), ["block"])


_PURE = _IN_BLOCKS + ", h AS (SELECT * FROM spots WHERE tumour > 0.5), z AS (SELECT clone, count(*) AS n_spots, avg(tumour) AS purity FROM h GROUP BY clone), kk AS (SELECT chr FROM cells GROUP BY chr), cc AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS clone)"


@query(B.with_views("counts genome spots", "SELECT clone, chr, CAST(coalesce(umi, 0) AS BIGINT) AS umi, CAST(coalesce(a, 0) AS BIGINT) AS a, CAST(coalesce(b, 0) AS BIGINT) AS b, CAST(coalesce(n_spots, 0) AS BIGINT) AS n_spots, round(purity, 6) AS purity FROM cc CROSS JOIN kk LEFT JOIN (SELECT clone, chr, sum(umi) AS umi, sum(a) AS a, sum(b) AS b FROM cells JOIN h USING (spot) GROUP BY ALL) USING (clone, chr) LEFT JOIN z USING (clone)", _PURE))
def pure_pseudobulk(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each clone's purer spots, zeros for a clone without any."""
    every = spark.range(4).select(F.col("id").cast("int").alias("clone"))
    return A.pseudobulk(_reads(spark, d), B.spots(spark, d).select("spot", "clone", "tumour"), ["chr"], least_purity=0.5, every=every).withColumn("purity", F.round("purity", 6))


@query(B.with_views("spots", "SELECT spot, sample, CASE WHEN spot % 3 > 0 THEN tumour END AS tumour FROM spots"))
def tumour_proportions(spark: SparkSession, d: str) -> DataFrame:
    """Every spot with its tumour proportion, where the table of proportions has it."""
    spots = B.spots(spark, d)
    return spots.select("spot", "sample").join(spots.where("spot % 3 > 0").select("spot", "tumour"), "spot", "left")


@query("SELECT s_suppkey AS spot, CAST(CASE s_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 20 THEN 2 END AS INTEGER) AS place, row_number() OVER (ORDER BY CASE s_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 20 THEN 2 ELSE 9 END, s_nationkey, s_suppkey) AS at FROM supplier")
def order_by_list(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in the order of a list of nations, the others last."""
    from pyspark.sql import Window

    rows = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("spot"), F.col("s_nationkey").cast("string").alias("nation"))
    placed = A.ordered_by(rows, "nation", ["7", "3", "20", "7"])
    return placed.select("spot", "place", F.row_number().over(Window.orderBy(F.col("place").asc_nulls_last(), F.col("nation").cast("int"), "spot")).alias("at"))


def _shifted_sql(i: int) -> str:
    """Log-emission of a state of ``THREE``, purity of alleles weighted by copies; columns as in ``_OBSERVED``, q and shift."""
    rate = f"(q * {math.exp(THREE.log_mu[i])!r} + 1 - q)"
    weight = f"exp({THREE.log_mu[i]} - shift)"
    pure = f"(q * {weight} / (q * {weight} + 1 - q))"
    share = f"({THREE.p[i]} * {pure} + 0.5 * (1 - {pure}))"
    mu = f"(base * {rate})"
    p = f"({mu} / ({mu} + {THREE.alpha[i]} * {mu} * {mu}))"
    return f"({_nb_sql('umi', f'({mu} * {p} / (1 - {p}))', p)} + {_bb_sql('k', 'depth', f'({share} * 30.0)', f'((1 - {share}) * 30.0)')})"


@query(B.with_views("chains", "SELECT chain, t, " + ", ".join(f"round({_shifted_sql(i)}, 5) AS e{i}" for i in K) + " FROM (SELECT *, (t % 10) / 10.0 AS q, (chain % 3) / 10.0 AS shift FROM o)", _OBSERVED.split(", e AS")[0]))
def shifted_purity_emission(spark: SparkSession, d: str) -> DataFrame:
    """Emissions of mixtures where the share of tumour reads follows the copies of each bin."""
    em = H.emission(THREE, purity=F.col("t") % 10 / 10, shift=F.col("chain") % 3 / 10)
    return _observed(spark, d).withColumn("em", em).select("chain", F.col("t").cast("long").alias("t"), *(F.round(F.col("em")[i], 5).alias(f"e{i}") for i in K))


_PHASED = _IN_BLOCKS + ", " + _CLONE_LLF.split(", lf AS")[0] + ", s2 AS (SELECT unnest(range(6)) AS state, unnest([0.5, 0.3, 0.65, 0.5, 0.7, 0.35]) AS p), lf AS (SELECT clone, bin, state, CASE WHEN depth > 0 THEN " + _bb_sql("k", "depth", "(p * 30.0)", "((1 - p) * 30.0)") + " ELSE 0 END AS llf FROM cl, s2), own AS (SELECT clone, bin, state % 3 AS s, state >= 3 AS turned, llf FROM lf WHERE state = (clone * 2 + bin) % 6)"


@query(B.with_views("counts genome spots", "SELECT x.clone AS c1, y.clone AS c2, CAST(x.s AS INTEGER) AS s1, CAST(y.s AS INTEGER) AS s2, count(*) AS n, round(avg((x.llf - sx.llf + y.llf - sy.llf) / 2), 4) AS t FROM own x JOIN own y ON x.bin = y.bin AND x.clone < y.clone AND x.s <> y.s JOIN lf sx ON sx.clone = x.clone AND sx.bin = x.bin AND sx.state = y.s + CASE WHEN x.turned <> ((x.s = 2) <> (y.s = 2)) THEN 3 ELSE 0 END JOIN lf sy ON sy.clone = y.clone AND sy.bin = y.bin AND sy.state = x.s + CASE WHEN y.turned <> ((x.s = 2) <> (y.s = 2)) THEN 3 ELSE 0 END GROUP BY ALL", _PHASED))
def clone_similarity_phased(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each pair of clones and states, where a state has two phases."""
    states = H.States(p=(0.5, 0.3, 0.65), tau=(30.0,) * 3)
    bulk = _in_blocks(spark, d).join(B.spots(spark, d).select("spot", "clone"), "spot").groupBy("clone", F.col("chr").alias("bin")).agg(F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth"))
    rows = bulk.select("clone", "bin", F.posexplode(H.emission(states, reads=False, phased=True)).alias("state", "llf"))
    decoded = bulk.select("clone", "bin", ((F.col("clone") * 2 + F.col("bin")) % 6).cast("int").alias("state"))
    return R.similarity_statistics(rows, decoded, shares=states.p).withColumn("t", F.round("t", 4))


_FIELD = (
    _IN_BLOCKS + ", cb AS (SELECT spot, chr AS bin, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(b) AS BIGINT) AS k, CAST(sum(a + b) AS BIGINT) AS depth, CAST(10 + chr AS DOUBLE) AS base FROM cells GROUP BY spot, chr)"
    ", ed AS (SELECT a.spot AS src, b.spot AS dst FROM spots a JOIN spots b ON a.sample = b.sample AND 9 * (a.x - b.x) * (a.x - b.x) + 3 * (a.y - b.y) * (a.y - b.y) <= 12)"
    ", own AS (SELECT spot AS src, CASE WHEN count(*) FILTER (depth > 0) > 0 THEN count(*) FILTER (depth > 0) / CAST(count(*) AS DOUBLE) ELSE 1.0 END AS ratio FROM cb GROUP BY spot)"
    ", q AS (SELECT ed.src, bin, sum(umi) AS umi, sum(base) AS base, sum(k) AS k, sum(depth) AS depth FROM ed JOIN cb ON cb.spot = ed.dst GROUP BY ed.src, bin)"
    ", st AS (SELECT unnest([0, 1, 2]) AS state, unnest([0.5, 0.3, 0.15]) AS p, unnest([1.0, 1.3498588075760032, 0.6703200460356393]) AS rate)"
    ", gm AS (SELECT clone, bin, state, ln(CASE WHEN state = (clone + bin) % 3 THEN 0.8 ELSE 0.1 END) AS lg FROM (SELECT unnest([0, 1, 2]) AS clone), (SELECT DISTINCT bin FROM cb), st)"
    ", em AS (SELECT src, clone, bin, lg + " + _nb_sql("umi", "(m * pp / (1 - pp))", "pp") + " AS r, lg + CASE WHEN depth > 0 THEN " + _bb_sql("k", "depth", "(p * 30.0)", "((1 - p) * 30.0)") + " ELSE 0 END AS b FROM (SELECT q.*, clone, lg, p, base * rate AS m, (base * rate) / (base * rate + 0.1 * base * rate * base * rate) AS pp FROM q JOIN gm USING (bin) JOIN st USING (state)))"
    ", pb AS (SELECT src, clone, bin, max(r) + ln(sum(exp(r - mr))) AS r, max(b) + ln(sum(exp(b - mb))) AS b FROM (SELECT *, max(r) OVER w AS mr, max(b) OVER w AS mb FROM em WINDOW w AS (PARTITION BY src, clone, bin)) GROUP BY src, clone, bin)"
    ", pl AS (SELECT src AS spot, clone, sum(coalesce(ratio, 1) * r + b) AS llf FROM pb LEFT JOIN own USING (src) GROUP BY src, clone)"
)


def _softened(decoded: DataFrame) -> DataFrame:
    """Posteriors that give a path's own state 0.8 and the others 0.1."""
    every = decoded.select("clone", "bin", F.col("state").alias("own"), F.explode(F.array(*map(F.lit, K))).alias("state"))
    return every.select("clone", "bin", "state", F.log(F.when(F.col("state") == F.col("own"), 0.8).otherwise(0.1)).alias("log_gamma"))


def _posterior_field(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts, edges, decoded = _field(spark, d)
    return counts, edges, _softened(decoded)


@query(B.with_views("counts genome spots", "SELECT spot, clone, round(llf, 3) AS llf FROM pl", _FIELD))
def posterior_spot_llf(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of each spot's neighbourhood with states summed out by their posteriors."""
    return R.posterior_spot_llf(*_posterior_field(spark, d), R.states_table(spark, THREE)).withColumn("llf", F.round("llf", 3))


@query(B.with_views("counts genome spots", "SELECT round((SELECT sum(llf) FROM pl JOIN spots USING (spot, clone)) + 0.5 * (SELECT count(*) FROM p JOIN spots a ON a.spot = p.src JOIN spots b ON b.spot = p.dst WHERE a.clone = b.clone AND exp(-power(d2 / 36, 5)) > 1e-4), 3) AS llf", _FIELD + ", " + _PAIRS))
def total_llf(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of the spots' own labels and of like neighbours."""
    spots = B.spots(spark, d)
    llf = R.posterior_spot_llf(*_posterior_field(spark, d), R.states_table(spark, THREE))
    return R.total_llf(spots.select("spot", F.col("clone").alias("label")), llf, X.weighted_adjacency(spots, 36.0), 0.5).withColumn("llf", F.round("llf", 3))


@query()
def final_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels after one sweep: by decoded paths and by posteriors, with purity and without."""
    spots = B.spots(spark, d)
    counts, edges, decoded = _field(spark, d)
    counts = keep(counts.join(spots.select("spot", "tumour"), "spot"))
    soft, couple = _softened(decoded), keep(X.weighted_adjacency(spots, 36.0))
    labels = spots.select("sample", "spot", F.col("clone").alias("label"))
    prior = A.clone_log_weights(spots, spark.range(3).select(F.col("id").cast("int").alias("clone")))
    out = None
    for name, paths, purity in (("point", decoded, None), ("posterior", soft, None), ("point, purity", decoded, "tumour"), ("posterior, purity", soft, "tumour")):
        found, _ = R.final_labels(counts, edges, couple, labels, paths, R.states_table(spark, THREE), log_prior=prior, purity=purity)
        found = found.select("sample", "spot", "label", F.lit(name).alias("form"))
        out = found if out is None else out.unionByName(found)
    return out


_ONCE = "ix.sample, ix.spot, CAST(l[ix.i] - 1 AS INTEGER) AS label"


@query(" UNION ALL ".join(f"SELECT *, '{name}' AS nodes FROM ({icm_sql(NEAR, _ONCE, 2, raw)})" for name, raw in (("max", None), ("weighted_sum", ORACLE["posterior_spot_llf"].replace("round(llf, 3) AS llf", "llf")))))
def node_potential(spark: SparkSession, d: str) -> DataFrame:
    """Labels after one sweep: spots judged by each clone's path, and by its states' posteriors."""
    spots = B.spots(spark, d)
    counts, edges, decoded = _field(spark, d)
    labels = spots.select("sample", "spot", F.col("clone").alias("label"))
    prior = A.clone_log_weights(spots, spark.range(3).select(F.col("id").cast("int").alias("clone")))
    couple, out = keep(X.weighted_adjacency(spots, 36.0)), None
    for name, paths in (("max", decoded), ("weighted_sum", _softened(decoded))):
        found, _ = R.final_labels(counts, edges, couple, labels, paths, R.states_table(spark, THREE), log_prior=prior)
        found = found.select("sample", "spot", "label", F.lit(name).alias("nodes"))
        out = found if out is None else out.unionByName(found)
    return out


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths of three clones over blocks, copies of their states, and the blocks."""
    bins = _blocks(spark, d).select("chr", "block").distinct().select((F.col("chr") * 100_000 + F.col("block")).alias("bin"), "chr", (F.col("block") * BLOCK).alias("start"), ((F.col("block") + 1) * BLOCK).alias("end"))
    clones = spark.range(3).select(F.col("id").cast("int").alias("clone"))
    decoded = bins.join(F.broadcast(clones), how="cross").select("clone", "bin", ((F.col("clone") + F.col("bin")) % 4).cast("int").alias("state"))  # three clones
    grid = clones.select("clone", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("state"))
    copies = grid.where("not (clone = 1 and state = 3)").select("clone", "state", (1 + (F.col("clone") + F.col("state")) % 3).alias("a"), (F.col("state") % 2).alias("b"))
    return decoded, copies, bins


_COPIES = f"bins AS (SELECT DISTINCT chr * 100000 + start // {BLOCK} AS bin, chr, start // {BLOCK} * {BLOCK} AS start, (start // {BLOCK} + 1) * {BLOCK} AS \"end\" FROM genome), cp AS (SELECT clone, state, CAST(1 + (clone + state) % 3 AS INTEGER) AS a, CAST(state % 2 AS INTEGER) AS b FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS clone), (SELECT CAST(unnest(range(4)) AS INTEGER) AS state) WHERE NOT (clone = 1 AND state = 3)), sg AS (SELECT chr, start, \"end\", cp.clone, cp.state, a, b FROM bins JOIN cp ON cp.state = (cp.clone + bin) % 4)"


@query(B.with_views("genome", "SELECT * FROM sg", _COPIES))
def cnv_segments(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every block of every clone."""
    return N.segment_copies(*_copies(spark, d))


@query(B.with_views("genome", "SELECT g.feature AS gene, clone, a, b FROM genome g JOIN sg ON sg.chr = g.chr AND g.start >= sg.start AND g.start < sg.\"end\" WHERE is_interval", _COPIES))
def cnv_genes(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every gene of every clone."""
    genes = B.genome(spark, d).where("is_interval").select(F.col("feature").alias("gene"), "chr", "start")
    return N.gene_copies(N.segment_copies(*_copies(spark, d)), genes)


@query(B.with_views("genome", "SELECT state, x.a AS a_0, x.b AS b_0, y.a AS a_1, y.b AS b_1, z.a AS a_2, z.b AS b_2 FROM (SELECT * FROM cp WHERE clone = 0) x JOIN (SELECT * FROM cp WHERE clone = 1) y USING (state) JOIN (SELECT * FROM cp WHERE clone = 2) z USING (state)", _COPIES))
def cnv_states(spark: SparkSession, d: str) -> DataFrame:
    """Copies of the states that all clones have, side by side."""
    return N.state_copies(_copies(spark, d)[1], range(3))


_ELLIPSE_ROWS = "el AS (SELECT spot, x AS cx, y AS cy, 1 + tumour AS l11, 0.2 AS l12, tumour / 4 AS l21, 0.5 + tumour AS l22 FROM spots)"


def _holds_sql(x: str, y: str, e: str) -> str:
    det = f"({e}.l11 * {e}.l22 - {e}.l12 * {e}.l21)"
    return f"(power(({e}.l22 * ({x} - {e}.cx) - {e}.l12 * ({y} - {e}.cy)) / {det}, 2) + power(({e}.l11 * ({y} - {e}.cy) - {e}.l21 * ({x} - {e}.cx)) / {det}, 2) <= 1)"


def _meets_sql(one: str, other: str) -> str:
    x, y = (f"({one}.c{v} + {one}.l{i}1 * cos(t * 2 * pi() / 1000) + {one}.l{i}2 * sin(t * 2 * pi() / 1000))" for v, i in (("x", 1), ("y", 2)))
    return f"bool_or({_holds_sql(x, y, other)})"


def _ellipses(spark: SparkSession, d: str) -> DataFrame:
    """One ellipse for each spot."""
    pure = F.col("tumour")
    return B.spots(spark, d).select("spot", F.col("x").alias("cx"), F.col("y").alias("cy"), (1 + pure).alias("l11"), F.lit(0.2).alias("l12"), (pure / 4).alias("l21"), (0.5 + pure).alias("l22"))


@query(B.with_views("spots", "SELECT p.spot AS one, q.spot AS other, " + _meets_sql("p", "q") + " OR " + _meets_sql("q", "p") + " AS meets FROM el p JOIN el q ON q.spot = p.spot + 1, (SELECT unnest(range(1000)) AS t) GROUP BY p.spot, q.spot", _ELLIPSE_ROWS))
def ellipse_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ellipses of spots next to each other in number overlap."""
    e = _ellipses(spark, d)
    names = ("cx", "cy", "l11", "l12", "l21", "l22")
    p, q = (e.select(F.col("spot").alias(f"{s}spot"), *(F.col(c).alias(f"{s}{c}") for c in names)) for s in "pq")
    met = p.join(q, F.col("qspot") == F.col("pspot") + 1)
    return met.select(F.col("pspot").alias("one"), F.col("qspot").alias("other"), C.ellipses_overlap(*({c: F.col(f"{s}{c}") for c in names} for s in "pq")).alias("meets"))


_TURN = "(pi() / 4 * (spot % 5) / 5.0)"


@query(B.with_views("spots", f"SELECT spot, round(f - 1 + cx, 6) AS cx, round(cy, 6) AS cy, round(f * f * (cos(th) * l11 - sin(th) * l21), 6) AS l11, round(f * f * (cos(th) * l12 - sin(th) * l22), 6) AS l12, round(f * f * (sin(th) * l11 + cos(th) * l21), 6) AS l21, round(f * f * (sin(th) * l12 + cos(th) * l22), 6) AS l22 FROM (SELECT *, 0.6 + 0.05 * (spot % 7) / 7.0 AS f, {_TURN} AS th FROM el)", _ELLIPSE_ROWS))
def ellipse_daughter(spark: SparkSession, d: str) -> DataFrame:
    """The ellipse that grows out of each one, for given draws."""
    names = ("cx", "cy", "l11", "l12", "l21", "l22")
    out = C.daughter(F.col("cx"), F.col("cy"), tuple(F.col(c) for c in names[2:]), 0.6, F.col("spot") % 7 / 7.0, F.col("spot") % 5 / 5.0)
    return _ellipses(spark, d).select("spot", *(F.round(x, 6).alias(c) for c, x in zip(names, out, strict=True)))


@query(B.with_views("chains", "SELECT chain, round(max(m) + ln(sum(exp(v - m))), 6) AS lse FROM (SELECT chain, k / 10.0 AS v, max(k / 10.0) OVER (PARTITION BY chain) AS m FROM chains) GROUP BY chain"))
def log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    """Log of the sum of exponentials of each chain's values."""
    return B.chains(spark, d).groupBy("chain").agg(F.array_agg(F.col("k") / 10).alias("v")).select("chain", F.round(C.logsumexp(F.col("v")), 6).alias("lse"))


@query(B.with_views("spots", "SELECT src, dst, round(sum(weight), 6) AS weight FROM (SELECT src, dst, exp(-power(d2 / 36, 5)) AS weight FROM p WHERE exp(-power(d2 / 36, 5)) > 1e-4 UNION ALL SELECT a.spot, b.spot, 0.25 FROM spots a JOIN spots b ON a.x = b.x AND a.y + 1 = b.y UNION ALL SELECT b.spot, a.spot, 0.25 FROM spots a JOIN spots b ON a.x = b.x AND a.y + 1 = b.y) GROUP BY src, dst", _PAIRS))
def stacked_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graphs of all samples with links between slices beside them."""
    s = B.spots(spark, d)
    return X.with_links(X.weighted_adjacency(s, 36.0), slice_links(s)).withColumn("weight", F.round("weight", 6))


@query(B.with_views("spots", "SELECT src, dst, round(exp(-power(d2 / 36, 5)), 6) AS weight FROM p WHERE exp(-power(d2 / 36, 5)) > 1e-4 AND src IN (SELECT spot FROM spots WHERE clone = 1)", _PAIRS))
def spot_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the spots of one clone."""
    spots = B.spots(spark, d)
    near = X.neighbours(X.weighted_adjacency(spots, 36.0), spots.where("clone = 1").select(F.col("spot").alias("node")))
    return near.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(B.with_views("sites", "SELECT CAST(feature AS VARCHAR) AS snp_id, CAST(spot AS VARCHAR) AS barcode, CAST(dp - CASE WHEN feature % 2 = 0 THEN ad ELSE dp - ad END AS BIGINT) AS a, CAST(CASE WHEN feature % 2 = 0 THEN ad ELSE dp - ad END AS BIGINT) AS b FROM (SELECT feature, spot, sum(ad) AS ad, sum(dp) AS dp FROM sites GROUP BY feature, spot HAVING sum(dp) > 0) WHERE feature % 5 <> 0"))
def haplotype_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads of both haplotypes from the two sparse matrices, the sites, the barcodes and the phases."""
    cells = B.site_counts(spark, d).groupBy(F.col("feature").alias("row"), F.col("spot").alias("col")).agg(F.sum("ad").alias("ad"), F.sum("dp").alias("dp"))
    ad, dp = (cells.where(F.col(c) > 0).select("row", "col", F.col(c).cast("double").alias("value")) for c in ("ad", "dp"))
    names = cells.select("row", F.col("row").cast("string").alias("snp_id")).distinct()
    phase = names.where("row % 5 <> 0").select("snp_id", F.when(F.col("row") % 2 == 0, "0|1").otherwise("1|0").alias("gt"))
    return readers.haplotype_counts(names, ad, dp, cells.select("col", F.col("col").cast("string").alias("barcode")).distinct(), phase)


@query(B.with_views("genome gmap", "SELECT chr, block, n, CAST(ceil(2 / -ln((0.9 * n - 1) / (n - 1))) AS INTEGER) AS elements FROM (SELECT chr, pos // 1000 AS block, 1 + count(*) AS n FROM gmap GROUP BY ALL) WHERE n > 1"))
def effective_elements(spark: SparkSession, d: str) -> DataFrame:
    """Observations over which a chain of as many states as a block's markers and one forgets its start."""
    n = B.genetic_map(spark, d).groupBy("chr", F.floor(F.col("pos") / 1000).alias("block")).agg((1 + F.count(F.lit(1))).alias("n"))
    return n.select("chr", "block", "n", C.effective_elements(0.9, F.col("n")).alias("elements"))


def _misfit_sql() -> str:
    """Loss of the copies a0, b0 to a2, b2 beside a clone's bins n, means m, shares p and weights w."""
    t = [f"(a{i} + b{i})" for i in K]
    total, points = " + ".join(f"w{i} * {t[i]}" for i in K), " + ".join(f"(n{i} + 0.1)" for i in K)
    scale = f"(CASE WHEN d < 0 THEN {total} ELSE 2 / md END)"
    fit = " + ".join(f"(n{i} + 0.1) * (power(0.3 * (m{i} - {t[i]} / {scale}), 2) + power(p{i} - a{i} / {t[i]}, 2))" for i in K)
    turned = " + ".join(f"2 * CAST(m{i} - m{j} > 0.3 AND {t[i]} < {t[j]} AS INTEGER)" for i in K for j in K if i != j)
    high = f"CAST({' + '.join(f'(n{i} + 0.1) * {t[i]}' for i in K)} > (ploidy + 0.5) * ({points}) AS INTEGER)"
    worst = f"greatest(0.05, {', '.join(f'CASE WHEN a{i} = b{i} THEN abs(p{i} - 0.5) ELSE 0 END' for i in K)})"
    odd = " + ".join(f"CAST(a{i} <> b{i} AND abs(p{i} - 0.5) < {worst} AS INTEGER)" for i in K)
    return f"{fit} + (n0 + n1 + n2) * ({turned} + {high} + CASE WHEN d < 0 THEN {odd} ELSE 0 END)"


def _climb_sql() -> str:
    """``best``: all four searches over three states, thirty steps of one state each, as plain SQL."""
    pairs, now = ", ".join(f"a{i}, b{i}" for i in K), ", ".join(f"n{i}, m{i}, p{i}, w{i}" for i in K)
    wide = ", ".join(f"max({c}) FILTER (state = {i}) AS {x}{i}" for i in K for x, c in (("n", "bins"), ("m", "mu"), ("p", "p"), ("w", "w")))
    drawn = [f"cd[1 + (v{i} * v{i} % {N.PRIME}) % 25]" for i in K]
    held = ", ".join(f"CASE WHEN state = {i} THEN 1 ELSE {drawn[i]}.{x} END AS {x}{i}" for i in K for x in "ab")
    free = ", ".join(f"CAST(ploidy // 2 AS INTEGER) AS a{i}, CAST(ploidy - ploidy // 2 AS INTEGER) AS b{i}" for i in K)
    moved = ", ".join(f"CASE WHEN c >= 0 AND step % 3 = {i} THEN c{x} ELSE {x}{i} END AS {x}{i}" for i in K for x in "ab")
    barred = " OR ".join(f"(step % 3 = {i} AND (abs(p{i} - 0.5) > 0.2 OR abs(m{i} - 1) > 0.5))" for i in K)
    seeds = ", ".join(f"((CAST({i} * 1009 AS BIGINT) + ploidy * 99991 + restart * 7919 + 1) * {N.FACTOR}) % {N.PRIME} AS v{i}" for i in K)
    most = ", ".join(f"('{k}', {v})" for k, v in N.SEARCHES.items())
    return (
        ", st AS (SELECT clone, state, bins, p, log_mu, w / sum(w) OVER (PARTITION BY clone) AS w, exp(log_mu) / (sum(w * exp(log_mu)) OVER (PARTITION BY clone) / sum(w) OVER (PARTITION BY clone)) AS mu FROM sx JOIN ww USING (clone, state))"
        f", wd AS (SELECT clone, {wide} FROM st GROUP BY clone)"
        ", dp AS (SELECT clone, state, mu AS md FROM (SELECT *, row_number() OVER (PARTITION BY clone ORDER BY bins < 0.4 * total, log_mu, state) AS rk FROM (SELECT *, sum(bins) OVER (PARTITION BY clone) AS total FROM st) WHERE bins >= 0.02 * total AND abs(p - 0.5) <= 0.05) WHERE rk = 1)"
        ", cand AS (SELECT CAST(row_number() OVER (ORDER BY ca, cb) - 1 AS INTEGER) AS c, ca, cb FROM (SELECT CAST(unnest(range(6)) AS INTEGER) AS ca), (SELECT CAST(unnest(range(6)) AS INTEGER) AS cb) WHERE ca + cb BETWEEN 1 AND 6)"
        ", lists AS (SELECT list({'a': ca, 'b': cb} ORDER BY c) AS cd FROM cand)"
        ", tried AS (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS ploidy)"
        f", begun AS (SELECT clone, -1 AS d, NULL::DOUBLE AS md, ploidy, 0 AS restart, {free} FROM wd, tried"
        f" UNION ALL SELECT clone, state, md, ploidy, restart, {held} FROM (SELECT *, {seeds} FROM dp, tried, (SELECT CAST(unnest(range(20)) AS INTEGER) AS restart)), lists)"
        f", run AS (SELECT clone, d, md, ploidy, restart, 0 AS step, {pairs}, {now}, {_misfit_sql()} AS loss FROM begun JOIN wd USING (clone)"
        f" UNION ALL SELECT clone, d, md, ploidy, restart, step + 1, {pairs}, {now}, loss FROM (SELECT *, row_number() OVER (PARTITION BY clone, d, ploidy, restart ORDER BY loss, c) AS rk FROM ("
        f"SELECT clone, d, md, ploidy, restart, step, c, {pairs}, {now}, CASE WHEN c < 0 THEN old ELSE {_misfit_sql()} END AS loss FROM ("
        f"SELECT clone, d, md, ploidy, restart, step, c, {moved}, {now}, loss AS old FROM run, (SELECT * FROM cand UNION ALL SELECT -1, 0, 0) WHERE step < 30 AND (c < 0 OR d <> step % 3) AND NOT (c >= 0 AND d >= 0 AND ca = 1 AND cb = 1 AND ({barred}))))) WHERE rk = 1)"
        f", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search, clone ORDER BY loss, ploidy, restart) AS rk FROM run JOIN (VALUES {most}) s(search, most) ON (search = 'fixed') = (d >= 0) AND ploidy <= most WHERE step = 30) WHERE rk = 1)"
    )


_WEIGHTS = ", ww AS (SELECT chain % 4 AS clone, CAST(t % 3 AS INTEGER) AS state, CAST(sum(n) AS DOUBLE) AS w FROM chains GROUP BY ALL)"


@query(B.with_views("chains", " UNION ALL ".join(f"SELECT search, CAST(clone AS INTEGER) AS clone, ploidy, restart, CAST({i} AS INTEGER) AS state, a{i} AS a, b{i} AS b, round(loss, 4) AS loss FROM best" for i in K), _STATES_SQL + _WEIGHTS + _climb_sql(), recursive=True))
def copy_searches(spark: SparkSession, d: str) -> DataFrame:
    """Integer copies of each clone's states by all four searches, in one job."""
    rows = _state_rows(spark, d)
    weights = B.chains(spark, d).groupBy((F.col("chain") % 4).cast("int").alias("clone"), (F.col("t") % 3).cast("int").alias("state")).agg(F.sum("n").cast("double").alias("weight"))
    rows = N.adjusted_log_mu(rows, weights).join(weights, ["clone", "state"])
    found = N.copy_solutions(rows, least=0.4, off_balance=0.2, off_diploid=0.5)
    return found.select("search", "clone", "ploidy", "restart", "state", "a", "b", F.round("loss", 4).alias("loss"))


_PLACES = ", sz AS (SELECT chr, count(*) AS n FROM bins GROUP BY chr), mk AS (SELECT chr, CAST(coalesce(sum(n) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM sz), pl AS (SELECT chr, bin, first + row_number() OVER (PARTITION BY chr ORDER BY bin) - 1 AS place FROM bins JOIN mk USING (chr))"


@query(B.with_views("genome", "SELECT chr, first, n, round(CAST(0.55 AS DOUBLE) * first + CAST(0.45 AS DOUBLE) * (first + n), 6) AS place FROM mk", _COPIES + _PLACES))
def chromosome_marks(spark: SparkSession, d: str) -> DataFrame:
    """Where chromosomes begin on a plot's axis, and where their names stand."""
    return PLOT.chromosome_marks(_copies(spark, d)[2].select("chr", "bin")).withColumn("place", F.round("place", 6))


_TRACKS = ", bk AS (SELECT clone, chr, block, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(b) AS BIGINT) AS k, CAST(sum(a + b) AS BIGINT) AS depth FROM cells JOIN spots USING (spot) GROUP BY ALL), al AS (SELECT chr, block, sum(umi) AS whole FROM bk GROUP BY ALL), cl AS (SELECT clone, sum(umi) / (SELECT sum(umi) FROM bk) AS part FROM bk GROUP BY clone)"


@query(B.with_views("counts genome spots", "SELECT bk.clone, bk.chr, bk.chr * 100000 + bk.block AS bin, place, round(umi / nullif(whole * part, 0), 6) AS rdr, round(k / nullif(depth, 0), 6) AS baf, state, greatest(a, b) AS major, least(a, b) AS minor, CASE " + " ".join(f"WHEN greatest(a, b) = {x} AND least(a, b) = {y} THEN '{colour}'" for (x, y), colour in C.PALETTE.items()) + f" END AS colour FROM bk JOIN al USING (chr, block) JOIN cl USING (clone) JOIN pl ON pl.bin = bk.chr * 100000 + bk.block LEFT JOIN sg ON sg.clone = bk.clone AND sg.chr = bk.chr AND sg.start = bk.block * {BLOCK}", _IN_BLOCKS + ", " + _COPIES + _PLACES + _TRACKS))
def clone_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Read depth ratio, allele share and copies of each block of each clone, as plots draw them."""
    decoded, copies, bins = _copies(spark, d)
    cells = _in_blocks(spark, d).join(B.spots(spark, d).select("spot", "clone"), "spot")
    bulk = cells.groupBy("clone", "chr", (F.col("chr") * 100_000 + F.col("block")).alias("bin")).agg(F.sum("umi").alias("umi"), F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth"))
    whole = bulk.groupBy("chr", "bin").agg(F.sum("umi").alias("whole"))
    part = bulk.groupBy("clone").agg(F.sum("umi").alias("_u"))
    part = part.join(F.broadcast(part.agg(F.sum("_u").alias("_t")))).select("clone", (F.col("_u") / F.col("_t")).alias("part"))  # one row
    bulk = bulk.join(whole, ["chr", "bin"]).join(F.broadcast(part), "clone").withColumn("base", F.col("whole") * F.col("part"))
    segments = decoded.join(F.broadcast(copies), ["clone", "state"])  # four states a clone
    found = PLOT.clone_tracks(bulk, PLOT.bin_places(bins.select("chr", "bin")), segments)
    return found.withColumn("rdr", F.round("rdr", 6)).withColumn("baf", F.round("baf", 6))


@query(B.with_views("genome", "SELECT clone, state, first, last + 1 AS \"end\", round(exp(state / 10), 6) AS rdr, round(0.5 - state / 10, 6) AS baf, round(0.5 + state / 10, 6) AS mirrored FROM (SELECT clone, state, min(place) AS first, max(place) AS last FROM (SELECT *, place - row_number() OVER (PARTITION BY clone, state ORDER BY place) AS run FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS clone, place, bin FROM pl) JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS state) ON state = (clone + bin) % 4) GROUP BY clone, state, run)", _COPIES + _PLACES))
def clone_lines(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one state of each clone, at the state's means."""
    decoded, _, bins = _copies(spark, d)
    states = spark.range(4).select(F.col("id").cast("int").alias("state"), (F.col("id") / 10).alias("log_mu"), (0.5 - F.col("id") / 10).alias("p"))
    found = PLOT.clone_lines(decoded, PLOT.bin_places(bins.select("chr", "bin")), states)
    return found.select("clone", "state", "first", "end", *(F.round(c, 6).alias(c) for c in ("rdr", "baf", "mirrored")))


_TINT = "[" + ", ".join(str(list(c)) for c in PLOT.CLONE_COLOURS) + "][1 + (legend - 1) % 8]"


@query(B.with_views("spots", "SELECT spot, x + CASE WHEN sample = 1 THEN (SELECT max(x) + 10 FROM spots WHERE sample = 0) ELSE 0 END AS px, -y AS py, clone AS label, clone AS legend, tumour AS shade, printf('#%02x%02x%02x', " + ", ".join(f"CAST(floor(211 + (CASE WHEN clone = 0 THEN 211 ELSE tint[{i}] END - 211) * tumour + 0.5) AS INTEGER)" for i in (1, 2, 3)) + f") AS colour FROM (SELECT *, {_TINT.replace('legend', 'greatest(clone, 1)')} AS tint FROM spots)"))
def spot_map(spark: SparkSession, d: str) -> DataFrame:
    """Places and colours of spots, slices side by side."""
    spots = B.spots(spark, d)
    return PLOT.spot_map(spots.drop("clone"), spots.select("spot", F.col("clone").alias("label")))
