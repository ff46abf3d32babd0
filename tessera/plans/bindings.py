"""Domain tables over the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a task that sums up pairs of features and spots, which hardly repeat: its table of pairs doesn't grow with the input.
TASK_ROWS = 1_000_000


def task_number(spark: SparkSession, d: str) -> int:
    """Tasks that rows of the number of lines are dealt to; 0: few enough for the session's own number."""
    n = read(spark, d, "lineitem").count() // TASK_ROWS  # from the files' footers
    return max(n + 1, spark.sparkContext.defaultParallelism) if n else 0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(feature, spot, umi, a, b): counts by return flag."""
    def of(flag: str):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0)).cast("long")

    lines, parts = read(spark, d, "lineitem"), task_number(spark, d)
    if parts:
        lines = lines.repartition(parts, "l_partkey")  # what follows by feature needs no further shuffle
    return lines.groupBy(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("spot")).agg(of("N").alias("umi"), of("A").alias("a"), of("R").alias("b"))


def genome(spark: SparkSession, d: str) -> DataFrame:
    """(feature, chr, start, end, is_interval, name): genes are intervals, SNPs are points."""
    gene = F.col("p_partkey") % 3 == 0
    start = F.expr("100 * (p_partkey div 22)")
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("feature"), (1 + F.col("p_partkey") % 22).cast("int").alias("chr"), start.alias("start"),
        F.when(gene, start + 10 * F.col("p_size")).otherwise(start + 1).alias("end"), gene.alias("is_interval"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
    )


def genetic_map(spark: SparkSession, d: str) -> DataFrame:
    """(chr, pos, cm)."""
    up = Window.partitionBy("chr").orderBy("start", "feature").rowsBetween(Window.unboundedPreceding, 0)
    return genome(spark, d).where("feature % 5 = 0").select("chr", F.col("start").alias("pos"), (F.sum("size").over(up) / 1000).alias("cm"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """(chr, start, end) to leave out."""
    return genome(spark, d).where(F.col("type").startswith("ECONOMY")).select("chr", "start", (F.col("start") + 10 * F.col("size")).alias("end"))


def spots(spark: SparkSession, d: str) -> DataFrame:
    """(spot, sample, x, y, clone, tumour)."""
    return read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("spot"), (F.col("s_nationkey") % 2).cast("int").alias("sample"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.expr("cast(s_suppkey div 10 as double)").alias("y"),
        (F.col("s_nationkey") % 3).cast("int").alias("clone"), (F.pmod(F.floor("s_acctbal"), F.lit(100)) / 100).alias("tumour"),
    )


def chains(spark: SparkSession, d: str) -> DataFrame:
    """(chain, t, k, n): allele counts in order of time."""
    n = F.least(F.lit(200), 5 + F.abs(F.floor("value"))).cast("long")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select(F.col("user_id").alias("chain"), t.alias("t"), (F.col("event_id") % (n + 1)).alias("k"), n.alias("n"))


def site_counts(spark: SparkSession, d: str) -> DataFrame:
    """(spot, feature, AD, DP, OTH, INFO): allele reads of a line, also as an INFO string."""
    dp = F.col("l_quantity").cast("long")
    ad = F.when(F.col("l_linenumber") % 4 == 0, F.lit(0)).when(F.col("l_linenumber") % 4 == 1, dp).otherwise((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % (dp + 1))
    base = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("spot"), ad.alias("ad"), dp.alias("dp"), (F.col("l_orderkey") % 3).alias("oth"))
    return base.withColumn("info", F.concat(F.lit("AD="), "ad", F.lit(";DP="), "dp", F.lit(";OTH="), "oth"))


#: The same tables for DuckDB.
VIEWS = {
    "counts": "SELECT l_partkey AS feature, l_suppkey AS spot, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS umi, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS b FROM lineitem GROUP BY ALL",
    "genome": "SELECT p_partkey AS feature, CAST(1 + p_partkey % 22 AS INTEGER) AS chr, 100 * (p_partkey // 22) AS start, CASE WHEN p_partkey % 3 = 0 THEN 100 * (p_partkey // 22) + 10 * p_size ELSE 100 * (p_partkey // 22) + 1 END AS \"end\", p_partkey % 3 = 0 AS is_interval, p_name AS name, p_size AS size, p_brand AS brand, p_type AS type FROM part",
    "gmap": "SELECT chr, start AS pos, sum(size) OVER (PARTITION BY chr ORDER BY start, feature ROWS UNBOUNDED PRECEDING) / 1000.0 AS cm FROM genome WHERE feature % 5 = 0",
    "ranges": "SELECT chr, start, start + 10 * size AS \"end\" FROM genome WHERE starts_with(type, 'ECONOMY')",
    "spots": "SELECT s_suppkey AS spot, CAST(s_nationkey % 2 AS INTEGER) AS sample, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 AS DOUBLE) AS y, CAST(s_nationkey % 3 AS INTEGER) AS clone, (((CAST(floor(s_acctbal) AS BIGINT) % 100) + 100) % 100) / 100.0 AS tumour FROM supplier",
    "chains": "SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_id % (least(200, 5 + CAST(abs(floor(value)) AS BIGINT)) + 1) AS k, least(200, 5 + CAST(abs(floor(value)) AS BIGINT)) AS n FROM events",
    "sites": "SELECT l_orderkey AS line, l_linenumber AS number, l_partkey AS feature, l_suppkey AS spot, CASE WHEN l_linenumber % 4 = 0 THEN 0 WHEN l_linenumber % 4 = 1 THEN CAST(l_quantity AS BIGINT) ELSE (l_orderkey * 7 + l_linenumber) % (CAST(l_quantity AS BIGINT) + 1) END AS ad, CAST(l_quantity AS BIGINT) AS dp, l_orderkey % 3 AS oth FROM lineitem",
}
_NEEDS = {"gmap": ["genome"], "ranges": ["genome"]}


def with_views(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """DuckDB query with the named tables before it and further expressions after them."""
    wanted = list(dict.fromkeys(x for n in names.split() for x in (*_NEEDS.get(n, []), n)))
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
