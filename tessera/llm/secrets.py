"""Secret scans over an incremental blob ledger, in DataFrame functions only (operator 3).

Every version of a file is content-addressed by the SHA-256 of its text. The ledger holds one
row per (blob, rules version) that has been scanned, with its findings; a run scans only the
pairs that the ledger lacks and then joins findings back to all paths. Blobs without a finding
are in the ledger too: they are not scanned again.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

#: Fixed patterns, in the order in which kinds are listed: (kind, pattern, group that must be so long, least length).
RULES = (
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Rules that change have another version, so blobs are scanned again.
RULES_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
SPANS = "array<struct<start:int,ord:int,kind:string,last:int>>"
LEDGER = "blob string, rules string, spans array<struct<start:int,ord:int,kind:string,last:int>>"


#: Entries of an array that a fold appends to one by one; longer arrays go in runs of so many.
RUN = 256


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _runs(rows: Column) -> Column:
    """An array in runs of ``RUN`` entries."""
    count = F.ceil(F.size(rows) / F.lit(RUN)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda c: F.slice(rows, c * RUN + 1, F.lit(RUN)))).otherwise(F.array(rows))


def _before(values: Column, join) -> Column:
    """For each integer, those before it joined by ``join`` (0 for the first).

    An array that grows by one entry is copied each time, so runs are folded apart and then their
    totals: work grows little faster than the array.
    """

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(xs, start, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")))

    def united(parts: Column) -> Column:
        bases = fold(F.transform(parts, lambda p: p["at"]))["seen"]
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["seen"], lambda v: join(v, base))))

    return _bound(values, lambda vs: _bound(F.transform(_runs(vs), fold), united))


def _kind_spans(text: Column, ordinal: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind in code points: the pieces between matches give the matches' places."""
    pat = F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    held = F.regexp_extract_all(text, pat, F.lit(group)) if group else whole
    rows = F.zip_with(whole, held, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("g")))
    # One piece more than matches: the last has no match behind it.
    rows = F.zip_with(F.split(text, pattern, -1), rows, lambda p, r: F.struct(F.length(p).alias("gap"), r["n"].alias("n"), r["g"].alias("g")))

    def places(found: Column) -> Column:
        before = _before(F.transform(found, lambda x: x["gap"] + x["n"]), lambda s, x: s + x)
        spans = F.zip_with(found, before, lambda x, at: F.struct(x["g"].alias("g"), F.struct((at + x["gap"]).alias("start"), F.lit(ordinal).alias("ord"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("last")).alias("span")))
        return F.transform(F.filter(spans, lambda x: x["g"] >= least), lambda x: x["span"])

    found = _bound(F.filter(rows, lambda x: x["n"].isNotNull()), places)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def secret_spans(text: Column) -> Column:
    """All spans of a text, by start and then kind as listed."""
    return F.array_sort(F.concat(*(_kind_spans(text, k, *rule) for k, rule in enumerate(RULES))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing was scanned yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger_path: str, rules: str = RULES_VERSION) -> DataFrame:
    """Scan the blobs of ``versions(blob, text)`` that the ledger lacks under these rules; returns the ledger.

    The ledger is partitioned by rules version, so a run reads the blobs of its own rules alone.
    Copies of a blob meet in one row by partial aggregation before the shuffle, so a blob that a
    third of all paths share costs one row per map task.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, ledger_path).where(F.col("rules") == rules).select("blob")
    if not known.isEmpty():  # ids go first, so that texts of known blobs stay where they are
        fresh = versions.select("blob").distinct().join(known, "blob", "left_anti")
        versions = versions.join(fresh, "blob", "left_semi")
    unseen = versions.groupBy("blob").agg(F.first("text").alias("text"))
    scanned = unseen.select("blob", F.lit(rules).alias("rules"), secret_spans(F.col("text")).alias("spans"))
    scanned.write.mode("append").partitionBy("rules").parquet(ledger_path)
    return read_ledger(spark, ledger_path).where(F.col("rules") == rules)


def scan_paths(docs: DataFrame, ledger_path: str, rules: str = RULES_VERSION) -> DataFrame:
    """(doc_id, blob, spans) of every row of ``docs(doc_id, text)``: each path version with its blob's findings.

    Null texts count as empty; rows that repeat stay; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    ledger = scan_new(paths.select("blob", "text"), ledger_path, rules)
    hits = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.select("doc_id", "blob").join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["last"])), ",")


def mask_spans(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``spans``, which come by start, masked; overlapping ones by one mask.

    Text between masks is cut out of one block of text for each run of spans: finding a code point
    walks from the start, which would make each span cost the whole text.
    """

    def pieces(gaps: Column) -> Column:
        low = F.element_at(gaps, 1)["from"]
        block = F.substring(text, low + 1, F.element_at(gaps, -1)["to"] - low)
        return _bound(block, lambda b: F.array_join(F.transform(gaps, lambda g: F.substring(b, g["from"] - low + 1, g["to"] - g["from"])), mask))

    def masked(found: Column) -> Column:
        done = _before(F.transform(found, lambda x: x["last"]), F.greatest)
        gaps = F.filter(F.zip_with(found, done, lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        tail = F.substring(text, F.array_max(F.transform(found, lambda x: x["last"])) + 1, F.length(text))
        return F.concat(_bound(gaps, lambda all_: F.array_join(F.transform(_runs(all_), pieces), mask)), F.lit(mask), tail)

    return F.when(F.size(spans) > 0, _bound(spans, masked)).otherwise(text)


def redact(docs: DataFrame, ledger_path: str, mask: str = "[SECRET]", rules: str = RULES_VERSION) -> DataFrame:
    """``docs`` (all its columns, of any names) with every secret replaced by ``mask``.

    Overlapping spans become one mask. Null texts stay null, and rows that repeat stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    ledger = scan_new(rows.select("blob", "text"), ledger_path, rules)
    hits = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))

    masked = mask_spans(F.col("text"), F.col("spans"), mask)
    joined = rows.join(hits, "blob", "left").withColumn("masked", F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("row")["text"]))
    return joined.select(*((F.col("masked") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, through a new ledger in the shared folder."""
    found = scan_paths(table(spark, sf_dir, "documents"), new_path(spark, "ledger"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in RULES]
    text = spans_text(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _oracle_kind(ordinal: int, kind: str, pattern: str, group: int, least: int) -> str:
    """DuckDB rows (doc_id, start, ord, kind, last) of one kind, from the pieces between matches."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, rn, list_sum(list_transform(parts[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:k - 1], lambda x: length(x))), 0) AS start,
           {ordinal} AS ord, '{kind}' AS kind, length(whole[k]) AS n
    FROM (SELECT doc_id, rn, regexp_split_to_array(text, '{quoted}') AS parts, regexp_extract_all(text, '{quoted}', 0) AS whole,
                 regexp_extract_all(text, '{quoted}', {group}) AS held, unnest(range(1, len(regexp_extract_all(text, '{quoted}', 0)) + 1)) AS k FROM d)
    WHERE length(held[k]) >= {least}"""


ORACLE_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
s AS ({reduce(lambda a, b: a + " UNION ALL " + b, (_oracle_kind(k, *r) for k, r in enumerate(RULES)))}),
g AS (
    SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, ord) AS spans FROM s GROUP BY rn
)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rn)
"""
