"""Best-fit packing of documents into fixed-length sequences, planned on a length histogram (operator 5).

The plan sees only how many pieces there are of each length (at most ``capacity`` counts). It
runs best-fit over the lengths in descending order, keeping ranges of equal bins rather than
bins. A piece then takes its slot by its rank among the pieces of its length: ranks come from
counts per (length, bucket), so that a length which a third of all pieces share spreads over
all buckets.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, schema, small_batches, table
from .encoder import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLAN = "length int, first_rank long, last_rank long, per_bin long, first_sequence long, base long"
CAPACITY = 2048


def _cutter(path: str, keeps_space: bool, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, step = encoder(path, keeps_space), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, *, keeps_space: bool = False, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: documents longer than ``capacity`` are cut, others are one piece."""
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(_cutter(tokenizer, keeps_space, end_id, capacity), schema(PIECES))


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, items per bin, first sequence, offset) of a best-fit-decreasing plan.

    ``counts``: pieces of each length, lengths 1 to ``capacity``. The plan's size depends on the
    lengths that occur, not on the number of pieces. Rank r of a row's length, from first to
    last, goes to sequence ``first sequence + (r - first) // per bin`` at offset
    ``offset + ((r - first) % per bin) * length``.
    """
    rooms: list[int] = []  # the spaces left over, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # space -> (first sequence, bins)
    plan, fresh = [], 0

    def keep(space: int, first: int, bins: int) -> None:
        if space and bins:
            if space not in ranges:
                bisect.insort(rooms, space)
                ranges[space] = []
            ranges[space].append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, bins = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space]
                    rooms.pop(at)
            else:
                space, first, bins = capacity, fresh, -(-left // (capacity // length))
                fresh += bins
            per = space // length
            full = min(bins, left // per)
            if full:
                plan.append((length, rank, rank + full * per, per, first, capacity - space))
                keep(space - per * length, first, full)
                left, rank = left - full * per, rank + full * per
            if full < bins and left:  # fewer than a bin's worth: one bin takes them
                plan.append((length, rank, rank + left, per, first + full, capacity - space))
                keep(space - left * length, first + full, 1)
                full, left, rank = full + 1, 0, rank + left
            keep(space, first + full, bins - full)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces(doc_id, piece, ..., length)``.

    ``pieces`` is read three times: give a written table. The driver gets the histogram (at most
    ``capacity`` counts); the counts per (length, bucket) stay distributed.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    # Pieces of one length are ranked bucket by bucket, so the most common length is split too.
    buckets = max(256, max(counts.values(), default=0) // bucket_rows)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    cells = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # at most `buckets` rows a length
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), PLAN).withColumnRenamed("length", "_length")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_k", F.row_number().over(order) - 1).join(cells, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_k"))
    # The plan has a few rows for each of at most `capacity` lengths: a proven bound.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("last_rank")))
    at = F.col("_rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + (at % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, keeps_space: bool = False, end_id: int = 0) -> DataFrame:
    """Pieces of all ``docs`` with their places; null text: the end id alone; an empty table: no rows.

    Rows that repeat or share an id are packed each; a text of any length is cut into pieces.
    """
    return pack(materialise(token_pieces(docs, tokenizer, keeps_space=keeps_space, end_id=end_id, capacity=capacity), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by word_bpe_49k with end id 0, packed into sequences of 2048."""
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", F.col("start").cast("long"), F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
