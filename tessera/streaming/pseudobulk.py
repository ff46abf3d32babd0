"""Pseudobulk and spot filters over a stream of count rows (an extra: incremental batch results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_pseudobulk(counts: DataFrame, clones: DataFrame, keys: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Running sums per (clone, keys) of a stream ``(spot, keys, umi, a, b)``; write it in update or complete mode.

    State is one row per clone and key. ``clones(spot, clone)`` is a static table.
    """
    return counts.join(clones.select("spot", "clone"), "spot").groupBy("clone", *keys).agg(*(F.sum(c).alias(c) for c in ("umi", "a", "b")))


def stream_windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums per window of event time of ``events(ts, event_type, value)``; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
