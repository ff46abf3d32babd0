"""Intervals on levels, exact selection and neighbour search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate, genome, graph


def test_a_chromosome_long_range_is_one_row(spark):
    rng = np.random.default_rng(1)
    spans = [(1, 0, 250_000_000), (2, 5, 6), (2, 1023, 1025), (2, -5, 5), (3, 100, 100)]
    spans += [(2, int(s), int(s + 2 ** rng.integers(0, 24))) for s in rng.integers(0, 10_000_000, 40)]
    ranges = spark.createDataFrame(spans, "chr int, start long, end long")
    assert genome._binned(ranges, F.col("start"), F.col("end")).count() == len(spans)
    assert genome._asking(ranges, F.col("start"), F.lit(0)).groupBy("chr", "start", "end").count().agg(F.max("count")).first()[0] <= 9
    at = [(c, int(p)) for c in (1, 2, 3) for p in rng.integers(-10, 12_000_000, 60)] + [(2, 5), (2, 6), (2, 1024), (1, 249_999_999), (1, 250_000_000), (2, -1), (None, 5)]
    points = spark.createDataFrame(at, "chr int, start long")
    want = [(c, p) for c, p in at if not any(d == c and s <= p < e for d, s, e in spans)]
    assert sorted(map(str, map(tuple, genome.range_anti(points, ranges).collect()))) == sorted(map(str, want))
    rows = spark.createDataFrame([(i, c, s, e) for i, (c, s, e) in enumerate(spans)], "feature int, chr int, start long, end long")
    islands = ranges.withColumn("island", F.col("start") * 3 + F.col("end"))
    got = genome.overlap_join(rows, islands).select("feature", "island").collect()
    want = [(i, s * 3 + e) for i, (c, a, b) in enumerate(spans) for d, s, e in spans if c == d and max(a, s) < min(b, e)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one"])
def test_order_statistics(spark, kind):
    rng = np.random.default_rng(2)
    x = {"normal": rng.normal(size=3001), "ties": rng.integers(0, 4, 2000).astype(float), "wide": np.exp(rng.normal(0, 30, 1500)), "one": np.array([7.0])}[kind]
    rows = [(i % 2 if len(x) > 1 else 0, float(v)) for i, v in enumerate(x)] + [(0, None), (0, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    at = (0.0, 0.05, 0.4, 0.5, 0.9, 1.0)
    got = {r[0]: r[1:] for r in aggregate.order_statistics(df, "v", at, ["g"])}
    for g in {i % 2 if len(x) > 1 else 0 for i in range(len(x))}:
        own = x[g::2] if len(x) > 1 else x
        assert np.allclose(got[g], np.quantile(own, at), rtol=1e-12)
    assert got[9] == (None,) * 6
    assert np.allclose(aggregate.order_statistics(df.where("g < 9"), "v", at)[0], np.quantile(x, at), rtol=1e-12)
    assert aggregate.percentiles(df, "v", (0.4,), ["g"]).columns == ["g", "p40"]


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_without_a_bound(spark, k):
    rng = np.random.default_rng(k)
    at = [(i, int(rng.integers(0, 4)), float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(400, 3, (60, 2)), [[1e4, -1e4]], np.zeros((5, 2))]))]
    at += [(500, 9, 0.0, 0.0)]
    got = graph.slice_neighbours(spark.createDataFrame(at, "spot long, z int, x double, y double"), k).collect()
    want = []
    for i, z, x, y in at:
        for next_ in (z - 1, z + 1):
            near = sorted(((x - c) ** 2 + (y - d) ** 2, j) for j, w, c, d in at if w == next_)
            want += [(i, j, round(d2, 6)) for d2, j in near[:k]]
    assert sorted((r.src, r.dst, round(r.d2, 6)) for r in got) == sorted(want)
