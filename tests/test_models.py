"""Columns, lattices, fits and searches against closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import copynumber, fit, genome, hmm, hmrf, simulate


def test_lgamma(spark):
    xs = [1e-6, 0.3, 1.0, 2.5, 17.0, 1e3, 1e6]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.lgamma(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x)) <= 1e-11 * max(1, abs(math.lgamma(r.x))) for r in rows)
    assert np.allclose(fit.np_lgamma(np.array(xs)), [math.lgamma(x) for x in xs], rtol=1e-10, atol=1e-10)


def test_laws_sum_to_one_and_bad_parameters_give_zero(spark):
    n = 12
    rows = spark.range(n + 1).select(C.bb_logpmf(F.col("id").cast("double"), F.lit(float(n)), F.lit(2.0), F.lit(3.0)).alias("l")).agg(F.sum(F.exp("l"))).head()[0]
    assert rows == pytest.approx(1)
    bad = spark.range(1).select(C.bb_logpmf(F.lit(9.0), F.lit(5.0), F.lit(1.0), F.lit(1.0)), C.nb_logpmf(F.lit(1.0), F.lit(2.0), F.lit(1.0)), C.nb_logpmf(F.lit(-1.0), F.lit(2.0), F.lit(0.5))).head()
    assert list(bad) == [0, 0, 0]


def test_state_emissions_equal_the_general_ones(spark):
    row = spark.createDataFrame([(7, 5.0, 3, 9, 0.6), (0, 0.0, 0, 0, 0.6), (2, 3.0, 9, 9, 1.0)], "umi int, base double, k int, depth int, q double")
    for purity in (None, F.col("q")):
        got = row.select(
            C.nb_state(F.col("umi"), F.col("base"), 0.3, 0.2, purity), C.nb_emission(F.col("umi"), F.col("base"), F.lit(0.3), F.lit(0.2), purity),
            C.bb_state(F.col("k"), F.col("depth"), 0.3, 20.0, purity), C.bb_emission(F.col("k"), F.col("depth"), F.lit(0.3), F.lit(20.0), purity),
        ).collect()
        for r in got:
            assert r[0] == pytest.approx(r[1], abs=1e-9) and r[2] == pytest.approx(r[3], abs=1e-9)


def test_fits_recover_planted_parameters(spark):
    rng = np.random.default_rng(2)
    n = 60 + rng.poisson(40, 3000)
    state = rng.integers(0, 2, 3000)
    k = rng.binomial(n, rng.beta(np.where(state, 0.3, 0.5) * 25, np.where(state, 0.7, 0.5) * 25))
    rows = spark.createDataFrame([(int(a), int(b), [float(s == 0), float(s == 1)]) for a, b, s in zip(k, n, state, strict=True)], "k int, n int, w array<double>")
    found = fit.maximise(fit.compressed(rows, F.col("k").cast("double"), F.col("n"), F.col("w"), 2), "bb", np.array([[0.5, 20.0]] * 2), shared=True)
    assert np.allclose(found[:, 0], [0.5, 0.3], atol=0.02) and np.allclose(found[:, 1], 25, rtol=0.15)
    mean = 30 * np.exp(0.4)
    x = simulate.negative_binomial(rng, np.full(3000, mean), 0.15)
    rows = spark.createDataFrame([(int(v), 30.0, [1.0]) for v in x], "x int, n double, w array<double>")
    (mu, alpha), = fit.maximise(fit.compressed(rows, F.col("x").cast("double"), F.col("n"), F.col("w"), 1), "nb", np.array([[0.1, 0.01]]), shared=False)
    assert mu == pytest.approx(0.4, abs=0.03) and alpha == pytest.approx(0.15, rel=0.15)


def test_likelihood_never_falls(spark):
    rng = np.random.default_rng(3)
    rows = [(c, t, 0, 0.0, int(rng.binomial(40, 0.2 if (t // 10) % 2 else 0.45)), 40) for c in range(3) for t in range(40)]
    obs = spark.createDataFrame(rows, "chain int, t int, umi int, base double, k int, depth int")
    states, trail = hmm.baum_welch(obs, hmm.default_states(2, 0.9), ["chain"], update="sp", rounds=3)
    assert all(b >= a - 1e-3 for a, b in itertools.pairwise(trail))
    assert sorted(states.p) == pytest.approx([0.2, 0.45], abs=0.03)


def test_greedy_edges(spark):
    def blocks(us, least=15):
        df = spark.createDataFrame([(1, i, u) for i, u in enumerate(us)], "chr int, rn int, u long")
        return [r.block for r in genome.greedy_blocks(df, least=least).orderBy("rn").collect()]

    assert blocks([5]) == [0]
    assert blocks([20, 5]) == [0, 0]  # a short tail joins
    assert blocks([10, 10, 20, 1]) == [0, 0, 1, 1]
    df = spark.createDataFrame([(1, 0, 10, 6_000_000), (1, 1, 400, 10), (1, 2, 1, 10)], "chr int, rn int, u long, len long")
    assert [r.bin for r in genome.greedy_bins(df).orderBy("rn").collect()] == [0, 1, 1]


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 15, 30), (1, 5, 5), (1, 15, 30)], "chr int, start long, end long")
    assert sorted(tuple(r) for r in genome.merge_intervals(rows).collect()) == [(1, 1, 0, 10, 1), (1, 2, 10, 30, 3)]
    points = spark.createDataFrame([(1, 0), (1, 29), (1, 30), (2, 3)], "chr int, start long")
    assert sorted(tuple(r) for r in genome.range_anti(points, rows).collect()) == [(1, 30), (2, 3)]


def test_map_edges(spark):
    gmap = spark.createDataFrame([(1, 100, 1.0), (1, 200, 3.0), (10, 50, 7.0)], "chr int, pos long, cm double")
    points = spark.createDataFrame([(1, 50), (1, 100), (1, 150), (1, 500), (10, 60), (2, 5)], "chr int, pos long")
    got = {(r.chr, r.pos): r.cm for r in genome.centimorgans(points, gmap).collect()}
    assert got == {(1, 50): 0.5, (1, 100): 1.0, (1, 150): 2.0, (1, 500): 3.0, (10, 60): 7.0, (2, 5): None}


def test_label_update_and_merging(spark):
    llf = spark.createDataFrame([(s, c, 1.0 if c == s // 3 else 0.0) for s in range(6) for c in range(2)], "spot long, clone int, llf double")
    labels = spark.createDataFrame([(0, s, 0) for s in range(6)], "sample int, spot long, label int")
    edges = spark.createDataFrame([(a, b, 0.1) for a in range(6) for b in range(6) if abs(a - b) == 1], "src long, dst long, weight double")
    got = {r.spot: r.label for r in hmrf.icm(llf, edges, labels).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    totals = spark.createDataFrame([(s, 1) for s in range(6)], "spot long, n long")
    short = hmrf.merge_small_clones(spark.createDataFrame([(s, 0 if s else 1) for s in range(6)], "spot long, label int"), totals, 2, 1)
    assert {r.label for r in short.collect()} == {0}
    every = hmrf.merge_small_clones(spark.createDataFrame([(s, s % 2) for s in range(5)], "spot long, label int"), totals, 99, 1)
    assert {r.label for r in every.collect()} == {0}  # all short: the deepest stays
    # 1 and 2 share too few bins to tell them apart: the lightest clique, so it is taken before 0 and 2.
    assert hmrf.merge_groups([(0, 1, 0, 1, 20, 5.0), (0, 2, 0, 1, 20, 0.1), (1, 2, 0, 1, 3, 9.0)], [0, 1, 2]) == [[0], [1, 2]]


def test_integer_copies_find_planted_ones(spark):
    rows = spark.createDataFrame([(0, 0, 50, 0.0, 0.5), (0, 1, 30, math.log(1.5), 2 / 3), (0, 2, 20, math.log(0.5), 1.0)], "clone int, state int, bins int, log_mu double, p double")
    diploid = copynumber.diploid_state(rows)
    assert [tuple(r) for r in diploid.collect()] == [(0, 0)]
    found = {r.state: (r.a, r.b) for r in copynumber.integer_copies(rows, diploid=diploid).collect()}
    assert found == {0: (1, 1), 1: (2, 1), 2: (1, 0)}


def test_streaming_sums(spark, small, tmp_path):
    from tessera.streaming.pseudobulk import stream_pseudobulk

    counts = spark.createDataFrame([(1, 1, 2, 1, 0), (2, 1, 3, 0, 1), (1, 2, 4, 0, 0)], "spot long, bin long, umi long, a long, b long")
    counts.write.parquet(str(tmp_path / "in"))
    clones = spark.createDataFrame([(1, 0), (2, 0)], "spot long, clone int")
    q = stream_pseudobulk(spark.readStream.schema(counts.schema).parquet(str(tmp_path / "in")), clones).writeStream.outputMode("complete").format("memory").queryName("bulk").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("bulk").collect()) == [(0, 1, 5, 1, 1), (0, 2, 4, 0, 0)]


def test_files(spark, tmp_path):
    from tessera.sources import readers, writers

    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n3 2 2\n1 1 5\n3 2 7\n")
    assert sorted(tuple(r) for r in readers.matrix_market(spark, str(tmp_path / "m.mtx")).collect()) == [(0, 0, 5.0), (2, 1, 7.0)]
    (tmp_path / "b.txt").write_text("AC_x_U1\n")
    assert tuple(readers.barcodes(spark, str(tmp_path / "b.txt")).head()) == ("AC_x_U1", "AC", "U1")
    (tmp_path / "c.json").write_text('// note\n{"a": {"b": "none"}}')
    assert readers.config(str(tmp_path / "c.json")).a.b is None
    rows = spark.createDataFrame([("1", 9, "x", "A", "C", ".", ".", "AD=1", "GT", "0/1"), ("1", 3, "y", "A", "C", ".", ".", "AD=1", "GT", "0/1")], "CHR string, POS long, ID string, REF string, ALT string, QUAL string, FILTER string, INFO string, FORMAT string, GT string")
    writers.write_vcf(rows, str(tmp_path / "v"))
    assert [r.POS for r in readers.vcf(spark, str(tmp_path / "v/*"), "FORMAT string, PHASE string").collect()] == [3, 9]
