"""The staged inference on planted clones: two that alleles tell apart, one of which reads split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate, copynumber, hmm, hmrf
from tessera.plans import pipeline


def tissue(spark, seed=0, side=10):
    """A normal third, and tumour spots with a lost chromosome, of which the lower half has another one doubled."""
    rng = np.random.default_rng(seed)
    rows, spots = [], []
    for i in range(side * side):
        x, y = i % side, i // side
        truth = 0 if x < side // 3 else 1 + (y >= side // 2)
        spots.append((i, 0, float(x), float(y), truth))
        for b in range(24):
            chr_ = 1 + b // 8
            share = 0.1 if truth and chr_ == 1 else 0.5
            rate = 0.55 if truth and chr_ == 1 else 1.9 if truth == 2 and chr_ == 3 else 1.0
            depth = int(rng.poisson(15))
            rows.append((i, chr_, 100 * chr_ + b, int(rng.poisson(25 * rate)), 25.0, int(rng.binomial(depth, share)), depth))
    counts = spark.createDataFrame(rows, "spot long, chr int, bin long, umi long, base double, k long, depth long")
    return counts, spark.createDataFrame(spots, "spot long, sample int, x double, y double, truth int")


def test_stages_find_planted_clones(spark, tmp_path):
    counts, spots = tissue(spark)
    found = pipeline.staged_clones(counts, spots, k=3, rounds=2, em_rounds=3, least_bins=4, telemetry=str(tmp_path / "runs"))
    alleles = found.allele_labels.join(spots.select("spot", F.least("truth", F.lit(1)).alias("truth")), "spot")
    assert aggregate.adjusted_rand(alleles, "label", "truth").first().ari > 0.9
    labels = found.labels.join(spots.select("spot", "truth"), "spot")
    assert aggregate.adjusted_rand(labels, "label", "truth").first().ari > 0.9
    assert labels.count() == spots.count() and np.isfinite(found.llf)
    assert len(found.models) == found.allele_labels.select("label").distinct().count() == 2
    assert found.states.select("alpha", "tau").distinct().count() == 1
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert {r.start for r in runs.select("start").distinct().collect()} == {"sp", "smp"} and runs.where("llf is null").count() == 0


def test_planted_clones_refined_together_equal_separate_runs(spark):
    """Both allele clones in one plan, and each in a plan of its own."""
    counts, spots = tissue(spark, 1, 10)
    base = spots.withColumn("model", F.least("truth", F.lit(1))).withColumn("label", (F.col("model") * 2 + (F.col("y") >= 5).cast("int")).cast("int"))
    from tessera.operators import graph

    pool, couple = graph.adaptive_graph(spots)
    start = hmm.States(p=(0.5, 0.15), tau=(30.0,) * 2, log_mu=(0.0, 0.3), alpha=(0.1,) * 2, log_start=(float(np.log(0.5)),) * 2, log_trans=tuple(tuple(float(np.log(0.95 if i == j else 0.05)) for j in range(2)) for i in range(2)))
    labels = base.select("sample", "spot", "model", "label")
    both, models, _ = hmrf.field_loop(counts, pool, couple, labels, [start, start], rounds=1, em_rounds=2, update="smp")
    both = {r.spot: r.label for r in both.collect()}
    for m in (0, 1):
        own = labels.where(F.col("model") == m)
        alone, (model,), _ = hmrf.field_loop(counts, pool, couple, own.withColumn("model", F.lit(0)), [start], rounds=1, em_rounds=2, update="smp")
        assert model.p == pytest.approx(models[m].p, abs=1e-3) and model.log_mu == pytest.approx(models[m].log_mu, abs=1e-3)
        assert all(both[r.spot] == r.label for r in alone.collect())


def test_unknown_node_potential(spark):
    with pytest.raises(ValueError, match="node potential"):
        hmrf.clone_paths(spark.range(1), "mean")


def planted_paths(spark, base):
    """Two clones of 40 bins: label 5 is normal, label 2 has a gain (2, 1) and a loss (1, 0)."""
    state = {2: [0] * 20 + [1] * 12 + [2] * 8, 5: [0] * 40}
    paths = spark.createDataFrame([(c, b, s) for c, row in state.items() for b, s in enumerate(row)], "clone int, bin long, state int")
    # Means stand a third too high: the baseline's weights set them right.
    states = spark.createDataFrame([(0, float(np.log(4 / 3)), 0.5), (1, float(np.log(2.0)), 2 / 3), (2, float(np.log(2 / 3)), 1.0)], "state int, log_mu double, p double")
    counts = spark.createDataFrame([(s, 1 + b // 20, b, base[b]) for s in range(6) for b in range(40)], "spot long, chr int, bin long, base double")
    labels = spark.createDataFrame([(s, 2 if s < 4 else 5) for s in range(6)], "spot long, label int")
    return paths, states, counts, labels


def test_copies_of_planted_paths(spark):
    # Weights with which the shift of label 2 is exactly log(4 / 3).
    base = [2.0] * 20 + [5.0] * 12 + [5.0 * 12 / 8] * 8
    copies, segments = pipeline.copy_stage(*planted_paths(spark, base))
    assert {r.search for r in copies.select("search").distinct().collect()} == set(copynumber.SEARCHES)
    fixed = {(r.clone, r.state): (r.a, r.b) for r in copies.where("search = 'fixed'").collect()}
    assert fixed == {(0, 0): (1, 1), (1, 0): (1, 1), (1, 1): (2, 1), (1, 2): (1, 0)}  # label 5 becomes clone 0
    rows = segments.where("search = 'fixed' and clone = 1").collect()
    assert len(rows) == 40 and all((r.a, r.b) == ((1, 1) if r.bin < 20 else (2, 1) if r.bin < 32 else (1, 0)) and r.chr == 1 + r.bin // 20 for r in rows)
    assert copies.where("search != 'fixed' and ploidy > 2").where("search = 'diploid'").count() == 0


def test_a_clone_without_baseline_or_diploid_state(spark):
    paths, states, counts, labels = planted_paths(spark, [0.0] * 20 + [1.0] * 20)
    none = counts.withColumn("base", F.when(F.col("spot") < 4, F.col("base")).otherwise(0.0))
    assert {r.clone for r in pipeline.copy_stage(paths, states, none, labels)[0].select("clone").distinct().collect()} == {1}
    odd = states.withColumn("p", F.when(F.col("state") == 0, 0.7).otherwise(F.col("p")))
    found = pipeline.copy_stage(paths, odd, counts, labels)[0]
    assert found.where("search = 'fixed'").count() == 0 and found.count() == 3 * (3 + 1)


def test_the_diploid_state_among_rare_ones(spark):
    rows = spark.createDataFrame([(0, 0, 95, 0.4, 0.7), (0, 1, 5, 0.0, 0.5), (1, 0, 90, 0.3, 0.5), (1, 1, 5, 0.0, 0.5), (1, 2, 5, 0.1, 0.9), (2, 0, 99, 0.2, 0.7), (2, 1, 1, 0.0, 0.5)], "clone int, state int, bins int, log_mu double, p double")
    assert {tuple(r) for r in copynumber.diploid_state(rows).collect()} == {(1, 0)}
    assert {tuple(r) for r in copynumber.diploid_state(rows, retry=0.02).collect()} == {(0, 1), (1, 0)}
