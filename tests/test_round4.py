"""Fits and fields whose rounds cost more jobs, rows and sums than they need."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def seen(spark, purity=False):
    """Two models' chains of counts."""
    i = F.col("id")
    rows = spark.range(400).select((i % 2).cast("int").alias("model"), (i % 10).cast("int").alias("chain"), F.floor(i / 10).alias("t"), (i * 7 % 23).alias("umi"), (2.0 + i % 3 + F.when(i % 11 == 0, -9.0).otherwise(0.0004)).alias("base"), (i * 5 % 8).alias("k"), F.when(i % 13 == 0, 0).otherwise(8).cast("long").alias("depth"))
    rows = rows.withColumn("k", F.least("k", "depth")).withColumn("switch", F.log(F.lit(0.05) + 0.01 * (F.col("umi") % 3)))
    return rows.withColumn("pure", 0.5 + 0.1 * (F.col("t") % 4)) if purity else rows


@pytest.mark.parametrize(("phased", "purity"), [(False, None), (True, None), (False, "pure"), (True, "pure")])
def test_a_pass_sums_what_rows_of_posteriors_sum_to(spark, phased, purity):
    from tessera.operators import fit, hmm
    from tessera.operators.lattice import PAIRS, pair_counter

    models = [hmm.default_states(3, 0.9), hmm.States((0.5, 0.3, 0.2), (20.0,) * 3, (0.0, 0.4, -0.3), (0.2,) * 3, *(getattr(hmm.default_states(3, 0.8), c) for c in ("log_start", "log_trans")))]
    obs, keys, k = seen(spark, purity), ["model", "chain"], 3
    switch, pure = ("switch" if phased else None), (F.col(purity) if purity else None)
    em = hmm.emission_by_model(k, phased=phased, purity=pure)
    carry = ["umi", "base", "k", "depth", *([purity] if purity else [])]
    post = hmm.posteriors(hmm.with_parameters(obs, models, "model").withColumn("em", em), models, keys, switch=switch, model="model", carry=[c for c in carry if c != "model"]).persist()

    p, tau, log_mu, alpha = (np.array([getattr(m, c) for m in models]) for c in ("p", "tau", "log_mu", "alpha"))
    climbs = fit.ways_up(models, ["nb", "bb"], shared=True, near=True)
    points = {law: next(way) for law, way in climbs.items()}
    count = pair_counter(p, tau, log_mu, alpha, hmm._starts(models, phased), np.array([m.log_trans for m in models]), phased, purity, ["nb", "bb"], points)
    by = ["law", "model", "x", "n", *(["purity"] if purity else [])]
    stats = hmm._blocks(obs, keys, "t", switch, model="model", carry=carry).mapInArrow(count, PAIRS).groupBy(*by).agg(F.array(*(F.sum(F.col("w")[s]) for s in range(k))).alias("w")).persist()
    sums = hmm._model_sums(stats, 2, k)

    for m, (moves, starts, llf) in hmm.expected_sums(post, k, "model").items():
        assert np.allclose(sums["moves"][m], moves) and np.allclose(sums["starts"][m], starts) and sums["llf"][m] == pytest.approx(llf)
    assert sums["rows"].tolist() == [200, 200]
    for law, terms in fit.summed_terms(stats, points).items():
        assert np.allclose(sums[f"{law}_terms"], terms[:, :, 0])
    for fresh in ({"means": True, "shares": True}, {"means": False, "shares": True}):
        laws = [law for law, on in (("nb", fresh["means"]), ("bb", fresh["shares"])) if on]
        old = fit.fit_models(post, models, phased=phased, purity=purity, **fresh)
        new = fit.refitted(models, fit.climb_together(stats, fit.ways_up(models, laws, shared=True)), sums)
        for a, b in zip(old, new, strict=True):
            assert all(np.allclose(getattr(a, c), getattr(b, c), rtol=1e-6) for c in ("p", "tau", "log_mu", "alpha"))


def test_a_round_of_a_fit_is_a_pass_over_chains_and_two_over_pairs(spark):
    """Rows of posteriors were kept in each round and read by a dozen jobs."""
    from tessera.operators import hmm

    obs = seen(spark).where("model = 0")

    def jobs(rounds):
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        trail = hmm.baum_welch(obs, hmm.default_states(2, 0.9), ["chain"], rounds=rounds, tol=0.0)[1]
        assert len(trail) == rounds and trail[-1] >= trail[0]
        return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before

    assert jobs(6) - jobs(2) <= 4 * 5


def test_rounds_of_a_labelling_pool_their_counts_once(spark, monkeypatch):
    """What a neighbourhood sums to hangs on no model, but was summed anew in each round."""
    from tessera.operators import hmrf as R

    i = F.col("id")
    counts = spark.range(240).select(F.floor(i / 12).alias("spot"), F.lit(1).alias("chr"), (i % 12).alias("bin"), (i * 5 % 13).alias("umi"), (3.0 + i % 4).alias("base"), F.when(i < 120, i % 2).otherwise(8 - i % 2).alias("k"), F.lit(9).cast("long").alias("depth"))
    edges = spark.range(60).select((i % 20).alias("src"), (i % 20 + F.when((i % 20) % 10 < 9, F.floor(i / 40)).otherwise(0)).alias("dst")).distinct()
    labels = spark.range(20).select(F.lit(0).alias("sample"), i.alias("spot"), (i >= 10).cast("int").alias("label"))
    links = edges.where("src <> dst").withColumn("weight", F.lit(0.1))
    calls, plain = [], R.neighbourhoods
    monkeypatch.setattr(R, "neighbourhoods", lambda *a, **k: calls.append(1) or plain(*a, **k))
    monkeypatch.setattr(R, "adjusted_rand", lambda *a: spark.range(1).select(F.lit(0.0)))  # never agreed
    found, _, trail = R.hmrf_loop(counts, edges, links, labels, k=2, rounds=3, em_rounds=1)
    assert len(trail) == 3 and len(calls) == 1
    # Estimates of sizes multiplied from round to round, to numbers that took minutes to multiply.
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9


@pytest.mark.parametrize("soft", [False, True])
def test_equal_allele_counts_have_one_emission(monkeypatch, soft):
    """Rows of a spot and bin each went through the log gammas of both laws, with their states' parameters beside them."""
    import pyarrow as pa

    from tessera.operators import hmrf as R

    law = np.array([[0.0, 0.1, 0.5, 30.0], [0.4, 0.1, 0.2, 30.0]])
    n, seen, plain = 60, [], R.bb_emissions
    rng = np.random.default_rng(0)
    rows = {"spot": rng.integers(0, 4, n), "umi": rng.integers(0, 9, n), "base": rng.random(n) * 5, "k": np.arange(n) % 3, "depth": np.full(n, 5), "_nd": np.full(n, 2), "_nb": np.full(n, 3)}
    met = [[(c, s, float(rng.random())) for c in (7, 9) for s in ((0, 1) if soft else ((r + c) % 2,))] for r in range(n)]
    batch = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in rows.items()} | {f"_{c}": pa.array([[e[i] for e in m] for m in met]) for i, c in enumerate(("clone", "number", "w"))})
    monkeypatch.setattr(R, "bb_emissions", lambda k, *a: seen.append(len(k)) or plain(k, *a))
    (found,) = R._by_clone(law, soft, ["_nd", "_nb"])(iter([batch]))
    assert sum(seen) == 2 * 3
    want = {}
    for r, m in enumerate(met):
        for c in (7, 9):
            own = [(s, w) for d, s, w in m if d == c]
            one = lambda x: np.array([float(x)])
            ems = [(R.nb_emissions(one(rows["umi"][r]), one(rows["base"][r]), one(law[s, 0]), one(law[s, 1]), None)[0], plain(one(rows["k"][r]), one(5), one(law[s, 2]), one(law[s, 3]), None)[0]) for s, _ in own]
            both = [np.log(sum(np.exp(e[j] + w) for e, (_, w) in zip(ems, own, strict=True))) if soft else sum(e[j] * w for e, (_, w) in zip(ems, own, strict=True)) for j in range(2)]
            want[rows["spot"][r], c] = want.get((rows["spot"][r], c), 0) + np.array(both)
    got = {(r["spot"], r["clone"]): np.array([r["r"], r["b"]]) for r in found.to_pylist()}
    assert got.keys() == want.keys() and all(np.allclose(v, want[k]) for k, v in got.items()) and found.schema.names[-2:] == ["_nd", "_nb"]


def test_inferred_clones_take_whole_genomes_and_all_rounds(spark, small, monkeypatch):
    """One round of two steps on 40 segments stood for an inference of up to 20 rounds of 30 on 2,181."""
    from tessera import catalogue
    from tessera.operators import hmm
    from tessera.plans import pipeline

    met = {}

    def loop(counts, pool, couple, labels, **how):
        met.update(how, bins=counts.select("bin").distinct().count(), last=counts.agg(F.max("bin")).first()[0])
        return labels, hmm.default_states(3), []

    monkeypatch.setattr(pipeline.R, "hmrf_loop", loop)
    rows = catalogue.QUERIES["inferred_clones"](spark, small)
    assert rows.count() == spark.read.parquet(f"{small}/supplier.parquet").count()
    assert (met["rounds"], met["em_rounds"], met["bins"], met["last"]) == (20, 30, 2181, 2180)
