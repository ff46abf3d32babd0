"""Label fields and simulated spots: work that once grew with clones, shuffles or groups of one spot."""


def test_an_emission_is_computed_once_for_all_clones(spark, monkeypatch):
    """Every clone of a spot's bin, and every state of it, was once a row of its own with its own emissions."""
    from pyspark.sql import functions as F

    from tessera.functions import columns as C
    from tessera.operators import hmrf as R
    from tessera.operators.hmm import States

    states = States(p=(0.5, 0.3, 0.15), tau=(30.0,) * 3, log_mu=(0.0, 0.3, -0.4), alpha=(0.1,) * 3)
    i = F.col("id")
    counts = spark.range(60).select(F.floor(i / 6).alias("spot"), (i % 6).alias("bin"), (i * 7 % 13).alias("umi"), (4.0 + i % 3).alias("base"), (i % 4).alias("k"), F.when(i % 5 == 0, 0).otherwise(4).cast("long").alias("depth"))
    edges = spark.range(28).select(F.floor((i + 2) / 3).alias("src"), (i + 1 - 2 * F.floor((i + 2) / 3)).alias("dst"))  # each spot, the one before and the one after
    edges = edges.where("dst between 0 and 9")
    table = R.states_table(spark, states)
    soft = spark.range(4 * 6 * 3).select((i % 4).alias("clone"), (F.floor(i / 4) % 6).alias("bin"), F.floor(i / 24).cast("int").alias("state"))
    soft = soft.where("not (clone = 3 and bin = 2)").withColumn("log_gamma", F.log(F.lit(0.2) + F.col("state") * 0.1))
    hard = soft.where("state = (clone + bin) % 3").drop("log_gamma")

    seen, plain = spark.sparkContext.accumulator(0), R.nb_emissions

    def count(k, *others):
        seen.add(len(k))
        return plain(k, *others)

    monkeypatch.setattr(R, "nb_emissions", count)
    sums = edges.join(counts, edges["dst"] == counts["spot"]).groupBy(F.col("src").alias("spot"), "bin").agg(*(F.sum(c).alias(c) for c in ("umi", "base", "k", "depth")))
    r, b = C.nb_emission(*map(F.col, ("umi", "base", "log_mu", "alpha"))), C.bb_emission(*map(F.col, ("k", "depth", "p", "tau")))
    rows = lambda paths: sums.join(paths, "bin").join(table, "state").withColumns({"r": r, "b": b})
    ratio = lambda df, by: {x["s"]: x["nd"] / x["nb"] if x["nd"] and x["nb"] else 1.0 for x in df.groupBy(F.col(by).alias("s")).agg(F.count_if(F.col("depth") > 0).alias("nd"), F.count_if(F.col("base") > 0).alias("nb")).collect()}
    near, own = ratio(edges.join(counts, edges["dst"] == counts["spot"]), "src"), ratio(counts, "spot")
    by_path = {(x.spot, x.clone): near[x.spot] * x.r + x.b for x in rows(hard).groupBy("spot", "clone").agg(F.sum("r").alias("r"), F.sum("b").alias("b")).collect()}
    lse = lambda c: F.log(F.sum(F.exp(F.col(c) + F.col("log_gamma"))))
    by_states = {(x.spot, x.clone): own[x.spot] * x.r + x.b for x in rows(soft).groupBy("spot", "clone", "bin").agg(lse("r").alias("r"), lse("b").alias("b")).groupBy("spot", "clone").agg(F.sum("r").alias("r"), F.sum("b").alias("b")).collect()}
    for score, paths, expected in ((R.spot_llf, hard, by_path), (R.posterior_spot_llf, soft, by_states)):
        before = seen.value
        found = {(x.spot, x.clone): x.llf for x in score(counts, edges, paths, table).collect()}
        assert found.keys() == expected.keys() and len(found) == 40
        assert all(abs(found[c] - v) < 1e-9 * (1 + abs(v)) for c, v in expected.items())
        assert seen.value - before == 10 * 6 * 3  # spots, bins, states; clones don't count


def test_sums_by_spot_and_chromosome_take_the_shuffle_of_blocks(spark, small, monkeypatch):
    """Sums of a field by spot and chromosome once shuffled the sums by block again."""
    from pyspark.sql import functions as F

    from tessera import catalogue as Q
    from tessera.plans import bindings as B

    monkeypatch.setattr(B, "TASK_ROWS", 200)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    blocks = Q._in_blocks(spark, small)
    assert 0 < shuffles(blocks) == shuffles(blocks.groupBy("spot", "chr").agg(F.sum("umi")))


def test_spots_are_drawn_in_batches_as_in_a_plain_loop(spark):
    """Each spot was once a Python group of its own, which took 7 ms before its first draw."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.operators import simulate as S

    i = F.col("id")
    profile = spark.range(300).select(F.floor(i / 6).alias("spot"), (i % 6).alias("segment"), (0.5 + i % 4 / 2).alias("rdr"), (i % 5 / 8).alias("baf"))
    weights = spark.range(6).select(i.alias("segment"), F.when(i == 4, 0.0).otherwise((1 + i) / 17).alias("weight"))
    found = S.simulate_spots(profile, weights, seed=5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    expected, w = [], np.array([1, 2, 3, 4, 0, 6]) / 17
    w = w / w.sum()
    for spot in range(50):
        at = np.arange(6) + 6 * spot
        rng = np.random.default_rng((5, spot))
        reads, snps = 10 ** rng.normal(3.5, 0.16), 10 ** rng.normal(2.6, 0.15)
        depth, baf = S.segment_draws(rng, int(snps), w), at % 5 / 8
        share = rng.beta(1 + 10 * baf, 1 + 10 * (1 - baf))
        umi = S.negative_binomial(rng, reads * w * (0.5 + at % 4 / 2), 0.1)
        expected += zip([spot] * 6, range(6), umi.tolist(), depth.tolist(), rng.binomial(depth, share).tolist(), strict=True)
    assert sorted(map(tuple, found.collect())) == expected
