"""Whole inferences composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import copynumber as N
from ..operators import genome as G
from ..operators import graph as X
from ..operators import hmm as H
from ..operators import hmrf as R
from ..operators import simulate as S
from ..operators.aggregate import clone_log_weights, dispersion_over_bins, normal_baseline, pooled, weighted_share
from ..operators.storage import keep


def clone_observations(cells: DataFrame, spots: DataFrame) -> DataFrame:
    """(clone, chr, t, k, depth, umi, base) of ``cells(chr, block, spot, umi, a, b)`` summed over each clone's spots."""
    bulk = cells.join(spots.select("spot", "clone"), "spot").groupBy("clone", "chr", F.col("block").alias("t")).agg(F.sum("umi").alias("umi"), F.sum("b").alias("k"), F.sum(F.col("a") + F.col("b")).alias("depth"))
    return bulk.withColumn("base", F.lit(0.0))


def bins_with_baseline(cells: DataFrame, spots: DataFrame) -> DataFrame:
    """(spot, chr, bin, umi, base, k, depth): counts with what clone 0's profile lets expect."""
    base = normal_baseline(cells, spots.where("clone = 0").select("spot"), ["chr", "block"])
    rows = base.join(cells.select("chr", "block", "spot", "a", "b"), ["chr", "block", "spot"])
    return rows.select("spot", "chr", (F.col("chr") * 100_000 + F.col("block")).alias("bin"), "umi", "base", F.col("b").alias("k"), (F.col("a") + F.col("b")).alias("depth"))


def initial_phase(obs: DataFrame, *, k: int = 5, rounds: int = 20, least: int = 2000, snap: float = 0.05) -> DataFrame:
    """(chr, t, share, phase, segment) of blocks from a phased fit of every clone's ``obs(clone, chr, t, k, depth, …)``.

    Clones with fewer than ``least`` allele reads count as balanced; shares near one half are one
    half; a block whose depth-weighted share is under one half is in phase. Segments are cut where
    a clone's mirrored share jumps.
    """
    obs = keep(obs)  # sums over all spots, read by each step
    deep = obs.groupBy("clone").agg(F.sum("depth").alias("_n")).where(F.col("_n") >= least).select("clone")
    rows = obs.join(deep, "clone", "left_semi").withColumn("switch", F.log(F.lit(0.05)))
    states, _ = H.baum_welch(rows, H.default_states(k), ["clone", "chr"], update="sp", rounds=rounds, switch="switch")
    em = H.emission(states, phased=True, reads=False)
    post = H.posteriors(rows.withColumn("em", em), states, ["clone", "chr"], switch="switch")
    p = F.element_at(F.array(*map(F.lit, states.p)), F.col("state") + 1)
    share = F.when(F.col("phase"), p).otherwise(1 - p)
    fitted = post.select("clone", "chr", "t", F.when(F.abs(share - 0.5) < snap, F.lit(0.5)).otherwise(share).alias("baf"))
    every = keep(obs.join(fitted, ["clone", "chr", "t"], "left").fillna(0.5, ["baf"]))
    whole = weighted_share(every.withColumn("depth", F.col("depth").cast("double")), "baf", "depth", ["chr", "t"])
    profiles = every.groupBy("chr", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("clone", "baf"))), lambda x: x["baf"]).alias("bafs"))
    full = F.size("bafs") == F.max(F.size("bafs")).over(Window.partitionBy("chr"))
    rows = profiles.withColumn("_full", full).where("_full").drop("_full")
    cut = G.profile_segments(rows, keys=("chr",)).select("chr", "t", "segment")
    return whole.join(cut, ["chr", "t"], "left").select("chr", "t", F.coalesce("share", F.lit(0.5)).alias("share"), (F.coalesce("share", F.lit(0.5)) < 0.5).alias("phase"), F.coalesce("segment", F.lit(0).cast("long")).alias("segment"))


def simulated(spark: SparkSession, spots: DataFrame, *, segments: int = 60, size: int = 500, seed: int = 0, events: list[list[tuple]] | None = None) -> DataFrame:
    """(spot, truth, segment, umi, depth, b): counts of spots whose clones are leaves of a grown tree.

    ``events``: (a, b, start, end) lists, one a clone, instead of the tree's.
    """
    if events is None:
        nodes = S.grow_tree(2, segments=segments, size=size, passengers=3, seed=seed)
        parents = {n["parent"] for n in nodes}
        of = {n["id"]: n for n in nodes}

        def walk(i):
            return [] if i is None else walk(of[i]["parent"]) + of[i]["events"]

        events = [[]] + [walk(n["id"]) for n in nodes if n["id"] not in parents]
    rows = [(c, o, int(a), int(b), int(s), int(min(e, segments * size))) for c, own in enumerate(events) for o, (a, b, s, e) in enumerate(own or [(1, 1, 0, size)])]
    table = spark.createDataFrame(rows, "truth int, ordinal int, a int, b int, start long, end long")
    # A clone per third of the tissue, so that neighbours tend to share it.
    clone = (F.floor((F.percent_rank().over(Window.partitionBy("sample").orderBy("x", "y", "spot")) * len(events)).cast("double")).cast("int") % len(events)).alias("truth")
    placed = spots.select("spot", "sample", "x", "y", clone)
    purity = F.when(F.col("truth") > 0, 0.75 + 0.25 * F.pmod(F.xxhash64("spot", F.lit(seed)), F.lit(1000)) / 1000).otherwise(F.lit(0.0))
    ev = placed.join(F.broadcast(table), "truth").select("spot", purity.alias("purity"), "ordinal", "start", "end", "a", "b")
    profile = S.profiles(ev, spark.range(segments).withColumnRenamed("id", "segment"), size)
    drawn = S.simulate_spots(profile, S.poisson_baseline(spark, segments, 50.0, seed), seed=seed)
    return drawn.join(placed.select("spot", "truth"), "spot").select("spot", "truth", "segment", "umi", "depth", "b")


def infer_clones(counts: DataFrame, spots: DataFrame, *, k: int = 3, rounds: int = 20, em_rounds: int = 30, update: str = "smp") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, decoded, copies) of ``counts(spot, chr, bin, umi, base, k, depth)``.

    Graph, field loop from the labels that ``spots`` brings, merging of small clones, a final fit
    of the merged pseudobulks, and integer copies of the states.
    """
    spark = counts.sparkSession
    pool, couple = X.adaptive_graph(spots)
    labels, states, _ = R.hmrf_loop(counts, pool, couple, spots.select("sample", "spot", F.col("clone").alias("label")), k=k, rounds=rounds, em_rounds=em_rounds, update=update)
    totals = counts.groupBy("spot").agg(F.sum("umi").alias("n"))
    merged = R.merge_small_clones(labels, totals, 3, 1)
    bulk = counts.join(merged.select("spot", F.col("label").alias("clone")), "spot").groupBy("clone", "chr", F.col("bin").alias("t")).agg(*(F.sum(c).alias(c) for c in ("umi", "base", "k", "depth")))
    post = H.posteriors(bulk.withColumn("em", H.emission(states, reads="m" in update)), states, ["clone", "chr"])
    decoded = post.select("clone", "chr", F.col("t").alias("bin"), "state")
    rows = weighted_states(decoded, R.states_table(spark, states), bulk.select("clone", F.col("t").alias("bin"), "base"))
    return merged, decoded, N.integer_copies(rows)


def weighted_states(paths: DataFrame, states: DataFrame, bulk: DataFrame) -> DataFrame:
    """(clone, state, bins, weight, log_mu, p): states along each clone's path, means against its baseline.

    ``paths``: ([model,] clone, bin, state); ``states``: ([model,] state, log_mu, p, …), few rows;
    ``bulk``: (clone, bin, base). Clones without a baseline go.
    """
    by = ["model", "state"] if "model" in states.columns and "model" in paths.columns else ["state"]
    held = paths.join(bulk.select("clone", "bin", "base"), ["clone", "bin"], "left")
    rows = held.groupBy("clone", *by).agg(F.count(F.lit(1)).alias("bins"), F.sum(F.coalesce("base", F.lit(0.0))).alias("weight"))
    rows = rows.join(F.broadcast(states.select(*by, "log_mu", "p")), by).select("clone", "state", "bins", "weight", "log_mu", "p")
    return N.adjusted_log_mu(rows, rows)


def copy_stage(paths: DataFrame, states: DataFrame, counts: DataFrame, labels: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(copies, segments) of a finished inference: all four searches of every clone, and the copies of each bin.

    ``counts``: (spot, chr, bin, base, …); ``labels``: (spot, label); the rest as in ``weighted_states``.
    The normal-like clone becomes 0 (its shares lie nearest one half), the others keep their order.
    ``segments``: (search, clone, chr, bin, state, a, b).
    """
    bulk = counts.join(labels.select("spot", F.col("label").alias("clone")), "spot").groupBy("clone", "bin").agg(F.sum("base").alias("base"))
    by = ["model", "state"] if "model" in states.columns and "model" in paths.columns else ["state"]
    shares = paths.join(F.broadcast(states.select(*by, "p")), by).select("clone", "bin", F.col("p").alias("baf"))
    clones = bulk.select("clone").distinct()
    number = R.reindex_normal(clones.select(F.col("clone").alias("spot"), F.col("clone").alias("label")), shares.join(F.broadcast(clones), "clone"))  # a row for each clone
    new = keep(number.select(F.col("spot").alias("clone"), F.col("label").alias("number")))
    rows = weighted_states(paths, states, bulk)
    copies = keep(N.copy_solutions(keep(rows), **how))
    copies = copies.join(F.broadcast(new), "clone").withColumn("clone", F.col("number")).drop("number")
    own = paths.join(F.broadcast(new), "clone").select(F.col("number").alias("clone"), "bin", "state")
    where = counts.select("chr", "bin").distinct()
    segments = own.join(F.broadcast(copies.select("search", "clone", "state", "a", "b")), ["clone", "state"]).join(where, "bin")
    return copies, segments.select("search", "clone", "chr", "bin", "state", "a", "b")


@dataclass(frozen=True)
class Staged:
    """What a staged inference leaves: labels of spots, models of the allele clones, paths and states of all clones."""

    allele_labels: DataFrame
    labels: DataFrame
    models: list
    paths: DataFrame
    states: DataFrame
    llf: float


def merged_clones(obs: DataFrame, models: list, paths: DataFrame, labels: DataFrame, *, reads: bool, threshold: float, least_bins: int, least_spots: int, least_depth: int) -> DataFrame:
    """(sample, spot, model, label): clones of each model that are alike become one, then small ones join the deepest of their model.

    ``obs``: pseudobulks (model, clone, chr, bin, …); ``paths``: (model, clone, bin, state). Clones are
    few: only statistics of their pairs come to the driver.
    """
    em = H.emission_by_model(models[0].k, reads=reads)
    rows = H.with_parameters(obs, models, "model").select("model", "clone", "bin", F.posexplode(em).alias("state", "llf"))
    of = {r.clone: r.model for r in obs.select("model", "clone").distinct().collect()}
    found = [tuple(r) for r in R.similarity_statistics(rows, paths).collect() if of[r.c1] == of[r.c2]]
    new = {}
    for m in set(of.values()):
        for group in R.merge_groups([r for r in found if of[r[0]] == m], [c for c in of if of[c] == m], threshold, least_bins):
            new |= dict.fromkeys(group, min(group))
    table = obs.sparkSession.createDataFrame(list(new.items()), "label int, into int")
    merged = labels.join(F.broadcast(table), "label").select("sample", "spot", "model", F.col("into").alias("label"))  # a row for each clone
    depth = obs.groupBy(F.col("clone").alias("label")).agg(F.sum("depth").alias("n")).join(F.broadcast(table), "label").groupBy(F.col("into").alias("label")).agg(F.sum("n").alias("n"))
    sizes = merged.groupBy("model", "label").agg(F.count(F.lit(1)).alias("spots")).join(depth, "label")
    sizes = sizes.withColumn("ok", (F.col("spots") >= least_spots) & (F.col("n") >= least_depth))
    target = sizes.groupBy("model").agg(F.max_by("label", F.struct("ok", "n", -F.col("label"))).alias("target"))
    to = sizes.join(target, "model").select("label", F.when(F.col("ok"), F.col("label")).otherwise(F.col("target")).alias("into"))
    return merged.join(F.broadcast(to), "label").select("sample", "spot", "model", F.col("into").alias("label"))


def with_normal_baseline(counts: DataFrame, shares: DataFrame, labels: DataFrame, pooling: DataFrame, *, need: int = 200) -> DataFrame:
    """``counts`` with ``base``: what the profile of near-normal spots lets expect, and reads of bins where that is too thin at zero.

    The clone whose allele shares lie nearest one half is normal-like (``shares``: clone, bin, baf);
    of its spots those count whose pooled reads vary least over bins. Bins whose allele share in
    those spots doesn't fit a balanced genome go.
    """
    off = shares.groupBy("clone").agg(F.sum(F.greatest(F.abs(F.col("baf") - 0.5) - 0.05, F.lit(0.0))).alias("off"))
    clone = off.orderBy("off", "clone").first()["clone"]
    own = labels.where(F.col("label") == clone).select("spot")
    bins = counts.select("bin").distinct().count()
    smooth = pooled(counts.select("spot", "bin", "umi"), pooling, ["bin"], ("umi",)).join(own, "spot", "left_semi")
    totals = counts.join(own, "spot", "left_semi").groupBy("spot").agg(F.sum("umi").alias("n"))
    normal = keep(R.near_normal_spots(dispersion_over_bins(smooth, bins), totals, need * bins))
    even = R.normal_bins(counts.join(normal, "spot", "left_semi").groupBy("bin").agg(F.sum("k").alias("k"), F.sum("depth").alias("depth"))).where("kept").select("bin")
    held = counts.join(even, "bin", "left_semi")
    base = normal_baseline(held, normal, ["chr", "bin"]).select("spot", "chr", "bin", "base")
    rows = held.drop("base").join(base, ["spot", "chr", "bin"])
    return rows.withColumn("umi", F.when(F.col("base") > 0, F.col("umi")).otherwise(0))


def staged_clones(counts: DataFrame, spots: DataFrame, *, clones: int = 3, parts: int = 2, k: int = 5, rounds: int = 20, em_rounds: int = 30, weight: float = 1.0, threshold: float = 1.0, least_bins: int = 10, least_spots: int = 3, least_depth: int = 1, nodes: str = "max", baseline: bool = True, links: DataFrame | None = None, seed: int = 0, telemetry: str | None = None) -> Staged:
    """Clones from allele shares, their merging, refinement of all of them with reads in one job a step, and a last labelling over all.

    ``counts``: (spot, chr, bin, umi, base, k, depth); ``spots``: (spot, sample, x, y); ``links``:
    (src, dst, weight) between samples. ``baseline``: take ``base`` from near-normal spots of the
    first stage rather than from ``counts``. An allele clone with fewer than 20 allele reads a bin
    isn't split. ``nodes``: how a spot's likelihood takes a clone's states, "max" or "weighted_sum".
    Dispersions of the last labelling are the largest of reads and the smallest concentration of
    alleles over all models.
    """
    spark = counts.sparkSession
    counts = keep(counts.select("spot", "chr", "bin", "umi", "base", "k", "depth"))
    spots = keep(spots.select("spot", "sample", "x", "y"))
    pool, couple = X.adaptive_graph(spots)
    pool, couple = keep(pool), keep(X.with_links(couple, links))

    def lattices(obs: DataFrame, models: list, reads: bool) -> DataFrame:
        em = H.emission_by_model(models[0].k, reads=reads)
        return keep(H.posteriors(H.with_parameters(obs, models, "model").withColumn("em", em), models, ["model", "clone", "chr"], model="model"))

    # Clones by allele shares alone.
    alleles = counts.withColumn("umi", F.lit(0).cast("long")).withColumn("base", F.lit(0.0))
    first = S.random_rectangles(spots, clones, seed).select("sample", "spot", F.lit(0).alias("model"), F.col("clone").alias("label"))
    start = H.gmm_states(R.clone_bulk(alleles, first), k, seed)
    how = {"rounds": rounds, "em_rounds": em_rounds, "weight": weight, "nodes": nodes, "telemetry": telemetry}
    labels, models, _ = R.field_loop(alleles, pool, couple, first, [start], update="sp", **how)
    obs = keep(R.clone_bulk(alleles, labels))
    paths = R.clone_paths(lattices(obs, models, False))
    limits = {"threshold": threshold, "least_bins": least_bins, "least_spots": least_spots, "least_depth": least_depth}
    merged = keep(merged_clones(obs, models, paths.drop("model"), labels, reads=False, **limits))
    ids = sorted(r[0] for r in merged.select("label").distinct().collect())
    number = F.array_position(F.lit(ids), F.col("label")).cast("int") - 1
    allele = keep(merged.select("sample", "spot", number.alias("label")))

    # Reads come back, and every allele clone is split, all together.
    if baseline:
        shares = R.clone_bulk(counts, allele.withColumn("model", F.lit(0))).select("clone", "bin", (F.col("k") / F.nullif("depth", F.lit(0))).alias("baf")).where("baf is not null")
        counts = keep(with_normal_baseline(counts, shares, allele, pool))
    depth = counts.join(allele.select("spot", "label"), "spot").groupBy("label").agg(F.sum("depth").alias("n"))
    bins = counts.select("bin").distinct().count()
    deep = [r.label for r in depth.where(F.col("n") >= 20 * bins).collect()]
    placed = spots.join(allele.select("spot", F.col("label").alias("model")), "spot")
    begun = None
    for m in range(len(ids)):  # the rectangles of each clone
        own = placed.where(F.col("model") == m)
        own = S.random_rectangles(own, parts, seed) if m in deep else own.withColumn("clone", F.lit(0))
        own = own.select("sample", "spot", "model", (F.col("model") * parts + F.col("clone")).cast("int").alias("label"))
        begun = own if begun is None else begun.unionByName(own)
    begun = keep(begun)
    start = H.gmm_states(R.clone_bulk(counts, begun), k, seed)
    labels, models, _ = R.field_loop(counts, pool, couple, begun, [start] * len(ids), update="smp", **how)

    # Merge again, fit once more, and join states that are alike.
    obs = keep(R.clone_bulk(counts, labels))
    paths = R.clone_paths(lattices(obs, models, True))
    labels = keep(merged_clones(obs, models, paths.drop("model"), labels, reads=True, **limits))
    obs = keep(R.clone_bulk(counts, labels))
    models, _ = H.fit_together(obs, models, ["model", "clone", "chr"], rounds=em_rounds, update="smp", telemetry=telemetry)
    post = lattices(obs, models, True)
    em = H.emission_by_model(k)
    rows = H.with_parameters(obs, models, "model").select("clone", "bin", F.posexplode(em).alias("state", "llf"))
    of = {r.clone: (r.model, r.n) for r in obs.groupBy("model", "clone").agg(F.sum("depth").alias("n")).collect()}
    paths = R.clone_paths(post)
    same = [tuple(r) for r in R.similarity_statistics(rows, paths.drop("model")).collect() if of[r.c1][0] == of[r.c2][0]]
    joined = R.combine_similar_states(paths.drop("model"), same, {c: n for c, (_, n) in of.items()})
    model = F.get(F.array(*(F.lit(of[c][0] if c in of else None).cast("int") for c in range(max(of) + 1))), F.col("clone"))
    paths = keep(joined.withColumn("model", model))

    # One labelling over the clones of all models.
    alpha, tau = max(max(m.alpha) for m in models), min(min(m.tau) for m in models)
    states = keep(R.models_table(spark, models).withColumn("alpha", F.lit(alpha)).withColumn("tau", F.lit(tau)))
    given = paths if nodes == "max" else R.clone_paths(post, nodes)
    llf = keep((R.spot_llf if nodes == "max" else R.posterior_spot_llf)(counts, pool, given, states))
    prior = clone_log_weights(labels.select("sample", F.col("label").alias("clone")), labels.select(F.col("label").alias("clone")).distinct())
    last = keep(R.icm(llf, couple, labels.select("sample", "spot", "label"), weight=weight, log_prior=prior))
    total = R.total_llf(last.select("spot", "label"), llf, couple, weight).first()[0]
    return Staged(allele, last, models, paths, states, float(total))


def round_trip(spark: SparkSession, spots: DataFrame, *, segments: int = 2181, seed: int = 0) -> DataFrame:
    """(spot, truth, label): clones planted in simulated spots beside those inferred from their counts.

    ``segments``: by default those of a whole genome; planted events take the same shares of it
    whatever their number. The inference runs until its labels agree, as in ``infer_clones``.
    """
    size = 500

    def event(a: int, b: int, start: int, end: int) -> tuple[int, int, int, int]:
        return a, b, segments * start // 40 * size, segments * end // 40 * size

    events = [[], [event(2, 0, 0, 15), event(3, 1, 25, 35)], [event(1, 0, 10, 25), event(2, 1, 0, 5)]]
    drawn = simulated(spark, spots, segments=segments, size=size, seed=seed, events=events).persist()
    rows = drawn.withColumn("chr", F.expr(f"cast(1 + segment div {max(1, segments // 4)} as int)"))
    normal = rows.where("truth = 0").groupBy("segment").agg(F.sum("umi").alias("w"))
    share = normal.join(normal.agg(F.sum("w").alias("t"))).select("segment", (F.col("w") / F.nullif("t", F.lit(0))).alias("share"))
    total = rows.groupBy("spot").agg(F.sum("umi").alias("total"))
    counts = rows.join(F.broadcast(share), "segment", "left").join(total, "spot").select("spot", "chr", F.col("segment").alias("bin"), "umi", (F.coalesce("share", F.lit(0.0)) * F.col("total")).alias("base"), F.col("b").alias("k"), "depth")
    start = S.random_rectangles(spots.drop("clone"), 3, seed)
    labels, _, _ = infer_clones(counts, start)
    return drawn.select("spot", "truth").distinct().join(labels, "spot")
