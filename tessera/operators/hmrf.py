"""Clones as a hidden Markov random field over spots.

The emission of a spot under a clone is that of the clone's decoded path only: predictions join
first, so no table of states x bins x spots exists. Label updates are sequential (each uses its
neighbours' newest labels) over all samples and the links between them, tile by tile (``sweep``).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import logsumexp
from .aggregate import adjusted_rand, clone_log_weights, order_statistics
from .fit import fit_normal_shares, np_bb
from .hmm import States, fit_together, gmm_states, posteriors_by_model
from .lattice import bb_emissions, distinct, nb_emissions
from .storage import keep, stored
from .sweep import TILE, Field

#: Bins up to which their clones and states are broadcast, if these are at most five times as many (some 40 MB).
BROADCAST_BINS = 200_000


def states_table(spark, states: States) -> DataFrame:
    """(state, log_mu, alpha, p, tau): K rows."""
    mu, alpha = states.log_mu or (0.0,) * states.k, states.alpha or (0.1,) * states.k
    return spark.createDataFrame([(i, float(m), float(a), float(p), float(t)) for i, (m, a, p, t) in enumerate(zip(mu, alpha, states.p, states.tau, strict=True))], "state int, log_mu double, alpha double, p double, tau double")


def models_table(spark, models: Sequence[States], model: str = "model") -> DataFrame:
    """(model, state, log_mu, alpha, p, tau): the states of every model."""
    rows = [states_table(spark, m).withColumn(model, F.lit(i)) for i, m in enumerate(models)]
    return functools.reduce(DataFrame.unionByName, rows)


def _paths(paths: DataFrame, states: DataFrame) -> DataFrame:
    """Paths with their states' parameters; ``states`` is keyed by state, or by model and state."""
    return paths.join(F.broadcast(states), [c for c in ("model", "state") if c in states.columns])  # K rows a model


def _menu(paths: DataFrame, states: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """(bin, [model], who): in a row for each bin its clones with the numbers of the states that they meet there and their weights."""
    met = _paths(paths, states).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("clone", "number", weight.cast("double").alias("w")))).alias("who"))
    return met.select(*by, *(F.col(f"who.{c}").alias(f"_{c}") for c in ("clone", "number", "w")))


def _numbered(states: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(keys of states with their numbers, their parameters [number, (log_mu, alpha, p, tau)]): K rows a model."""
    names = [c for c in ("model", "state") if c in states.columns]
    rows = states.select(*names, *(F.col(c).cast("double") for c in ("log_mu", "alpha", "p", "tau"))).orderBy(*names).collect()
    keys = states.sparkSession.createDataFrame([(*map(int, r[: len(names)]), i) for i, r in enumerate(rows)], ", ".join(f"{c} int" for c in (*names, "number")))
    return keys, np.array([[np.nan if x is None else x for x in r[len(names) :]] for r in rows], float).reshape(-1, 4)


def _by_clone(law: np.ndarray, soft: bool, observed: list[str]):
    """Sums (spot, clone, r, b, …) of a batch's rows: log-emissions of the states that a clone meets, weighted and summed, or summed out by log-weights (``soft``).

    A row's emission is computed once for all clones that meet its state; those of equal allele counts once in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            umi, base, k, depth, *pure = (np.asarray(rows.column(c).cast(pa.float64()).fill_null(np.nan)) for c in ("umi", "base", "k", "depth", *(c for c in ("_pure",) if c in rows.schema.names)))
            whose = rows.column("_clone").flatten()
            at = np.repeat(np.arange(rows.num_rows), np.asarray(rows.column("_clone").value_lengths()))
            number, w = np.asarray(rows.column("_number").flatten()), np.asarray(rows.column("_w").flatten().fill_null(np.nan))
            first, same = distinct(k, depth, *pure)
            reads, alleles = np.empty(len(at)), np.empty(len(at))
            for s in np.unique(number):
                own, of = np.unique(at[number == s], return_inverse=True)
                log_mu, alpha, p, tau = (np.full(len(own), x) for x in law[s])
                reads[number == s] = nb_emissions(umi[own], base[own], log_mu, alpha, pure[0][own] if pure else None)[of]
                used, found = np.zeros(len(first), bool), np.zeros(len(first))
                used[same[own]] = True
                some = first[used]
                found[used] = bb_emissions(k[some], depth[some], np.full(len(some), law[s, 2]), np.full(len(some), law[s, 3]), pure[0][some] if pure else None)
                alleles[number == s] = found[same[own]][of]
            spot, place = distinct(np.asarray(rows.column("spot")))
            clone, which = distinct(np.asarray(whose))
            slot = place[at] * len(clone) + which
            parts = []
            if soft:  # a row's clone has its states one after the other
                opens = np.flatnonzero(np.diff(at * len(clone) + which, prepend=-1))
                group = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(at)))
            with np.errstate(all="ignore"):
                for em in (reads, alleles):
                    if soft:
                        v = em + w
                        top = np.maximum.reduceat(v, opens)
                        v, to = top + np.log(np.add.reduceat(np.exp(v - top[group]), opens)), slot[opens]
                    else:
                        v, to = w * em, slot
                    known = ~np.isnan(v)
                    n = len(spot) * len(clone)
                    parts.append(np.where(np.bincount(to, known, n) > 0, np.bincount(to, np.where(known, v, 0.0), n), np.nan))
            met = np.unique(slot)
            seat = pa.array(spot[met // len(clone)])
            more = [rows.column(c).take(seat) for c in observed]
            yield pa.RecordBatch.from_arrays([rows.column("spot").take(seat), whose.take(pa.array(clone[met % len(clone)])), *(pa.array(x[met], from_pandas=True) for x in parts), *more], ["spot", "clone", "r", "b", *observed])

    return run


def _clone_llf(sums: DataFrame, paths: DataFrame, states: DataFrame, key: str, soft: bool) -> DataFrame:
    """(spot, clone, llf) of ``neighbourhoods``, read and allele parts summed over bins.

    A spot's bin is one row, with all its clones, or where ``sums`` has a ``model`` with that model's.
    Few bins are broadcast: a join that shuffles by bin has no more tasks than there are bins.
    """
    by = [c for c in (key, "model") if c in sums.columns]
    keys, law = _numbered(states)
    weight = F.col("log_gamma") if soft else F.col("weight") if "weight" in paths.columns else F.lit(1.0)
    menu = keep(_menu(paths, keys, weight, by))
    bins, entries = menu.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_clone")), F.lit(0))).first()
    rows = sums.join(F.broadcast(menu) if bins <= BROADCAST_BINS and entries <= 5 * BROADCAST_BINS else menu, by)
    rows = rows.select("spot", "umi", "base", "k", "depth", *(c for c in sums.columns if c.startswith("_")), "_clone", "_number", "_w")
    kinds = {"spot": sums, "clone": paths, "_nd": sums, "_nb": sums}
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in kinds.items()}
    found = rows.mapInArrow(_by_clone(law, soft, ["_nd", "_nb"]), f"spot {kinds['spot']}, clone {kinds['clone']}, r double, b double, _nd {kinds['_nd']}, _nb {kinds['_nb']}")
    found = found.groupBy("spot", "clone").agg(*(F.sum(c).alias(c) for c in "rb"), *(F.first(c).alias(c) for c in ("_nd", "_nb")))
    return found.select("spot", "clone", (_ratio() * F.col("r") + F.col("b")).alias("llf"))


def neighbourhoods(counts: DataFrame, edges: DataFrame, key: str = "bin", purity: str | None = None, groups: DataFrame | None = None, *, soft: bool = False) -> DataFrame:
    """(spot, bin, [model], umi, base, k, depth, _nd, _nb, [_pure]): sums over each spot's neighbourhood, and how many observations it has and its mean ``purity``, in one pass.

    With ``soft`` the observations are the spot's own. What no model changes: rounds of a labelling read it again.
    """
    spark = counts.sparkSession
    more = {} if soft else {"_nd": F.when(F.col("depth") > 0, 1).otherwise(0), "_nb": F.when(F.col("base") > 0, 1).otherwise(0)}
    if purity:
        more |= {"_q": F.col(purity).cast("double"), "_n": F.when(F.col(purity).isNotNull(), 1).otherwise(0)}
    own = (counts.withColumns(more) if more else counts).withColumnRenamed("spot", "_near")
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but each row has emissions
    met = edges.select(F.col("src").alias("spot"), F.col("dst").alias("_near")).join(own, "_near").repartition(tasks, "spot")  # sums by spot that follow need no further shuffle
    sums = met.groupBy("spot", key).agg(*(F.sum(c).alias(c) for c in ("umi", "base", "k", "depth", *more)))
    every = Window.partitionBy("spot")
    if more:
        sums = sums.withColumns({c: F.sum(c).over(every) for c in more})
    if purity:
        sums = sums.withColumn("_pure", F.col("_q") / F.nullif("_n", F.lit(0))).drop("_q", "_n")
    if soft:
        sums = sums.join(counts.groupBy("spot").agg(F.count_if(F.col("depth") > 0).alias("_nd"), F.count_if(F.col("base") > 0).alias("_nb")), "spot", "left")
    return sums if groups is None else sums.join(groups.select("spot", "model"), "spot")


def _ratio() -> Column:
    """Allele observations for one read observation."""
    return F.when((F.col("_nd") > 0) & (F.col("_nb") > 0), F.col("_nd") / F.col("_nb")).otherwise(F.lit(1.0))


def spot_llf(counts: DataFrame, edges: DataFrame, decoded: DataFrame, states: DataFrame, key: str = "bin", purity: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(spot, clone, llf) of neighbourhood-pooled ``counts(spot, bin, umi, base, k, depth)`` under each clone's path.

    ``decoded``: (clone, bin, state) or, weighted by a posterior, with a ``weight``. Read counts
    are scaled by how many allele observations there are for one read observation, both over the
    neighbourhood. ``purity`` (a column of ``counts``) averages over the neighbourhood. With
    ``groups(spot, model)``, paths and states carry a ``model``, and a spot meets its own model's clones.
    """
    return _clone_llf(neighbourhoods(counts, edges, key, purity, groups), decoded, states, key, False)


def posterior_spot_llf(counts: DataFrame, edges: DataFrame, posterior: DataFrame, states: DataFrame, key: str = "bin", purity: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(spot, clone, llf) of pooled counts with a clone's state summed out by its posterior.

    ``posterior``: (clone, bin, state, log_gamma). Read and allele parts are summed out apart; read
    parts are scaled by how many allele observations the spot itself has for one read observation.
    """
    return _clone_llf(neighbourhoods(counts, edges, key, purity, groups, soft=True), posterior, states, key, True)


def final_labels(counts: DataFrame, pooling: DataFrame, coupling: DataFrame, labels: DataFrame, paths: DataFrame, states: DataFrame, *, weight: float = 1.0, log_prior: DataFrame | None = None, purity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((sample, spot, label, posterior), (llf)): one sweep of labels under fixed models.

    ``paths``: decoded states (clone, bin, state), or posteriors with a ``log_gamma``; with or
    without ``purity``: four forms.
    """
    score = posterior_spot_llf if "log_gamma" in paths.columns else spot_llf
    llf = keep(score(counts, pooling, paths, states, purity=purity))
    found = icm(llf, coupling, labels, weight=weight, sweeps=1, log_prior=log_prior)
    return found, total_llf(found.select("spot", "label"), llf, coupling, weight)


def icm(llf: DataFrame, edges: DataFrame, labels: DataFrame, *, weight: float = 1.0, tol: float = 0.1, sweeps: int = 100, log_prior: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(sample, spot, label, posterior): iterated conditional modes on all samples as one graph.

    ``llf``: (spot, clone, llf), of a few clones, read twice; ``edges``: (src, dst, weight), within samples and
    between them; ``labels``: (sample, spot, label). Spots are visited in order of their ids; a sweep
    that changes less than ``tol`` of them is the last. Ties go to the first clone; a spot without a
    clone's likelihood doesn't take that clone. ``log_prior``: (sample, clone, log_weight).
    """
    scores = labels.join(llf, "spot")
    if log_prior is not None:
        scores = scores.join(log_prior, ["sample", "clone"], "left").withColumn("llf", F.col("llf") + F.coalesce("log_weight", F.lit(0.0)))
    clones = sorted(r[0] for r in llf.select("clone").distinct().collect())
    each = F.array(*(F.coalesce(F.max(F.when(F.col("clone") == c, F.col("llf"))), F.lit(-1e300)) for c in clones))
    field = Field(scores.groupBy(F.col("spot").alias("node")).agg(each.alias("score")), edges, weight, tile)
    number = F.array(*(F.lit(c) for c in clones))
    state = field.start(labels.select(F.col("spot").alias("node"), (F.array_position(number, F.col("label")) - 1).alias("label")).where("label >= 0"))
    for _ in range(sweeps):
        state, edits = field.sweep(state)
        if not edits or edits < tol * field.size:
            break
    parts = F.transform("cost", lambda x: F.exp(x - F.array_max("cost")))
    soft = F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))
    found = state.select(F.col("node").alias("spot"), number[F.col("now")].alias("label"), soft.alias("posterior"))
    return labels.select("sample", "spot").join(found, "spot").select("sample", "spot", "label", "posterior")


def total_llf(labelled: DataFrame, llf: DataFrame, edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """(llf): Σ of the spots under their labels plus ``weight`` for each directed edge between like labels."""
    node = labelled.join(llf, (labelled["spot"] == llf["spot"]) & (labelled["label"] == llf["clone"])).agg(F.coalesce(F.sum("llf"), F.lit(0.0)).alias("node"))
    a, b = (labelled.select(F.col("spot").alias(c), F.col("label").alias(f"_{c}")) for c in ("src", "dst"))
    like = edges.join(a, "src").join(b, "dst").where(F.col("_src") == F.col("_dst")).agg(F.count(F.lit(1)).alias("n"))
    return node.join(like).select((F.col("node") + weight * F.col("n")).alias("llf"))  # one row each


def clone_paths(post: DataFrame, nodes: str = "max") -> DataFrame:
    """(model, clone, bin, state, [log_gamma]) of lattice rows (model, clone, t, …): each bin's state, or all states with their posteriors.

    ``nodes``: "max" or "weighted_sum", how a spot's likelihood takes a clone's states.
    """
    if nodes == "max":
        return post.select("model", "clone", F.col("t").alias("bin"), "state")
    if nodes != "weighted_sum":
        raise ValueError(f"no node potential {nodes!r}: max or weighted_sum")
    return post.select("model", "clone", F.col("t").alias("bin"), F.posexplode("log_gamma").alias("state", "log_gamma"))


def clone_bulk(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(model, clone, chr, bin, t, umi, base, k, depth) of the spots of each label (sample, spot, model, label)."""
    bulk = counts.join(labels.select("spot", "model", F.col("label").alias("clone")), "spot").groupBy("model", "clone", "chr", "bin").agg(*(F.sum(c).alias(c) for c in ("umi", "base", "k", "depth")))
    return bulk.withColumn("t", F.col("bin"))


def field_loop(counts: DataFrame, pooling: DataFrame, coupling: DataFrame, labels: DataFrame, start: Sequence[States], *, rounds: int = 3, em_rounds: int = 4, weight: float = 1.0, update: str = "sp", inertia: bool = False, nodes: str = "max", telemetry: str | None = None) -> tuple[DataFrame, list[States], list[float]]:
    """(labels, models, agreements): alternate models of the clones' pseudobulks with a labelling of the spots, for many models in one job a step.

    ``counts``: (spot, chr, bin, umi, base, k, depth); ``labels``: (sample, spot, model, label), where
    a label is one of its model's clones; ``start``: a start for each model. Models share no spots
    and no clones: links between spots of different models don't count. Stops where the labelling
    agrees with the one before (adjusted Rand index over 0.99) or each model has one clone;
    clones without spots drop out by themselves. Labels are a checkpointed table of one row a spot
    in every round, so plans don't grow.
    """
    spark, models, trail = counts.sparkSession, list(start), []
    counts = keep(counts)  # read in every round
    groups = keep(labels.select("spot", "model"))
    a, b = (groups.select(F.col("spot").alias(c), F.col("model").alias(f"_{c}")) for c in ("src", "dst"))
    own = keep(coupling.select("src", "dst", "weight").join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst", "weight"))
    soft = nodes != "max"
    sums = neighbourhoods(counts, pooling, groups=groups, soft=soft).persist()
    for _ in range(rounds):
        obs = keep(clone_bulk(counts, labels))
        models, _ = fit_together(obs, models, ["model", "clone", "chr"], rounds=em_rounds, update=update, telemetry=telemetry)
        post = posteriors_by_model(obs, models, ["model", "clone", "chr"], reads="m" in update)
        llf = keep(_clone_llf(sums, clone_paths(post, nodes), models_table(spark, models), "bin", soft))
        prior = clone_log_weights(labels.select("sample", F.col("label").alias("clone")), labels.select(F.col("label").alias("clone")).distinct()) if inertia else None
        new = stored(icm(llf, own, labels.select("sample", "spot", "label"), weight=weight, log_prior=prior).select("sample", "spot", "label").join(groups, "spot"))
        both = labels.select("spot", F.col("label").alias("old")).join(new, "spot")
        trail.append(float(adjusted_rand(both, "old", "label").head()[0]))
        labels = new.select("sample", "spot", "model", "label")
        if trail[-1] > 0.99 or labels.select("model", "label").distinct().count() <= len(models):
            break
    sums.unpersist()
    return labels, models, trail


def hmrf_loop(counts: DataFrame, pooling: DataFrame, coupling: DataFrame, labels: DataFrame, *, k: int = 3, update: str = "sp", **how) -> tuple[DataFrame, States, list[float]]:
    """``field_loop`` of one model of k states from a mixture start: (labels, states, agreements) of ``labels(sample, spot, label)``."""
    marked, counts = labels.withColumn("model", F.lit(0)), keep(counts)
    start = gmm_states(clone_bulk(counts, marked), k)
    found, (states,), trail = field_loop(counts, pooling, coupling, marked, [start], update=update, **how)
    return found.drop("model"), states, trail


def similarity_statistics(clone_llf: DataFrame, decoded: DataFrame, key: str = "bin", shares: Sequence[float] | None = None) -> DataFrame:
    """(c1, c2, s1, s2, n, t): for bins where two clones differ, the mean gain of own states over swapped ones.

    ``clone_llf``: (clone, bin, state, llf) of every state; ``decoded``: (clone, bin, state). With
    ``shares`` (one of K states) there are 2K states, the second half of them in the other phase:
    a swapped state keeps its clone's phase, or turns it where the two shares lie on either side
    of one half.
    """
    own = decoded.join(clone_llf, ["clone", key, "state"]).select("clone", key, "state", F.col("llf").alias("own"))
    pairs = own.select(key, F.col("clone").alias("c1"), F.col("state").alias("f1"), F.col("own").alias("o1")).join(own.select(key, F.col("clone").alias("c2"), F.col("state").alias("f2"), F.col("own").alias("o2")), key).where(F.col("c1") < F.col("c2"))
    if shares is None:
        pairs = pairs.withColumns({"s1": F.col("f1"), "s2": F.col("f2"), "w1": F.col("f2"), "w2": F.col("f1")})
    else:
        k, high = len(shares), F.array(*(F.lit(bool(p > 0.5)) for p in shares))
        pairs = pairs.withColumns({"s1": F.col("f1") % k, "s2": F.col("f2") % k})
        turn = high[F.col("s1")] != high[F.col("s2")]
        pairs = pairs.withColumns({f"w{i}": F.when((F.col(f"f{i}") >= k) != turn, F.lit(k)).otherwise(F.lit(0)) + F.col(f"s{j}") for i, j in ((1, 2), (2, 1))})
    pairs = pairs.where(F.col("s1") != F.col("s2"))
    one, two = (clone_llf.select(F.col("clone").alias(f"c{i}"), key, F.col("state").alias(f"w{i}"), F.col("llf").alias(f"v{i}")) for i in (1, 2))
    swapped = pairs.join(one, ["c1", key, "w1"]).join(two, ["c2", key, "w2"])
    gain = (F.col("o1") - F.col("v1") + F.col("o2") - F.col("v2")) / 2
    return swapped.groupBy("c1", "c2", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.avg(gain).alias("t"))


def merge_groups(statistics: list[tuple], clones: Sequence[int], threshold: float = 1.0, least_bins: int = 10) -> list[list[int]]:
    """Groups of like clones: maximal cliques, large ones and then those of small weight first, as long as they are disjoint.

    ``statistics``: rows (c1, c2, s1, s2, n, t) of a few clones. Two clones are like if none of
    their state pairs has ``least_bins`` bins or the largest t of those is under the threshold.
    """
    edge: dict[tuple[int, int], float] = {}
    for c1, c2 in itertools.combinations(sorted(clones), 2):
        t = [r[5] for r in statistics if (r[0], r[1]) == (c1, c2) and r[4] >= least_bins]
        if not t or max(t) < threshold:
            edge[c1, c2] = max(t) if t else 1e-3
    near = {c: {b if a == c else a for a, b in edge if c in (a, b)} for c in clones}
    found: list[tuple[int, ...]] = []

    def grow(chosen: set, open_: set, shut: set) -> None:
        if not open_ and not shut:
            found.append(tuple(sorted(chosen)))
            return
        pivot = max(open_ | shut, key=lambda c: len(near[c] & open_))
        for c in sorted(open_ - near[pivot]):
            grow(chosen | {c}, open_ & near[c], shut & near[c])
            open_, shut = open_ - {c}, shut | {c}

    grow(set(), set(clones), set())
    weight = lambda c: sum(edge[p] for p in itertools.combinations(c, 2))
    out, used = [], set()
    for c in sorted(found, key=lambda c: (-len(c), weight(c), c)):
        if not used & set(c):
            out.append(list(c))
            used |= set(c)
    out += [[c] for c in sorted(set(clones) - used)]
    return sorted(out)


def combine_similar_states(decoded: DataFrame, statistics: list[tuple], depths: dict[int, int], threshold: float = 0.1, key: str = "bin") -> DataFrame:
    """``decoded`` with states of shallower clones copied from deeper ones where swapping them costs under ``threshold``.

    Pairs apply in order (c1, c2, s1, s2) to the states of all clones at a bin, in one pass; there
    are few clones and states.
    """
    rules = []
    for c1, c2, s1, s2, _, t in sorted(r for r in statistics if r[5] < threshold):
        (keep_, ks), (turn, ts) = ((c1, s1), (c2, s2)) if depths.get(c1, 0) >= depths.get(c2, 0) else ((c2, s2), (c1, s1))
        rules.append(f"({keep_}, {ks}, {turn}, {ts})")
    if not rules:
        return decoded.select("clone", key, "state")
    given = F.expr("transform(array(" + ", ".join(rules) + "), r -> named_struct('keep', r.col1, 'ks', r.col2, 'turn', r.col3, 'ts', r.col4))")
    at = decoded.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("clone").cast("int"), F.col("state").cast("int")))).alias("states"))

    def turned(states: Column, rule: Column) -> Column:
        hit = (F.try_element_at(states, rule["keep"]) == rule["ks"]) & (F.try_element_at(states, rule["turn"]) == rule["ts"])
        return F.when(hit, F.transform_values(states, lambda c, s: F.when(c == rule["turn"], rule["ks"]).otherwise(s))).otherwise(states)

    return at.select(key, F.explode(F.aggregate(given, F.col("states"), turned)).alias("clone", "state")).select("clone", key, "state")


def merge_small_clones(labels: DataFrame, totals: DataFrame, least_spots: int, least_umi: int) -> DataFrame:
    """(spot, label): clones short of spots or counts join the deepest clone that is short of neither.

    ``totals``: (spot, n). Where every clone is short, the one with most counts stays.
    """
    sizes = labels.join(totals, "spot", "left").groupBy("label").agg(F.count(F.lit(1)).alias("spots"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    sizes = sizes.withColumn("ok", (F.col("spots") >= least_spots) & (F.col("n") >= least_umi))
    target = sizes.agg(F.max_by("label", F.struct("ok", "n", -F.col("label"))).alias("target"))
    to = sizes.join(target).select("label", F.when(F.col("ok"), F.col("label")).otherwise(F.col("target")).alias("new"))
    return labels.join(F.broadcast(to), "label").select("spot", F.col("new").alias("label"))  # one row a clone


def reindex_normal(labels: DataFrame, shares: DataFrame, slack: float = 0.05) -> DataFrame:
    """(spot, label): the clone whose allele shares lie nearest one half becomes 0, the others keep their order.

    ``shares``: (clone, bin, baf).
    """
    off = keep(shares.groupBy("clone").agg(F.sum(F.greatest(F.abs(F.col("baf") - 0.5) - slack, F.lit(0.0))).alias("off")))  # read twice
    normal = off.agg(F.min_by("clone", F.struct("off", "clone")).alias("normal"))
    order = off.join(normal).withColumn("new", F.row_number().over(Window.orderBy(F.col("clone") != F.col("normal"), "clone")) - 1)  # one row a clone
    return labels.join(F.broadcast(order.select(F.col("clone").alias("label"), "new")), "label").select("spot", F.col("new").alias("label"))


def near_normal_spots(deviation: DataFrame, totals: DataFrame, need: float) -> DataFrame:
    """(spot) with the smallest deviation: the 40th percentile, or the first ten more at which their counts exceed ``need``."""
    rows = keep(deviation.join(totals, "spot"))  # a cut is one of these very values
    (cuts,) = order_statistics(rows, "std", [q / 100 for q in range(40, 101, 10)])
    sums = rows.agg(*(F.sum(F.when(F.col("std") <= c, F.col("n"))) for c in cuts)).head() if cuts[0] is not None else []
    cut = next((c for c, s in zip(cuts, sums, strict=False) if (s or 0) > need), cuts[-1])
    return rows.where(F.col("std") <= F.lit(cut)).select("spot")


def _balanced_bounds(tau: float, low: float, high: float):
    """Quantiles of the balanced beta-binomial of each depth, its probabilities summed in pieces up to the upper one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n in pdf["depth"].to_numpy():
                n, half = int(n), tau / 2
                # Each probability follows from the one before it.
                log_p, total, lo, hi = float(np_bb(np.zeros(1), np.full(1, n), np.array(0.5), np.array(tau))[0]), 0.0, None, n
                for first in range(0, n + 1, 65_536):
                    x = np.arange(first, min(n + 1, first + 65_536), dtype=float)
                    step = np.log(n - x[:-1]) - np.log(x[:-1] + 1) + np.log(x[:-1] + half) - np.log(n - x[:-1] - 1 + half)
                    logs = log_p + np.concatenate([[0.0], np.cumsum(step)])
                    cdf = total + np.cumsum(np.exp(logs))
                    total, y = cdf[-1], x[-1]
                    if y < n:
                        log_p = logs[-1] + np.log(n - y) - np.log(y + 1) + np.log(y + half) - np.log(n - y - 1 + half)
                    if lo is None and total >= low:
                        lo = first + int(np.searchsorted(cdf, low))
                    if total >= high:
                        hi = first + int(np.searchsorted(cdf, high))
                        break
                out.append((n, hi if lo is None else lo, hi))
            yield pd.DataFrame(out, columns=["depth", "lo", "hi"])

    return run


def normal_bins(obs: DataFrame, key: str = "bin", low: float = 0.05, high: float = 0.95, tau: float | None = None) -> DataFrame:
    """(bin, k, depth, kept, renumbered) of normal spots' pooled ``obs(bin, k, depth)``.

    A bin stays if k lies between the quantiles of a balanced beta-binomial with the fitted
    (or given) dispersion; quantiles are found once for each distinct depth.
    """
    tau = fit_normal_shares(obs)[1] if tau is None else tau
    depths = obs.select(F.col("depth").cast("long").alias("depth")).distinct().where("depth > 0")
    bounds = depths.mapInPandas(_balanced_bounds(tau, low, high), "depth long, lo long, hi long")
    judged = obs.join(bounds, "depth", "left").withColumn("kept", F.coalesce((F.col("k") >= F.col("lo")) & (F.col("k") <= F.col("hi")), F.lit(True)))
    order = judged.where("kept").select(key, (F.dense_rank().over(Window.orderBy(key)) - 1).alias("renumbered"))  # bins of one genome
    return judged.join(order, key, "left").select(key, "k", "depth", "kept", "renumbered")


#: Spots whose vectors are broadcast (40 MB of them); more are joined by a shuffle.
BROADCAST_SPOTS = 500_000


def main_components(cells: DataFrame, parts: int = 4, rounds: int = 6, seed: int = 0) -> DataFrame:
    """(spot, scores): principal components of the long table ``cells(spot, feature, v)``, absent cells being zero.

    Subspace iteration: in each round the spots' vectors are summed over each feature and these
    over each spot, centred by the features' means; only ``parts`` x ``parts`` sums come to the
    driver, whatever the number of features.
    """
    cells = keep(cells.select("spot", "feature", "v"))
    spots = keep(cells.select("spot").distinct())
    n = spots.count()
    few = F.broadcast if n <= BROADCAST_SPOTS else (lambda df: df)  # checked by size
    mean = keep(cells.groupBy("feature").agg((F.sum("v") / F.lit(max(n, 1))).alias("mean")))
    part = range(parts)
    # Fixed draws in (-1, 1), one for each spot and part.
    q = spots.select("spot", *((F.pmod(F.xxhash64("spot", F.lit(seed * parts + i)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(f"q{i}") for i in part))
    q = keep(q)

    def sums(df: DataFrame, *pairs: tuple) -> np.ndarray:
        return np.array([x or 0.0 for x in df.agg(*(F.sum(a * b) for a, b in pairs)).head()])

    def times(df: DataFrame, by: np.ndarray, names: str) -> DataFrame:
        return df.select("spot", *(sum((F.col(f"q{i}") * float(by[i, j]) for i in part), F.lit(0.0)).alias(f"{names}{j}") for j in part))

    def gram(df: DataFrame) -> np.ndarray:
        return sums(df, *((F.col(f"q{i}"), F.col(f"q{j}")) for i in part for j in part)).reshape(parts, parts)

    def unit(df: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(df))
        return keep(times(df, vectors / np.sqrt(np.maximum(values, 1e-12)), "q"))

    q = unit(q)
    one = F.lit(1.0)
    for r in range(rounds + 1):
        total = sums(q, *((F.col(f"q{i}"), one) for i in part))
        down = cells.join(few(q), "spot").groupBy("feature").agg(*(F.sum(F.col("v") * F.col(f"q{i}")).alias(f"f{i}") for i in part))
        down = down.join(mean, "feature").select("feature", "mean", *((F.col(f"f{i}") - F.col("mean") * float(total[i])).alias(f"f{i}") for i in part))
        if r == rounds:
            break
        down = keep(down)
        shift = sums(down, *((F.col(f"f{i}"), F.col("mean")) for i in part))
        up = cells.join(down, "feature").groupBy("spot").agg(*(F.sum(F.col("v") * F.col(f"f{i}")).alias(f"f{i}") for i in part))
        q = unit(up.select("spot", *((F.col(f"f{i}") - float(shift[i])).alias(f"q{i}") for i in part)))
    small = sums(down, *((F.col(f"f{i}"), F.col(f"f{j}")) for i in part for j in part)).reshape(parts, parts)
    values, vectors = np.linalg.eigh(small)
    turn = vectors[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0))
    return times(q, turn, "s").select("spot", F.array(*(F.col(f"s{j}") for j in part)).alias("scores"))


def differential_genes(counts: DataFrame, candidates: DataFrame, *, least_cells: int = 10, parts: int = 4, limit_unsure: float = 2.0, limit_tumour: float = 4.0, seed: int = 0) -> DataFrame:
    """(feature, lfc_unsure, lfc_tumour, umi, dropped): genes that differ between normal-like spots and the others of one sample.

    Spots are normalised, projected on their main components over all genes and split in two
    clusters; the one with most of ``candidates(spot)`` is normal-like.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .aggregate import fold_changes

    counts = keep(counts.select("feature", "spot", "umi"))  # read by each step
    held = keep(counts.groupBy("feature").agg(F.count_if(F.col("umi") > 0).alias("n"), F.sum("umi").alias("umi")))
    kept = counts.join(held.where(F.col("n") >= least_cells).select("feature"), "feature", "left_semi")
    totals = kept.groupBy("spot").agg(F.sum("umi").alias("total"))
    middle = totals.agg(F.median("total").alias("median"))
    scaled = kept.join(totals, "spot").join(F.broadcast(middle)).withColumn("v", F.coalesce(F.log1p(F.col("umi") * F.col("median") / F.nullif("total", F.lit(0))), F.lit(0.0)))  # one row
    low = main_components(scaled, parts, seed=seed).select("spot", array_to_vector("scores").alias("features"))
    split = KMeans(k=2, seed=seed, maxIter=20).fit(low).transform(low).select("spot", "prediction")
    marked = split.join(candidates.select("spot", F.lit(True).alias("c")), "spot", "left").fillna(False, ["c"]).persist()
    home = marked.groupBy("prediction").agg(F.count_if("c").alias("n")).orderBy(F.desc("n"), "prediction").head()
    home = home[0] if home else 0
    out = held
    for name, other in (("unsure", F.col("prediction") == home), ("tumour", F.col("prediction") != home)):
        groups = marked.where(F.col("c") | other).select("spot", (~F.col("c")).alias("inside"))
        out = out.join(fold_changes(kept, groups).select("feature", F.col("log_fc").alias(f"lfc_{name}")), "feature", "left")
    bar = held.agg(F.percentile("umi", F.lit(0.8)).alias("p80"))
    drop = ((F.abs("lfc_unsure") > limit_unsure) | (F.abs("lfc_tumour") > limit_tumour)) & (F.col("umi") > F.col("p80"))
    return out.join(F.broadcast(bar)).select("feature", "lfc_unsure", "lfc_tumour", "umi", F.coalesce(drop, F.lit(False)).alias("dropped"))  # one row


def outlier_features(totals: DataFrame, k: int = 200, factor: float = 1.5, stretch: int = 20_000) -> DataFrame:
    """(feature, n, lof, outlier): local outlier factor of ``totals(feature, n)`` on the line.

    On a line the k nearest of a value lie within k places of it in sorted order, so a factor
    depends on the 3k places to either side: values are numbered in order, and stretches of
    ``stretch`` numbers are computed apart, each with 3k more at both ends. Of values equally far
    the one of the lower place counts as nearer.
    """
    spark = totals.sparkSession
    # A sorted partition knows its rows' places once the sizes of those before it are known.
    dealt = totals.select("feature", "n").repartitionByRange("n", "feature").sortWithinPartitions("n", "feature")
    dealt = keep(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.min("_id"), F.count(F.lit(1))).collect())
    size = sum(s for _, _, s in sizes)
    if not size:
        return totals.select(F.col("feature").cast("long").alias("feature"), F.col("n").cast("long").alias("n"), F.lit(1.0).alias("lof"), F.lit(False).alias("outlier"))
    begin, starts = 0, []
    for part, first, count in sizes:
        starts.append((part, begin - first))
        begin += count
    places = dealt.join(F.broadcast(spark.createDataFrame(starts, "_part int, _shift long")), "_part").select("feature", "n", (F.col("_id") + F.col("_shift")).alias("place"))  # a row for each partition
    reach = 3 * k
    first, last = F.floor((F.col("place") - reach) / stretch), F.floor((F.col("place") + reach) / stretch)
    met = places.withColumn("part", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit((size - 1) // stretch).cast("long")))))

    def lof(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x, place = pdf["n"].to_numpy(float), pdf["place"].to_numpy()
        own = place // stretch == pdf["part"].iloc[0]
        m = min(k, size - 1)
        if m < 1:
            return pd.DataFrame({"feature": pdf["feature"], "n": pdf["n"], "lof": 1.0, "outlier": False})[own]
        steps = np.concatenate([np.arange(-m, 0), np.arange(1, m + 1)])
        near = np.empty((len(x), m), np.int64)
        for lo in range(0, len(x), 1024):
            at = np.arange(lo, min(lo + 1024, len(x)))[:, None] + steps
            far = np.abs(x[at.clip(0, len(x) - 1)] - x[lo : lo + 1024, None])
            far[(at < 0) | (at >= len(x))] = np.inf
            near[lo : lo + 1024] = np.take_along_axis(at, np.argsort(far, axis=1, kind="stable")[:, :m], axis=1)
        near = near.clip(0, len(x) - 1)
        dist = np.abs(x[near] - x[:, None])
        density = 1 / (np.maximum(dist, dist[near, -1]).mean(axis=1) + 1e-10)
        score = density[near].mean(axis=1) / density
        return pd.DataFrame({"feature": pdf["feature"], "n": pdf["n"], "lof": score, "outlier": score > factor})[own]

    return met.groupBy("part").applyInPandas(lof, "feature long, n long, lof double, outlier boolean")
