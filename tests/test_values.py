"""Operators that SQL can't express, held against plain numpy and planted truths; readers and writers by round trips."""

import io
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import aggregate, copynumber, fit, graph, hmm, hmrf, simulate
from tessera.plans import pipeline
from tessera.sources import readers, writers


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_main_components_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4)) * [9, 5, 3, 2] @ rng.normal(size=(4, 30)) + 0.01 * rng.normal(size=(40, 30)) + 3
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(30)], "spot long, feature long, v double")
    found = np.array([r.scores for r in hmrf.main_components(cells, 3, rounds=15).orderBy("spot").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(found), np.abs(u[:, :3] * s[:3]), atol=1e-3)


def test_outlier_factors_in_stretches(spark):
    rng = np.random.default_rng(2)
    n = np.sort(np.concatenate([rng.integers(0, 400, 150), rng.integers(0, 50_000, 12)]))
    totals = spark.createDataFrame([(i, int(v)) for i, v in enumerate(n)], "feature long, n long")
    k, far = 7, np.abs(n[:, None] - n[None]).astype(float)
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(far, near, axis=1)
    density = 1 / (np.maximum(dist, dist[near, -1]).mean(axis=1) + 1e-10)
    expected = density[near].mean(axis=1) / density
    for stretch in (20, 20_000):
        got = {r.feature: r.lof for r in hmrf.outlier_features(totals, k=k, stretch=stretch).collect()}
        assert np.allclose([got[i] for i in range(len(n))], expected)
    assert hmrf.outlier_features(totals.limit(0)).count() == 0


def test_normal_bins_over_a_long_range_of_depths(spark):
    obs = spark.createDataFrame([(1, 50, 100), (2, 2, 100), (3, 99_000, 200_000), (4, 10_000, 200_000), (5, 0, 0)], "bin long, k long, depth long")
    got = {r.bin: (r.kept, r.renumbered) for r in hmrf.normal_bins(obs, tau=50.0).collect()}
    assert got == {1: (True, 0), 2: (False, None), 3: (True, 1), 4: (False, None), 5: (True, 2)}


def test_lineages_of_a_path_and_a_fork(spark):
    nodes = spark.createDataFrame([(0, None), *((i, i - 1) for i in range(1, 12)), (20, 5)], "id long, parent long")
    got = rows_of(simulate.lineages(spark, nodes))
    assert got == sorted([(11, 11 - d, d) for d in range(12)] + [(20, 20, 0)] + [(20, 5 - d, d + 1) for d in range(6)])


def test_random_rectangles_keep_their_rule(spark):
    spots = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(400)], "spot long, x double, y double")
    sizes = [r["count"] for r in simulate.random_rectangles(spots, 3, seed=4).groupBy("clone").count().collect()]
    assert len(sizes) == 3 and min(sizes) > 0.2 * 400 / 3
    with pytest.warns(UserWarning, match="no draw"):
        assert simulate.random_rectangles(spots.where("spot < 2"), 3, tries=32).count() == 2


def test_sweeps_find_the_ground_state(spark):
    nodes = spark.createDataFrame([(0, i, i % 3, [5.0 if i < 6 else 0.0, 0.0 if i < 6 else 5.0, 0.0]) for i in range(12)], "sample int, node long, label int, h array<double>")
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(12) for b in range(12) if abs(a - b) == 1], "src long, dst long, weight double")
    truth = {i: int(i >= 6) for i in range(12)}
    assert {r.node: r.label for r in simulate.metropolis(nodes, edges, 3, beta=50.0, sweeps=30, seed=1).collect()} == truth
    assert {r.node: r.label for r in simulate.learn_labels(nodes, edges, 3, epsilon=0.0).collect()} == truth
    one = spark.createDataFrame([(0, 0, 0, [1.0])], "sample int, node long, label int, h array<double>")
    assert simulate.metropolis(one, edges.limit(0), 1).head().label == 0


def test_final_labels_against_one_plain_sweep(spark):
    rng = np.random.default_rng(5)
    n, bins = 9, 4
    counts = [(s, b, int(rng.integers(5, 30)), 12.0, int(rng.integers(0, 11)), 20) for s in range(n) for b in range(bins)]
    states = hmm.States(p=(0.5, 0.2), tau=(20.0, 20.0), log_mu=(0.0, 0.4), alpha=(0.1, 0.1))
    gamma = np.log([0.7, 0.3])
    soft = spark.createDataFrame([(c, b, s, float(gamma[s ^ c])) for c in range(2) for b in range(bins) for s in range(2)], "clone int, bin long, state int, log_gamma double")
    df = spark.createDataFrame(counts, "spot long, bin long, umi long, base double, k long, depth long")
    itself = spark.createDataFrame([(s, s) for s in range(n)], "src long, dst long")
    couple = spark.createDataFrame([(a, b, 0.5) for a in range(n) for b in range(n) if abs(a - b) == 1], "src long, dst long, weight double")
    labels = spark.createDataFrame([(0, s, s % 2) for s in range(n)], "sample int, spot long, label int")
    found, total = hmrf.final_labels(df, itself, couple, labels, soft, hmrf.states_table(spark, states), weight=2.0)
    llf = np.zeros((n, 2))
    for s, _, umi, base, k, depth in counts:
        for c in range(2):
            r = [float(fit.np_nb(*(np.array([float(x)]) for x in (umi, base, states.log_mu[i], states.alpha[i])))[0]) + gamma[i ^ c] for i in range(2)]
            b = [float(fit.np_bb(*(np.array([float(x)]) for x in (k, depth, states.p[i], states.tau[i])))[0]) + gamma[i ^ c] for i in range(2)]
            llf[s, c] += np.logaddexp(*r) + np.logaddexp(*b)
    now = [s % 2 for s in range(n)]
    for s in range(n):
        score = llf[s].copy()
        for d in (s - 1, s + 1):
            if 0 <= d < n:
                score[now[d]] += 2.0 * 0.5
        now[s] = int(score.argmax())
    assert [r.label for r in found.orderBy("spot").collect()] == now
    like = sum(now[a] == now[b] for a in range(n) for b in range(n) if abs(a - b) == 1)
    assert total.head()[0] == pytest.approx(sum(llf[s, now[s]] for s in range(n)) + 2.0 * like)


def test_field_loop_recovers_planted_clones(spark):
    rng = np.random.default_rng(6)
    share = {0: [0.5] * 12, 1: [0.5] * 6 + [0.15] * 6}
    rows = [(s, 1, b, 0, 0.0, int(rng.binomial(200, share[s // 10][b])), 200) for s in range(20) for b in range(12)]
    counts = spark.createDataFrame(rows, "spot long, chr int, bin long, umi long, base double, k long, depth long")
    pool = spark.createDataFrame([(s, s) for s in range(20)], "src long, dst long")
    couple = spark.createDataFrame([(a, b, 0.1) for a in range(20) for b in range(20) if abs(a - b) == 1 and a // 10 == b // 10], "src long, dst long, weight double")
    labels = spark.createDataFrame([(0, s, int(s // 10 if s % 5 else 1 - s // 10)) for s in range(20)], "sample int, spot long, label int")
    found, _, trail = hmrf.hmrf_loop(counts, pool, couple, labels, k=2, rounds=3, em_rounds=2, update="sp")
    truth = spark.createDataFrame([(s, s // 10) for s in range(20)], "spot long, truth int")
    assert aggregate.adjusted_rand(found.join(truth, "spot"), "label", "truth").head()[0] == pytest.approx(1) and len(trail) <= 3


def test_initial_phase_finds_the_planted_one(spark):
    rng = np.random.default_rng(7)
    turned = [False] * 8 + [True] * 8 + [False] * 8
    rows = [(0, 1, t, int(rng.binomial(300, 0.8 if x else 0.2)), 300, 0, 0.0) for t, x in enumerate(turned)]
    obs = spark.createDataFrame(rows, "clone int, chr int, t long, k long, depth long, umi long, base double")
    got = {r.t: r.phase for r in pipeline.initial_phase(obs, k=2, rounds=4, least=100).collect()}
    assert [got[t] for t in range(24)] in ([not x for x in turned], turned)


def test_integer_copies_with_restarts_repeat(spark):
    rows = spark.createDataFrame([(0, 0, 60, 0.0, 0.5), (0, 1, 40, math.log(2.0), 0.75)], "clone int, state int, bins int, log_mu double, p double")
    one, two = (rows_of(copynumber.integer_copies(rows, diploid=copynumber.diploid_state(rows), restarts=20).select("state", "a", "b")) for _ in range(2))
    assert one == two and one[0] == (0, 1, 1) and sorted(one[1][1:]) == [1, 3]


def test_registered_queries_give_sound_rows(spark, small):
    q = catalogue.QUERIES
    assert {r.label for r in q["icm_labels"](spark, small).collect()} <= {0, 1, 2}
    assert {r.form for r in q["final_labels"](spark, small).select("form").distinct().collect()} == {"point", "posterior", "point, purity", "posterior, purity"}
    fitted = q["bb_fit"](spark, small).collect()
    assert len(fitted) == 4 and all(0 < r.location < 1 and r.dispersion > 0 for r in fitted)
    assert len({r.dispersion for r in fitted if r.kind == "shared"}) == 1
    drawn = q["simulate_counts"](spark, small)
    assert drawn.where("b > depth or umi < 0 or b < 0").count() == 0 and drawn.count() == drawn.select("spot", "segment").distinct().count()
    genes = q["diffexp_filter"](spark, small)
    assert genes.where("dropped and abs(lfc_unsure) <= 2 and abs(lfc_tumour) <= 4").count() == 0
    assert {r.clone for r in q["random_clones"](spark, "/root/testdata/sf0.01").collect()} == {0, 1, 2}


def test_solver_settings():
    given = SimpleNamespace(hmm=SimpleNamespace(solver="L-BFGS-B", em_maxiter="3", em_ftol="1e-4", em_disp="0"))
    assert fit.solver_settings(given) == {"maxiter": 3.0, "ftol": 1e-4, "disp": 0.0}
    given.hmm.solver = "CG"
    with pytest.raises(ValueError, match="CG"):
        fit.solver_settings(given)


def test_links_between_slices_add_up(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "src long, dst long, weight double")
    more = spark.createDataFrame([(1, 2, 0.25), (1, 0, 0.25)], "src long, dst long, weight double")
    assert rows_of(graph.with_links(edges, more)) == [(0, 1, 0.5), (1, 0, 0.75), (1, 2, 0.25)] and graph.with_links(edges, None).count() == 2


def test_text_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert rows_of(readers.sample_sheet(spark, put("s.tsv", "sample_id\tsnp_dir\tspaceranger_dir\tnote\nU1\ta\tb\tx\n"))) == [("U1", "a", "b")]
    assert rows_of(readers.filter_genes(spark, put("g.txt", "MYC\n\n TP53\n"))) == [("MYC",), ("TP53",)]
    assert rows_of(readers.filter_ranges(spark, put("r.tsv", "chr2\t5\t9\n1\t0\t4\n"))) == [("1", 0, 4), ("2", 5, 9)]
    assert rows_of(readers.genes(spark, put("genes.tsv", "i\tchrom\tcdsStart\tcdsEnd\tname2\n0\tchr10\t5\t9\tA\n1\tchrX\t1\t2\tB\n2\tchr2\t7\t8\tC\n"))) == [(2, 7, 8, "C"), (10, 5, 9, "A")]
    assert rows_of(readers.genetic_map(spark, put("m.tsv", "chrom\tpos\tpos_cm\nchr10\t5\t0.5\nchrX\t1\t1\n2\t7\t0.1\n"))) == [(2, 7, 0.1), (10, 5, 0.5)]
    line = "1\t{}\tx\tA\tG\t.\tPASS\tAD=1\tGT\t{}\n"
    assert rows_of(readers.phased_vcf(spark, put("p.vcf", "##x\n#CHROM\n" + line.format(5, "0|1") + line.format(9, "1|0") + line.format(5, "1|0")))) == [("1_5_A_G", "1|0"), ("1_9_A_G", "1|0")]
    with pytest.raises(FileNotFoundError):
        readers.positions(spark, str(tmp_path / "none"))
    for name, text in (("new", "barcode,in_tissue,x,y,px,py\nAC,1,2,3,4.5,5\nAG,0,1,1,1,1\n"), ("old", "AC,1,2,3,4.5,5\nAG,0,1,1,1,1\n")):
        (tmp_path / name).mkdir()
        put(f"{name}/tissue_positions{'' if name == 'new' else '_list'}.csv", text)
        assert rows_of(readers.positions(spark, str(tmp_path / name))) == [("AC", 1, 2, 3, 4.5, 5.0)]
        assert readers.positions(spark, str(tmp_path / name), in_tissue=False).count() == 2


def test_array_readers(spark, tmp_path):
    def packed(kind):
        f = io.BytesIO()
        np.savez(f, data=np.array([5, 7]), indices=np.array([0, 1]), indptr=np.array([0, 1, 1, 2]), shape=np.array([3, 2] if kind == "csr" else [2, 3]), format=np.array(kind.encode()))
        return f.getvalue()

    (tmp_path / "a.npz").write_bytes(packed("csr"))
    (tmp_path / "b.npz").write_bytes(packed("csc"))
    rows = readers.sparse_arrays(spark, str(tmp_path / "*.npz")).select(F.substring_index("file", "/", -1).alias("f"), "row", "col", "value")
    assert rows_of(rows) == [("a.npz", 0, 0, 5.0), ("a.npz", 2, 1, 7.0), ("b.npz", 0, 0, 5.0), ("b.npz", 1, 2, 7.0)]
    np.save(tmp_path / "ids.npy", np.array(["1_5_A_G", "1_9_A_G"]))
    assert rows_of(readers.dense_arrays(spark, str(tmp_path / "ids.npy")).select("row", "text")) == [(0, "1_5_A_G"), (1, "1_9_A_G")]
    np.save(tmp_path / "pi.npy", np.array([[0.0, 0.25], [0.5, 0.0]]))
    assert rows_of(readers.alignment(spark, str(tmp_path / "pi.npy"), 2, 2)) == [(0, 3, 0.25), (1, 2, 0.5)]
    spark.createDataFrame([(0, 1, 0.25)], "row long, col long, value double").write.parquet(str(tmp_path / "pi"))
    assert rows_of(readers.alignment(spark, str(tmp_path / "pi"), 2, 2)) == [(0, 3, 0.25)]
    spark.createDataFrame([("s", "AC", "G", 2.0), ("s", "AC", "H", float("nan")), ("s", "AC", "I", None)], "sample string, barcode string, gene string, umi double").write.parquet(str(tmp_path / "counts"))
    assert [r.umi for r in readers.count_table(spark, str(tmp_path / "counts")).collect()] == [2]


def test_writers_round_trip(spark, tmp_path):
    spots = spark.createDataFrame([(1, 2.0, 3.0, 0.5), (2, 4.0, 5.0, None)], "spot long, x double, y double, tumour double")
    labels = spark.createDataFrame([(1, 0)], "spot long, label int")
    writers.write_copies(str(tmp_path / "out"), segments=labels, genes=labels, states=labels, labels=labels, spots=spots)
    back = spark.read.csv(str(tmp_path / "out/clone_labels"), sep="\t", header=True)
    assert back.columns == ["barcode", "x", "y", "tumor_proportion", "clone_label"] and rows_of(back.select("barcode", "clone_label").fillna("")) == [("1", "0"), ("2", "")]
    assert all(spark.read.csv(str(tmp_path / f"out/cnv_{n}"), sep="\t", header=True).count() == 1 for n in ("seglevel", "genelevel", "perstate"))
    writers.write_commented(spots.coalesce(1), str(tmp_path / "c"))
    assert readers.commented_table(spark, str(tmp_path / "c")).columns == spots.columns
    writers.write_table(labels, str(tmp_path / "t"), partition_by=("label",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    for _ in range(2):
        writers.append_metrics(spark, str(tmp_path / "m"), [("hmm", 10, 3, "mixture", 0.5, 2, -1.0)])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("hmm:\n  solver: BFGS\n  n: 3\n  file: None\n")
    got = readers.config(str(tmp_path / "c.yaml"))
    assert (got.hmm.solver, got.hmm.n, got.hmm.file) == ("BFGS", 3, None)
