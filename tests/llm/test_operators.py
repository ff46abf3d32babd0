"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common, decontaminate, embedding_dedup, html_wrappers, minhash, packing, quality, queries, secrets, token_counts, token_output, toxicity

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Nulls, empty and long texts, repeats, odd white space and signs, special strings, a clashing column.
TEXTS = [
    None, "", " ", "a", "Don't STOP  now\n\n it's\t\tfine ", "café naïve 你好 \U0001f600\U0001f468‍\U0001f469", "x" * 3000, "12 345,678.9 -- ...   z", "<|endoftext|> and <|endoftext|>tail",
    "\0nul\0 'll 're we've I'M", "\r\nline\r\n\u0085next sep", "the quick brown fox " * 400, "the quick brown fox " * 400, "password: hunter22 token=abc", "AKIA" + "Q" * 20 + " deadbeef" * 4 + " " + "0a" * 20, "İſ K Á",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, i) for i, t in enumerate(TEXTS)] + [(3, "a", None, "x", None)], "doc_id long, text string, lang string, _bucket string, label long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_spans_of_benchmark_items(spark, docs, none):
    items = [("i1", "The quick, brown fox! " * 4), (2, "it's fine"), ("n", None), ("e", " ... "), ("c", "café")]
    table = spark.createDataFrame([(str(a), b, 1) for a, b in items], "item_id string, text string, doc_id int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = []
    for i, t in [*enumerate(TEXTS), (3, "a")]:
        own, hit, met = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit |= set(range(at, at + n))
                        met.add(str(item))
        expected.append((i, len(own), len(hit), sorted(met)))
    for size in (1 << 20, 8):  # one automaton, and one for each item
        got = decontaminate.find_contamination(docs, table, shard_bytes=size).collect()
        assert sorted((r.doc_id, r.n_words, sum(s["last"] - s["first"] for s in r.spans), r["items"]) for r in got) == sorted(expected)
    assert decontaminate.find_contamination(none, table).count() == 0
    assert decontaminate.find_contamination(docs, table.limit(0)).where("size(items) > 0").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, table).collect()}
    assert set(range(len(TEXTS))) - set(cut) == {11, 12} and cut[4] == TEXTS[4] and cut[0] is None


def test_registered_queries_with_sql(spark, small, duck, same):
    for name, sql in queries.ORACLE.items():
        same(duck, sql, queries.QUERIES[name](spark, small))


def test_token_files_hold_the_library_ids(spark, docs, none):
    uri = common.new_path(spark, "t")
    token_output.write_tokens(docs, uri, public_tokenizers.path(BYTES), shards=3)
    start = 0
    code = library(BYTES)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, uri).collect()}
    for i, t in sorted([*enumerate(TEXTS), (3, "a")], key=lambda x: x[0]):
        ids = code.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i, start] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    uri = common.new_path(spark, "t")
    token_output.write_tokens(none, uri, public_tokenizers.path(BYTES))
    assert token_output.read_tokens(spark, uri).count() == 0


def test_token_counts_are_the_library_counts(spark, docs, none, small):
    code = library(BYTES)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, public_tokenizers.path(BYTES)).collect())
    assert got == sorted((i, len((t or "").encode()), len(code.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(TEXTS), (3, "a")])
    assert token_counts.count_tokens(none, public_tokenizers.path(BYTES)).count() == 0
    rows = common.table(spark, small, "documents").collect()
    found = {r.doc_id: r.n_tokens for r in queries.QUERIES["op4_token_counts"](spark, small).collect()}
    assert all(found[r.doc_id] == len(code.encode(r.text, add_special_tokens=False).ids) for r in rows)


def test_packing(spark, docs, none):
    code = library(WORDS)
    rows = packing.pack_documents(docs, public_tokenizers.path(WORDS), capacity=64).collect()
    parts = defaultdict(list)
    for i, t in [*enumerate(TEXTS), (3, "a")]:
        ids = code.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            parts[i].append((k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((i, *p) for i, own in parts.items() for p in own)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, public_tokenizers.path(WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_plan_takes_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 500)) for n in rng.choice(np.arange(1, 101), 30, replace=False)}
    taken, fill = defaultdict(list), defaultdict(list)
    for length, first, last, per, seq, base in packing.best_fit_plan(counts, 100):
        for r in range(first, last):
            taken[length].append(r)
            fill[seq + (r - first) // per].append((base + (r - first) % per * length, length))
    assert all(sorted(v) == list(range(counts[n])) for n, v in taken.items()) and set(taken) == set(counts)
    for own in fill.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 100
    total = sum(n * c for n, c in counts.items())
    assert len(fill) <= -(-total // 100) * 1.25 + 1


def test_secrets_and_ledger(spark, docs, none):
    ledger = common.new_path(spark, "ledger")
    rules = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    expected = []
    for i, t in [*enumerate(TEXTS), (3, "a")]:
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(rules) for m in p.finditer(t or "") if len(m[g]) >= n)
        expected.append((i, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)))
    found = secrets.scan_paths(docs, ledger)
    assert sorted(tuple(r) for r in found.select("doc_id", secrets.spans_text(F.col("spans"))).collect()) == sorted(expected)
    before = secrets.read_ledger(spark, ledger).count()
    assert secrets.scan_paths(docs, ledger).count() == len(expected) and secrets.read_ledger(spark, ledger).count() == before  # nothing is scanned twice
    assert secrets.scan_paths(none, common.new_path(spark, "ledger")).count() == 0
    masked = {r.doc_id: r.text for r in secrets.redact(docs, common.new_path(spark, "ledger")).collect()}
    assert masked[13] == "[SECRET] token=abc" and masked[5] == TEXTS[5] and masked[0] is None and len(masked) == len(TEXTS)


def near_by_force(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, small, none):
    rows = [(r.doc_id, r.text) for r in common.table(spark, small, "documents").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    rng = np.random.default_rng(6)
    base = ["w%d" % x for x in rng.integers(0, 500, 60)]
    rows += [(20_000 + k, " ".join(base[: 60 - k % 9] + ["v%d" % k])) for k in range(300)]  # a dense region
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_by_force(rows, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=2).collect()}
    assert got == expected
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf_dir).join(common.table(spark, sf_dir, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.predicted == r[label] for r in held]) >= least


def test_classifiers_without_labels_or_texts(spark, docs, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert score(docs, labels).count() == len(TEXTS) + 1
        assert score(docs, labels.limit(0)).where("score between 0 and 1").count() == len(TEXTS) + 1
        assert score(none, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels, 1.1).columns == docs.columns


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    "<!-- x > y --><div class='ad'>Buy</div><div id=cookie-notice>We use cookies</div><aside>Side</aside>{main}<section class=\"comments\"><p>Nice post</p></section><form><p>Mail</p><textarea>x<p></textarea></form><footer>&copy; site</footer></body></html>"
)


def test_html_extraction(spark):
    bodies = ["<article><h1>A &amp; B</h1><p>One\n  two <b>th</b>ree.<p>Four<br>five&nbsp;x</p>{}</article>".format("<p>more &lt;tag&gt;</p>" * k) for k in range(6)]
    plain = ["A & B\nOne two three.\nFour five x" + "\nmore <tag>" * k for k in range(6)]
    divs = [f"<div class='wrap'><div class='text'><p>Only here {k} and some long words.</p><p>Second {k}</p></div></div>" for k in range(6)]
    flat = [f"Only here {k} and some long words.\nSecond {k}" for k in range(6)]
    rows = [(k, f"http://a.example/{k}", PAGE.replace("{main}", b), t) for k, (b, t) in enumerate(zip(bodies, plain, strict=True))]
    rows += [(10 + k, f"https://B.example:80/{k}", PAGE.replace("{main}", b), t) for k, (b, t) in enumerate(zip(divs, flat, strict=True))]
    rows += [(30, "http://a.example/z", PAGE.replace("{main}", bodies[2])[:-60], plain[2]), (31, None, None, ""), (32, "http://a.example/e", "", ""), (33, None, "<p>lone &am page", "lone &am page"), (34, "x", "< 3 <", "< 3 <"), (None, "http://a.example/1", rows[1][2], plain[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.url, r.text) for r in html_wrappers.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(a, b, d) for a, b, _, d in rows], key=str)
    assert html_wrappers.extract(pages.limit(0)).count() == 0


def test_wrappers_generalise():
    streams = [html_wrappers.page_stream(f"<div><h2>T{k}</h2>{'<p>x' + str(k) + '</p>' if k else ''}<ul>{'<li>i' * (k + 1)}</ul></div>")[0] for k in range(3)]
    wrapper = html_wrappers.infer(iter(streams))
    shown = [(x[html_wrappers.SIG], x[html_wrappers.OPTIONAL]) for x in wrapper]
    assert ("(li ; #)+", False) in shown and ("p", True) in shown and ("h2", False) in shown


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16))
    vectors = [centres[i % 30] + rng.normal(0, 0.1 + 0.01 * (i % 40), 16) for i in range(400)]
    vectors[5:9] = [vectors[4]] * 4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0, 2.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(400)
    while (new := np.minimum(root, np.where(link, root[None], 400).min(axis=1))).tolist() != root.tolist():
        root = new
    assert all(found[i] == (0, i) for i in range(1000, 1006))
    assert np.mean([found[i][0] for i in range(400)]) >= 0.99 * link.sum(axis=1).mean() and np.mean([found[i][1] == root[i] for i in range(400)]) >= 0.98
    assert all(found[i][0] <= link[i].sum() for i in range(400))
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P

    docs = common.table(spark, small, "documents")
    kept = P.toxicity(spark, docs, small)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, common.table(spark, small, "labels")).collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {i for i, s in scores.items() if s < P.TOXIC} and kept.columns == docs.columns
    once = P.near_dedup(spark, common.materialise(kept, "stage"), small)
    force = near_by_force(list(rows.items()), 5, 80)
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, (_, root) in force.items() if root == i) and once.columns == docs.columns
    clean = P.secret_scan(spark, common.materialise(P.decontamination(spark, common.materialise(once, "stage"), small), "stage"), small)
    clean = common.materialise(clean, "stage")
    assert clean.columns == docs.columns
    assert clean.select(secrets.secret_spans(F.coalesce("text", F.lit(""))).alias("s")).where("size(s) > 0").count() == 0
    left = decontaminate.find_contamination(clean, common.table(spark, small, "benchmark")).where("size(items) > 0")
    assert left.count() == 0
    packed = P.packing(spark, clean, small)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert hashlib.sha256(str(packed.columns).encode()).hexdigest()


def test_near_duplicates_far_apart_in_a_dense_region(spark):
    """Two near copies meet in one tree alone, thousands of rows and a border apart."""
    slots, (mul, add) = minhash._tree_slots(), minhash._constants()
    found = None
    for seed in range(200):
        rng = np.random.default_rng(seed)
        words = [f"w{seed}x{k}" for k in rng.permutation(200)]
        h = np.array([minhash.shingles(w, 1)[0] for w in words])
        least = (h[None] * mul[:, None] + add[:, None]).argmin(axis=1)
        kept = set(least[slots[0, :3]])
        gone = {least[slots[0, 3]]} | {next((x for x in least[slots[t, :3]] if x not in kept), None) for t in range(1, minhash.TREES)}
        if gone & (kept | {None}):
            continue
        copy = [w for k, w in enumerate(words) if k not in gone]
        x, y = (np.frombuffer(minhash.signature(minhash.shingles(" ".join(t), 1)), "<u2").astype(int) for t in (words, copy))
        heads = [(x[s[:3]] == y[s[:3]]).all() for s in slots]
        if sum(heads) == 1 and heads[0] and abs(x[slots[0, 3]] - y[slots[0, 3]]) > 45_000:
            found = words, copy, [words[k] for k in sorted(kept)]
            break
    words, copy, common_ = found
    rows = [(1, " ".join(words)), (2, " ".join(copy))] + [(k, " ".join(common_ + [f"f{k}x{j}" for j in range(8)])) for k in range(3, 12_003)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.pop(2) == 1 and all(a == b for a, b in got.items())


def test_embedding_link_beyond_a_crowd_of_likely_pairs():
    """Five likely partners stand between a vector and one more link."""
    axes = np.eye(64)
    last = 0.95 * axes[0] + np.sqrt(1 - 0.95**2) * axes[1]
    vectors = np.stack([axes[0]] + [0.915 * last + np.sqrt(1 - 0.915**2) * axes[k] for k in range(10, 15)] + [last])
    rows = np.zeros(len(vectors), embedding_dedup._record(64))
    rows["node"] = np.arange(len(vectors))
    rows["rounded"] = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 127)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["record"])
    assert (0, 6) in {(r["a"], r["b"]) for out in embedding_dedup._walker(64, 0.9)([batch]) for r in out.to_pylist()}


def test_embedding_passes_grow_with_the_table():
    """The stated miss rate holds at every size."""
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (10, 400, 100_000, 1_000_000, 10**9):
        assert (1 - agree ** np.log2(max(n / embedding_dedup.NEAR, 1))) ** embedding_dedup.n_passes(n, 0.9) <= 0.01


def test_decontamination_judges_all_shards_at_once(spark):
    """Two items of 30% each, in two shards, take a document out."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("x", 12), ("y", 12), ("z", 16)))
    items = spark.createDataFrame([("a", x), ("b", y)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"{x} {y} {z}"), (2, f"{z} {x} {z} {z}"), (3, None)], "doc_id long, text string")
    for size in (1, 1 << 20):
        got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, shard_bytes=size).collect()}
        assert set(got) == {2, 3} and got[2].split() == f"{z} {z} {z}".split() and got[3] is None


def test_redaction_whatever_the_columns(spark):
    """Columns named like the operator's own, and a second rules version."""
    docs = spark.createDataFrame([(1, "password: hunter22", "a", "b", [1], "c"), (1, "password: hunter22", "a", "b", [1], "c"), (2, None, "a", None, None, None), (3, "", None, None, None, "d")], "doc_id long, text string, _blob string, _spans string, spans array<int>, row string")
    docs = docs.withColumn("blob", F.lit(1)).withColumn("masked", F.lit(2))
    ledger = common.new_path(spark, "ledger")
    got = secrets.redact(docs, ledger)
    assert got.columns == docs.columns and sorted(str(r.text) for r in got.collect()) == ["", "None", "[SECRET]", "[SECRET]"]
    assert [tuple(r) for r in got.drop("text").where("doc_id = 1").distinct().collect()] == [(1, "a", "b", [1], "c", 1, 2)]
    n = secrets.read_ledger(spark, ledger).count()
    changed = docs.unionByName(docs.where("doc_id = 1").limit(1).withColumn("text", F.lit("a later version, token=abcdef")))
    assert secrets.scan_paths(changed, ledger).where("size(spans) > 0").count() == 3
    assert secrets.read_ledger(spark, ledger).count() == n + 1  # only the new version was scanned
    assert secrets.scan_paths(changed, ledger, rules="other").count() == 5 and secrets.read_ledger(spark, ledger).count() == 2 * n + 2


def test_chunk_maps_compose(spark):
    """Pre-tokens of many chunks, with places where a guess is wrong."""
    rng = np.random.default_rng(4)
    code = library(BYTES)
    texts = ["".join(rng.choice(list("abehinorst"), n)) for n in (257, 511, 5_000, 40_001)] + ["ab" * 3000, "the" * 2000 + "x", "=" * 9999]
    machine = token_counts.CountTransducer(public_tokenizers.path(BYTES))
    before = token_counts.CHUNK, token_counts.WARM
    try:
        for token_counts.CHUNK, token_counts.WARM in ((256, 32), (32, 1)):  # hardly any context: many wrong guesses
            assert token_counts.count_texts(texts, machine)[1].tolist() == [len(code.encode(t, add_special_tokens=False).ids) for t in texts]
    finally:
        token_counts.CHUNK, token_counts.WARM = before


def test_embedding_norms_beyond_the_range_of_squares(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [-1e300, 1e300]), (5, [-1e-320, 1e-320])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_items_without_an_id_give_no_window(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), ("a", "three")], "item_id string, text string")
    assert [(r["items"], [tuple(s) for s in r.spans]) for r in decontaminate.find_contamination(docs, items).collect()] == [(["a"], [(2, 3)])]


def test_token_files_with_null_ids_and_narrow_widths(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "c"), (None, "a b")], "doc_id long, text string")
    uri = common.new_path(spark, "t")
    token_output.write_tokens(docs, uri, public_tokenizers.path(BYTES))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.read_tokens(spark, uri).collect())
    assert got == [(0, None, 3), (3, None, 3), (6, 5, 2)]
    with pytest.raises(Exception, match="16 bits"):
        token_output.write_tokens(docs, common.new_path(spark, "t"), public_tokenizers.path(BYTES), end_id=70_000)


def bare_page(k, lead="", more=""):
    """Class names tell nothing; furniture is told by what all pages of the host share."""
    return f"<html><body><div class=a><p>The same words on every page of this site.</p></div>{lead}<div class=b><p>Story {k} tells of thing {k}.</p>{more}</div><div class=c><p>Contact us at the usual place.</p></div></body></html>"


def test_wrappers_decide_where_names_tell_nothing(spark):
    lone = "<blockquote>Only this page quotes.</blockquote>"
    fake = "<div class=content><p>All pages show this teaser.</p></div>"
    rows = [(k, f"http://bare.example/{k}", bare_page(k)) for k in range(5)] + [(9, "http://bare.example/9", bare_page(9, more=lone))]
    rows += [(10 + k, "http://copies.example/", bare_page(1)) for k in range(3)]
    rows += [(20 + k, f"http://fake.example/{k}", bare_page(k, lead=fake)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = "The same words on every page of this site.\nStory 1 tells of thing 1.\nContact us at the usual place."
    expected = {k: f"Story {k} tells of thing {k}." for k in range(5)} | {9: "Story 9 tells of thing 9.\nOnly this page quotes."}
    expected |= {10 + k: whole for k in range(3)} | {20 + k: f"Story {k} tells of thing {k}." for k in range(4)}
    for limit in (1 << 20, 0):  # wrappers broadcast, and joined by host and salt
        assert {r.page_id: r.text for r in html_wrappers.extract(pages, broadcast_bytes=limit).collect()} == expected
    alone = html_wrappers.Wrapper(None, 0)
    assert sum(alone.read(h) != expected[i] for i, _, h in rows) == 10  # pages that the wrappers change


def test_a_host_over_many_tasks(spark):
    pages = spark.createDataFrame([(k, "http://bare.example/", bare_page(k)) for k in range(80)], "page_id long, url string, html string").repartition(40)
    found = html_wrappers.extract(pages).collect()
    assert sorted(r.text for r in found) == sorted(f"Story {k} tells of thing {k}." for k in range(80))


def test_long_pages_align_in_time():
    import time

    rng = np.random.default_rng(8)
    long = lambda c: "".join(f"<{t}>{c}{k}" for k, t in enumerate(rng.choice(["p", "h2", "pre", "blockquote", "h3"], 4000)))
    streams = [html_wrappers._bare(html_wrappers.fold(html_wrappers.page_stream(long(c))[0])) for c in "xy"]
    began = time.monotonic()
    html_wrappers.align(*streams)
    assert time.monotonic() - began < 20
    for a, b in (("abcxdef", "abydef"), ("aaaa", "aa"), ("", "a"), ("xyz" * 200, "xzy" * 200)):
        pairs = html_wrappers.matches(list(a), list(b))
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


def test_label_model_recovers_planted_voters():
    rng = np.random.default_rng(10)
    n = 6000
    truth = rng.random(n) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9])
    votes = np.where((rng.random((n, 6)) < right) == truth[:, None], 1, -1)
    votes[:, :5][rng.random((n, 5)) < 0.3] = 0
    votes = np.concatenate([votes, votes[:, 5:], votes[:, 5:]], axis=1)  # two copies of the last
    model = toxicity.LabelModel(votes, None)
    assert np.mean((model.posterior >= 0.5) == truth) > 0.95
    assert np.allclose(model.accuracy[:6], right, atol=0.07)
    last = {5, 6, 7}
    copies = [j for j in last if model.parent[j] in last]
    assert len(copies) == 2 and model.tie[:5].max() < 0.1 * model.tie[copies].min()  # what is left between the others is weak
    gold = np.where(rng.random(n) < 0.97, truth, ~truth).astype(float)
    assert np.mean((toxicity.LabelModel(votes, gold).posterior >= 0.5) == truth) >= np.mean((model.posterior >= 0.5) == truth)


def test_networks_and_pooling_against_plain_forms():
    rng = np.random.default_rng(7)
    unit, weight = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32), rng.random(quality.BUCKETS).astype(np.float32) + 0.1
    text = " ".join(f"w{k % 777}" for k in range(9001))
    ids = quality.words(text)
    v, w = unit[ids].astype(float), weight[ids, None].astype(float)
    plain = np.concatenate([v.mean(axis=0), v.std(axis=0), (v[1:] * v[:-1]).mean(axis=0) * 4, (v * w).sum(axis=0) / w.sum()])
    assert np.allclose(quality.pool(text, unit, weight)[:-2], plain, atol=1e-3)
    x = rng.normal(size=(6000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    network = quality.Network(4).fit(x, y)
    assert np.mean((network.scores(x) >= 0.5) == y) > 0.8
    assert np.allclose(network.scores(x[:3]), 1 / (1 + np.exp(-network.logits(x[:3]) / network.temperature)))


def test_stages_with_nulls_repeats_and_no_rows(spark, small, docs):
    import corpus_pipeline as P

    plain = docs.withColumn("n_chars", F.length("text")).withColumn("source", F.lit("s"))
    odd = plain.unionByName(plain).unionByName(plain.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for given in (odd, plain.limit(0)):
        rows = given.count()
        for name, stage in P.STAGES:
            out = stage(spark, given, small)
            if name == "packing":
                assert out.count() >= rows
                continue
            assert out.columns == given.columns and out.count() <= rows
            if name != "near_dedup" and rows:
                assert out.where("text is null").count() == given.where("text is null").count()
    none = common.table(spark, small, "labels").limit(0)
    assert toxicity.drop_toxic(plain, none, P.TOXIC).count() == plain.count()
