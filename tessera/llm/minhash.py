"""Near-duplicate documents by a MinHash LSH forest (operator 6).

Each distinct shingle set has a signature of ``SLOTS`` minimum hashes. A tree is one order of the
slots: its rows are sorted by the first slots in that order, dealt out by ranges of the sort key
(so no key, however common, meets in one task), and a row is compared with the rows before it
that share its first ``SHALLOW`` slots. How deep neighbours agree follows the region: in a sparse
one every pair of the first ``DENSE`` rows is compared, in a dense one the ``NEAR`` rows before,
which are those that share the longest prefix. Signature sketches drop unlike pairs on the spot; a
row names the ``KEEP`` likeliest of the rest, and these are confirmed on the full sets, in two
rounds: first each document's likeliest partners, then those that still join different components.

A region is crowded where a row had more likely partners than it named, was not compared with all
rows before it, or where the border of two tasks parts it. What is left there is found exactly: a
crowded region is dealt into blocks, its rows outside its main component meet every block, and
each pair of blocks settles its likely pairs of different components on the full sets inside one
task, so that only links leave it, one at most per component that it joins. Sketches go first and
alone; full sets travel only for rows with a likely partner, and a pair that shares regions in
several trees is settled in the first of them.

With similarity s a tree compares a pair with probability s^3: 16 trees miss a pair at 0.8 with
probability 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, schema, small_batches, table
from .components import components

SLOTS, TREES, DEPTH, SHALLOW = 128, 16, 6, 3
DENSE, NEAR = 32, 8
#: Partners that a row names in a tree; where there are more, its region counts as crowded.
KEEP = 2
#: By how much an estimate from sketches may lie below the threshold: over four standard deviations.
MARGIN = 0.16
#: Partners that each document confirms first.
FIRST = 3
#: Rows and shingles of a crowded region's block at most, on average; the parts in which the rows of a common region meet its figures.
BLOCK, BLOCK_SHINGLES, SALTS = 512, 1 << 19, 32
KNOWN_WORDS = 500_000

SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary"
PAIRS = "a long, b long, likeness float"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RECORD = np.dtype([("tree", "u1"), ("key", ">u2", DEPTH), ("node", "<i8"), ("sketch", "u1", SLOTS // 2)])
_MEMBER = np.dtype([("tree", "u1"), ("node", "<i8"), ("component", "<i8"), ("sketch", "u1", SLOTS // 2), ("heads", "<u2", (TREES, SHALLOW))])
MEMBERS = "head long, node long, component long, shingles long, record binary"
MET = "head long, i int, j int, side int, node long, record binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; the whole sequence where words are fewer; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n, out = len(words) - k + 1, np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(_mixed(out + np.uint64(k)))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(1, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SLOTS, np.uint64)


def _tree_slots() -> np.ndarray:
    rng = np.random.default_rng(60)
    return np.stack([rng.permutation(SLOTS)[:DEPTH] for _ in range(TREES)])


def signature(own: np.ndarray) -> bytes:
    """16 bits of each slot's least hash."""
    mul, add = (x[:, None] for x in _constants_cached())
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 512):
        least = np.minimum(least, (own[None, k : k + 512] * mul + add).min(axis=1))
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


_CONSTANTS: list = []


def _constants_cached():
    if not _CONSTANTS:
        _CONSTANTS.extend(_constants())
    return _CONSTANTS


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, size)
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return sign


def _records(batch: pa.RecordBatch) -> np.ndarray:
    """A row per tree, a record per node: tree, first slots in the tree's order, node, sketch."""
    slots = _tree_slots()
    sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SLOTS)
    nibble = (sig & 15).astype(np.uint8)
    out = np.zeros((TREES, len(sig)), _RECORD)
    out["node"] = batch.column(0).to_numpy(zero_copy_only=False)
    out["sketch"] = nibble[:, ::2] | nibble[:, 1::2] << 4
    for t in range(TREES):
        out["tree"][t] = t
        out["key"][t] = sig[:, slots[t]]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    raw, width = rows.tobytes(), rows.dtype.itemsize
    return pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per node and tree."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([_binary(_records(batch))], ["record"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node and tree: region, node, component, size and a record for comparisons."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _records(batch)
        out = np.zeros(rows.shape, _MEMBER)
        for name in ("tree", "node", "sketch"):
            out[name] = rows[name]
        out["component"] = batch.column(2).to_numpy(zero_copy_only=False)
        out["heads"] = rows["key"][:, :, :SHALLOW].transpose(1, 0, 2)
        out, size = out.ravel(), np.tile(batch.column(3).to_numpy(zero_copy_only=False), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(_heads(rows.ravel())), pa.array(out["node"]), pa.array(out["component"]), pa.array(size), _binary(out)], ["head", "node", "component", "shingles", "record"])


def _heads(rows: np.ndarray) -> np.ndarray:
    """A number per row that tells regions apart."""
    head = np.zeros(len(rows), np.int64)
    for v in (rows["tree"], *(rows["key"][:, j] for j in range(SHALLOW))):
        head = head << 16 | v.astype(np.int64)
    return head


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which sketches agree."""
    odd = x["sketch"] ^ y["sketch"]
    return ((odd & 15) == 0).sum(axis=-1) + ((odd & 240) == 0).sum(axis=-1)


def _pairs(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    likeness = ((same / SLOTS - 1 / 16) * 16 / 15).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(likeness)], ["a", "b", "likeness"])


def _need(least: float) -> int:
    return int(np.ceil(SLOTS * (least * 15 / 16 + 1 / 16)))


def _walker(least: float):
    """Compares neighbours in sorted records; yields likely pairs, and (node, node) for nodes of crowded regions."""
    need = _need(least)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros(0, _RECORD)
        tail_place = np.zeros(0, np.int64)
        border = carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.frombuffer(b"".join(batch.column(0).to_pylist()), _RECORD)
            rows, old = np.concatenate([tail, new]), len(tail)
            head = _heads(rows)
            opens = np.append(True, head[1:] != head[:-1])
            first = np.maximum.accumulate(np.where(opens, np.arange(len(rows)), 0))
            place = np.arange(len(rows)) - first
            if old:  # the tail's first region began before it
                place[first == 0] += tail_place[0]
            met = [np.zeros((3, 0), np.int64)]
            for w in range(1, DENSE):
                i = np.flatnonzero((head[w:] == head[:-w]) & ((place[w:] < DENSE) | (w <= NEAR))) + w
                i = i[i >= old]
                if not len(i):
                    if w > NEAR:
                        break
                    continue
                for k in range(0, len(i), 20_000):
                    own = i[k : k + 20_000]
                    x, y = rows[own], rows[own - w]
                    same = _alike(x, y)
                    ok = (same >= need) & (x["node"] != y["node"])
                    if ok.any():
                        met.append(np.stack([own[ok], own[ok] - w, same[ok]]))
            i, j, same = np.concatenate(met, axis=1)
            order = np.lexsort((-j, -same, i))
            i, j, same = i[order], j[order], same[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            named = rank < KEEP
            border = head[0] if border is None else border
            crowded = np.unique(np.concatenate([head[(place >= DENSE) | (head == border)], head[i[~named]]]))
            if carried is not None:  # the region went over from the batch before
                crowded = np.union1d(crowded, carried)
            found = [(rows["node"][i[named]], rows["node"][j[named]], same[named])]
            all_ = np.unique(rows["node"][np.isin(head, crowded)])
            found.append((all_, all_, np.full(len(all_), SLOTS)))
            yield _pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
            carried = head[-1:] if head[-1] in crowded else None
            tail, tail_place = rows[-DENSE:].copy(), place[-DENSE:].copy()
        if len(tail):  # the last region may go on in the next task
            head = _heads(tail)
            all_ = np.unique(tail["node"][head == head[-1]])
            yield _pairs(all_, all_, np.full(len(all_), SLOTS))

    return walk


def _likely(x: np.ndarray, y: np.ndarray, need: int) -> np.ndarray:
    """Which of ``y`` may be like which of ``x``, in another component, and don't meet in an earlier tree."""
    ones = np.uint64(0x1111111111111111)
    odd = np.ascontiguousarray(x["sketch"]).view("<u8")[:, None] ^ np.ascontiguousarray(y["sketch"]).view("<u8")[None]
    odd |= odd >> np.uint64(1)
    odd |= odd >> np.uint64(2)
    ok = SLOTS - np.bitwise_count(odd & ones).sum(axis=2, dtype=np.int64) >= need
    ok &= x["component"][:, None] != y["component"][None]
    a, b = np.nonzero(ok)
    for k in range(0, len(a), 100_000):
        p, q = a[k : k + 100_000], b[k : k + 100_000]
        t = int(x["tree"][0])
        ok[p, q] = ~(x["heads"][p, :t] == y["heads"][q, :t]).all(axis=2).any(axis=1)
    return ok


def _block_walker(least: float):
    """Compares the stray rows of one block with all rows of another (or the same) by sketches.

    Yields, once per pair of blocks, the rows of both that have a likely partner there.
    """
    need = _need(least)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                head, i, j, main = (batch.column(c)[k].as_py() for c in range(4))
                x, y = (np.frombuffer(b"".join(batch.column(c)[k].as_py()), _MEMBER) for c in (4, 5))
                if i > j:  # two strays meet where i < j
                    y = y[y["component"] == main]
                left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
                for lo in range(0, len(x), 32):
                    ok = _likely(x[lo : lo + 32], y, need)
                    left[lo : lo + 32] = ok.any(axis=1)
                    right |= ok.any(axis=0)
                if left.any():
                    rows = np.concatenate([x[left], y[right]])
                    n = len(rows)
                    side = np.repeat([0, 1], [left.sum(), right.sum()])
                    cols = [pa.array(np.full(n, head)), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(side.astype(np.int32)), pa.array(rows["node"]), _binary(rows)]
                    yield pa.RecordBatch.from_arrays(cols, ["head", "i", "j", "side", "node", "record"])

    return walk


def _settler(least: float, threshold: float):
    """Settles the likely pairs of two blocks on full sets; yields links that join their components."""
    need, percent = _need(least), round(threshold * 100)

    def settle(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        rows = np.frombuffer(b"".join(group.column("record").to_pylist()), _MEMBER)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        x, y = rows[side == 0], rows[side == 1].copy()
        mine, others = ([sets[k] for k in np.flatnonzero(side == v)] for v in (0, 1))
        size = np.array([len(s) for s in others], np.int64)
        all_, start = np.concatenate([*others, np.zeros(0, np.uint64)]), np.cumsum(size) - size
        x_of = x["component"].copy()
        links = []
        for k in range(len(x)):
            own, n = mine[k], len(mine[k])
            one = x[k : k + 1].copy()
            one["component"] = x_of[k]
            at = np.flatnonzero(_likely(one, y, need)[0] & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
            if not len(at):
                continue
            take = np.repeat(start[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
            values = all_[take]
            hit = own[np.minimum(np.searchsorted(own, values), n - 1)] == values
            both = np.bincount(np.repeat(np.arange(len(at)), size[at]), hit, len(at)).astype(np.int64)
            for m in at[100 * both >= percent * (n + size[at] - both)]:
                a, b = x_of[k], y["component"][m]
                if a != b:
                    links.append((x["node"][k], y["node"][m]))
                    low = min(a, b)
                    for c in (x_of, y["component"]):
                        c[(c == a) | (c == b)] = low
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return settle


def _setter(size: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "own"])

    return collect


def _confirmer(size: int, threshold: float):
    percent = round(threshold * 100)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            known: dict[int, np.ndarray] = {}
            keep = []
            for k in range(len(a)):
                own = []
                for node, text in ((a[k], x[k]), (b[k], y[k])):
                    key = hash((node, text))
                    if key not in known:
                        known[key] = shingles(text, size)
                    own.append(known[key])
                both = len(np.intersect1d(own[0], own[1], assume_unique=True))
                if 100 * both >= percent * (len(own[0]) + len(own[1]) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of at least
    ``threshold`` are linked; a component's id is the smallest doc_id in it. Documents without
    words (or null) link with nothing. Copies of one set are one node. Rows that share a doc_id
    share a node and are linked if any of their texts is; a null doc_id links with nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs)
    signed = materialise(rows.mapInArrow(_signer(size), schema(SIGNED)), "signed")
    nodes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "signature", "n_shingles")).alias("m"))
    nodes = materialise(nodes.select("set_key", F.col("m.doc_id").alias("node"), F.col("m.signature").alias("signature"), F.col("m.n_shingles").alias("shingles")), "nodes")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = nodes.select("node", "signature").mapInArrow(_plant, schema("record binary")).repartitionByRange(n, "record").sortWithinPartitions("record")
    met = materialise(forest.mapInArrow(_walker(threshold - MARGIN), schema(PAIRS)).groupBy("a", "b").agg(F.max("likeness").alias("likeness")), "likely")
    crowd = nodes.join(met.where("a = b").select(F.col("a").alias("node")), "node", "left_semi").select("node", "signature", "shingles")
    crowd = materialise(crowd, "crowd")
    likely = met.where("a < b")

    ends = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # The ids grow with the documents, so this is a merge join at every size.
    texts = materialise(rows.join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        # Written first: where few pairs are left, Spark sees it and leaves the texts in place.
        pairs = materialise(pairs.select("a", "b"), "pairs")
        x, y = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        joined = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
        return materialise(joined.mapInArrow(_confirmer(size, threshold), schema("a long, b long")), "confirmed")

    def still_apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
        x, y = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    sides = likely.select(F.col("a").alias("s"), "a", "b", "likeness").union(likely.select("b", "a", "b", "likeness"))
    best = sides.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("likeness"), "a", "b")))  # a row names KEEP pairs per tree, and few name it
    first = materialise(best.where(F.col("k") <= FIRST).select("a", "b").distinct(), "first")
    links = confirmed(first)
    known = components(links)
    links = links.unionByName(confirmed(still_apart(likely, known).join(first, ["a", "b"], "left_anti")))
    known = components(links)

    own = crowd.join(known, "node", "left").select("node", "signature", F.coalesce("component", "node").alias("component"), "shingles")
    members = materialise(own.mapInArrow(_members, schema(MEMBERS)), "members")
    kinds = members.groupBy("head", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("size"))
    regions = kinds.groupBy("head").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "component"))["component"].alias("main")).where("kinds > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    regions = regions.select("head", "main", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(regions, ["head", "salt"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("head", "node"), F.col("blocks")).cast("int"))
    dealt = placed.groupBy("head", "main", "blocks", "block").agg(F.collect_list(F.when(F.col("component") != F.col("main"), F.col("record"))).alias("strays"), F.collect_list("record").alias("rows"))
    dealt = materialise(dealt, "blocks")
    left = dealt.where(F.size("strays") > 0).select("head", "main", F.col("block").alias("i"), "strays", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    both = left.join(dealt.select("head", F.col("block").alias("j"), "rows"), ["head", "j"]).repartition(n, "head", "i", "j")
    pairs = materialise(both.select("head", "i", "j", "main", "strays", "rows").mapInArrow(_block_walker(threshold - MARGIN), schema(MET)), "met")
    ids = pairs.select(F.col("node").alias("doc_id")).distinct()
    # Rows that share an id are one node by the set that the node stands for, in each of its texts.
    sets = materialise(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_setter(size), schema("node long, own binary")), "sets")
    settled = pairs.join(sets, "node").groupBy("head", "i", "j").applyInArrow(_settler(threshold - MARGIN, threshold), schema("a long, b long"))
    fresh = materialise(settled, "settled")
    if not fresh.isEmpty():
        known = components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(fresh))

    classes = materialise(nodes.select("set_key", "node").join(known, "node", "left").select("set_key", F.coalesce("component", "node").alias("component")), "classes")
    out = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents on 2-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=2, threshold=0.8)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
