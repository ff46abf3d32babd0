"""Benchmark decontamination with a generalised suffix automaton (operator 1).

Benchmark items are normalised to words and go into one suffix automaton. Training words are
streamed through it; at each word the automaton knows the longest run of words ending there that
stands in some item. A window is ``window`` consecutive item words, or a whole shorter item; the
words of every occurrence are hit. Items are taken in shards of bounded size, one automaton
each, so neither the driver nor a task ever holds more than a shard.
"""

from __future__ import annotations

import functools
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, schema, small_batches, table

WINDOW = 10
#: UTF-8 bytes of item texts that one automaton may hold.
SHARD_BYTES = 8 << 20
HITS = "doc_id long, row_key long, n_words long, spans array<struct<first: int, last: int>>, items array<string>"

#: A-Z to lower case; what is neither a digit, a letter nor beyond ASCII, to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: str) -> bytes:
    """The text's UTF-8 bytes, normalised one for one."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers of ``(item_id, text)`` rows.

    Most states have one transition: it stands in two arrays, and a table has the others.
    """

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.word, self.to = array("i", [0]), array("i", [0])
        self.more: dict[int, int] = {}  # state << 32 | word: state
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.shortest = window
        others: dict[int, list[int]] = defaultdict(list)  # words of a state in ``more``
        ends: list[tuple[int, int, int]] = []
        here: dict[int, list[int]] = defaultdict(list)  # items of which the state's strings end at some place
        self.items: list[str] = []
        for item, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in fold(text).split()]
            if not words:
                continue
            last, number = 0, len(self.items)
            self.items.append(str(item))
            for w in words:
                last = self._extend(last, w, others)
                if len(words) >= window and here[last][-1:] != [number]:
                    here[last].append(number)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                ends.append((number, len(words), last))
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")
        #: Sets of items that hold a window.
        self.groups: list[tuple[int, ...]] = []
        held: dict[int, int] = {}
        place: dict[tuple[int, ...], int] = {}
        up: dict[int, set[int]] = {s: set(x) for s, x in here.items() if x}
        for s in order[::-1].tolist():
            if self.length[s] < window:
                break
            mine = up.pop(s, set())
            parent = self.link[s]
            if self.length[parent] >= window:
                up.setdefault(parent, set()).update(mine)
                continue
            group = tuple(sorted(mine))
            if group not in place:
                place[group] = len(self.groups)
                self.groups.append(group)
            held[s] = place[group]
        #: For each state beyond window length, the group of the window that its strings end with.
        self.holder = array("i", bytes(4 * len(self.link)))
        for s in order[np.searchsorted(np.frombuffer(self.length, np.int32)[order], window) :].tolist():
            self.holder[s] = held[s] if s in held else self.holder[self.link[s]]
        #: Per state: short items that are suffixes of its longest string, shortest first.
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, n, state in ends:
            own[state].append((n, item))
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in order[1:].tolist() if own else ():
            above = self.short.get(self.link[s], ())
            if s in own:
                above = (*above, *sorted(own[s]))
            if above:
                self.short[s] = above

    def _get(self, state: int, w: int) -> int:
        """Where a word leads; 0: nowhere (nothing leads to the root)."""
        return self.to[state] if self.word[state] == w else self.more.get(state << 32 | w, 0)

    def _set(self, state: int, w: int, to: int, others: dict[int, list[int]]) -> None:
        if self.word[state] in (0, w):
            self.word[state], self.to[state] = w, to
        else:
            key = state << 32 | w
            if key not in self.more:
                others[state].append(w)
            self.more[key] = to

    def _add(self, length: int, link: int) -> int:
        for column, value in ((self.word, 0), (self.to, 0), (self.length, length), (self.link, link)):
            column.append(value)
        return len(self.link) - 1

    def _extend(self, last: int, w: int, others: dict[int, list[int]]) -> int:
        if q := self._get(last, w):
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q, others)
        made = self._add(self.length[last] + 1, 0)
        p = last
        while p >= 0 and not self._get(p, w):
            self._set(p, w, made, others)
            p = self.link[p]
        if p >= 0:
            q = self._get(p, w)
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q, others)
        return made

    def _clone(self, p: int, w: int, q: int, others: dict[int, list[int]]) -> int:
        made = self._add(self.length[p] + 1, self.link[q])
        self.word[made], self.to[made] = self.word[q], self.to[q]
        for v in others.get(q, ()):
            self._set(made, v, self.more[q << 32 | v], others)
        self.link[q] = made
        while p >= 0 and self._get(p, w) == q:
            self._set(p, w, made, others)
            p = self.link[p]
        return made

    def stream(self, words: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        """Matches of a run of known words; adds hit spans [first, last) and numbers of items."""
        word, to, more, link, length, window, short = self.word, self.to, self.more, self.link, self.length, self.window, self.short
        holder, groups = self.holder, self.groups
        state = matched = 0
        for k, w in enumerate(words, offset + 1):
            while not (step := to[state] if word[state] == w else more.get(state << 32 | w, 0)) and state:
                state = link[state]
                matched = length[state]
            if step:
                state = step
                matched += 1
            if matched >= window:
                items.update(groups[holder[state]])
                spans.append((k - window, k))
            if state in short:
                for n, item in short[state]:
                    if n <= matched:
                        items.add(item)
                        spans.append((k - n, k))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit spans, ascending, and the items met."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self.stream(ids[a:b].tolist(), a, spans, items)
        return merge(spans), {self.items[k] for k in items}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple[object, str]]]:
    """Item rows with an id in lists of at most ``shard_bytes`` of text (or one longer item), one list at a time."""
    rows, size = [], 0
    for r in items.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator(prefetchPartitions=False):
        n = len(r.text.encode("utf-8", "surrogatepass"))
        if rows and size + n > shard_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield rows


def _finder(automaton):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: SuffixAutomaton = automaton.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(2).to_pylist():
                words = fold(text).split()
                s, i = auto.find(words)
                n_words.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in s])
                items.append(sorted(i))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row_key", "n_words", "spans", "items"])

    return find


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, row_key, n_words, spans, items) of every row of ``docs(doc_id, text)``.

    ``spans``: disjoint hit word ranges; ``items``: ids met, as sorted strings. ``row_key`` is a
    hash of the text, which tells rows with one doc_id apart. Null texts have no words; null or
    empty items give no window. With one shard of items this is a map without a shuffle; with
    more, each shard is one more pass and the spans of a row are united.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    found = []
    for part in shards(items, shard_bytes):
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(part, window))
        found.append(rows.mapInArrow(_finder(automaton), schema(HITS)))
    if not found:
        found = [rows.mapInArrow(_finder(spark.sparkContext.broadcast(SuffixAutomaton([], window))), schema(HITS))]
    if len(found) == 1:
        return found[0]
    out = materialise(found[0], "hits")
    for more in found[1:]:
        hit = materialise(more.where(F.size("items") > 0).dropDuplicates(["doc_id", "row_key"]), "hits").select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_r"), F.col("spans").alias("_s"), F.col("items").alias("_i"))
        both = out.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_r")), "left")
        out = both.select("doc_id", "row_key", "n_words", _united("spans", "_s").alias("spans"), F.array_sort(F.array_union("items", F.coalesce("_i", F.array().cast("array<string>")))).alias("items"))
    return out


def _united(a: str, b: str):
    """Union of two arrays of disjoint spans."""
    kind = "array<struct<first:int,last:int>>"
    spans = F.array_sort(F.concat(F.col(a), F.coalesce(F.col(b), F.array().cast(kind))))

    def add(done, x):
        top = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(kind), add)


def _remover(longest: int, coverage: float, automaton=None):
    """Cuts what the automaton finds or, without one, the spans in the last column, which goes."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            given = None if automaton else batch.column(batch.num_columns - 1).to_pylist()
            if given is not None:
                batch = batch.select(list(range(batch.num_columns - 1)))
            keep, texts = [], []
            for k, text in enumerate(batch.column(at).to_pylist()):
                cut, again = text, bool(text)
                while again:
                    before = cut
                    spans = automaton.value.find(fold(cut).split())[0] if automaton else [(s["first"], s["last"]) for s in given[k] or ()]
                    cut = cut_spans(before, spans, longest, coverage)
                    # What a cut leaves may join to an item anew; without the automaton the caller looks again.
                    again = automaton is not None and cut is not None and cut != before
                if cut is not None or text is None:
                    keep.append(k)
                    texts.append(cut)
            yield batch.take(pa.array(keep, pa.int32())).set_column(at, "text", pa.array(texts, pa.string()))

    return remove


def cut_spans(text: str, spans: list[tuple[int, int]], longest: int, coverage: float) -> str | None:
    """The text without spans of at least ``longest`` words; None where these cover more than ``coverage``."""
    folded = fold(text)
    words = folded.split()
    spans = [(a, b) for a, b in spans if b - a >= longest]
    if not spans:
        return text
    if sum(b - a for a, b in spans) > coverage * len(words):
        return None
    mask = np.frombuffer(folded, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    first, last = edge[::2], edge[1::2]
    raw, out, done = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(raw[done : first[a]])
        done = int(last[b - 1])
    out.append(raw[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` (all its columns) without contaminated spans, and without documents that they dominate.

    Hit spans of at least ``longest`` words are cut out of the text; a document of whose words they
    cover more than ``coverage`` goes. What a cut leaves may join to an item anew, so a text that was
    cut is looked through again, until nothing is found. Null texts stay, as do rows with a null id;
    repeated rows are judged each alike. Spans of all shards of items are found on the same text and
    united before they are judged; of several shards, only the texts that were cut are looked through
    again, in a pass of their own.
    """
    small_batches(docs.sparkSession)
    parts = shards(items, shard_bytes)
    first = next(parts, None)
    if first is None:
        return docs
    if next(parts, None) is None:
        automaton = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(first, window))
        return docs.mapInArrow(_remover(longest, coverage, automaton), docs.schema)
    mark = f"_{uuid.uuid4().hex}"  # beside columns of any name
    left, found = docs, []
    while True:
        hits = find_contamination(left, items, window=window, shard_bytes=shard_bytes).where(F.exists("spans", lambda s: s["last"] - s["first"] >= longest)).dropDuplicates(["doc_id", "row_key"])
        hits = hits.select(F.col("doc_id").alias(f"{mark}_doc"), F.col("row_key").alias(f"{mark}_row"), F.col("spans").alias(f"{mark}_spans"))
        same = left["doc_id"].cast("long").eqNullSafe(hits[f"{mark}_doc"]) & (F.xxhash64(F.coalesce(left["text"], F.lit(""))) == hits[f"{mark}_row"])
        judged = materialise(left.join(hits, same, "left").drop(f"{mark}_doc", f"{mark}_row"), "judged")
        found.append(judged.where(F.col(f"{mark}_spans").isNull()).drop(f"{mark}_spans"))
        cut = judged.where(F.col(f"{mark}_spans").isNotNull())
        if cut.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        left = materialise(cut.mapInArrow(_remover(longest, coverage), docs.schema), "cut")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark items in all documents."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_OP1 = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM d
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[k : k + least(10, len(words)) - 1], ' ') AS key
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM b WHERE len(words) > 0)
), sizes AS (
    SELECT DISTINCT n FROM windows
), found AS (
    SELECT p.doc_id, p.k, p.n, x.item_id
    FROM (SELECT doc_id, k, n, array_to_string(words[k : k + n - 1], ' ') AS key
          FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM w, sizes WHERE len(words) >= n)) p
    JOIN windows x ON x.n = p.n AND x.key = p.key
), hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM found) GROUP BY doc_id
), met AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""
