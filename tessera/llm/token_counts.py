"""Token counts by a compiled finite-state transducer (operator 4).

Byte-pair merging inside one pre-token is a deterministic transducer over bytes. After each
byte, the tokens of the prefix read so far end with exactly one token; which one depends only
on the positions from which a longer token may still grow. A state keeps these positions, the
last token before each of them, and how many tokens each lies back; a transition is annotated
with the change in the number of tokens. States are compiled when text first reaches them.

Pre-tokens start in one known state, so each is a chunk whose state map is needed at one point
only. A pre-token longer than ``CHUNK`` bytes is cut: a chunk's map is first known at one state
(the one that its neighbour's last bytes lead to), and the maps compose pairwise, level by level,
as in the up-sweep of a parallel prefix scan; where a left map ends in a state at which the right
one isn't known yet, the right one is evaluated there. All chunks of a batch step through the
table together. A long text takes a number of levels logarithmic in its length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, schema, small_batches, table

ROWS = "doc_id long, n_bytes long, n_tokens long"
CHUNK, WARM = 256, 32
#: States a worker keeps (256 transitions of 5 bytes each); beyond that it compiles anew.
MAX_STATES = 250_000
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = _SPACE
    return out


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of texts laid end to end; ``first``: starts of texts.

    The splitting is that of byte-level vocabularies: contractions, runs of letters, numbers or
    other signs with one space before them, and white space, of which a run before a visible
    character leaves its last one out.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = char_classes()[points]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= head
    white = kind == _SPACE
    last_white = white & change[1:] & ~head[1:]  # a visible character of the same text follows
    starts = change.copy()
    starts[:n] |= last_white  # it parts from the white space before it
    glued = last_white & (points == 32)
    starts[1:][glued] = False  # and a plain space joins what follows
    # 's 't 'm 'd 're 've 'll, where a pre-token begins with the apostrophe
    quote = np.flatnonzero((points == 39) & starts[:n])
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        text_end = np.append(np.flatnonzero(head[1:]) + 1, n)
        end = text_end[np.searchsorted(text_end, quote, "right")]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [115, 116, 109, 100]) & (quote + 1 < end)
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (quote + 2 < end)
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            starts[at + 1] = False
            if size == 3:
                starts[at + 2] = False
            starts[at + size] = True  # what is left of a run of letters begins anew
    return starts[:n]


class CountTransducer:
    """Transducer from bytes to changes of the token count, compiled from a merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        shown = {chr(c): i for i, c in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)])}
        visible = {s: ord(s) for s in shown}
        spare = [b for b in range(256) if b not in set(visible.values())]
        to_byte = visible | {chr(256 + k): b for k, b in enumerate(spare)}
        self.special = [x["content"] for x in model["added_tokens"] if x["content"]]
        raw = lambda token: bytes(to_byte[c] for c in token)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        #: Tokens by number: bytes first, then merges in order; a number is also a rank.
        self.rank: dict[tuple[int, int], int] = {}
        number = {bytes([b]): b for b in range(256)}
        self.left, self.right = [*range(256)], [*range(256)]
        for a, b in pairs:
            x, y = number[raw(a)], number[raw(b)]
            made = len(self.left)
            self.rank[x, y] = made
            number.setdefault(raw(a) + raw(b), made)
            self.left.append(x)
            self.right.append(y)
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, k in number.items():
            node = 0
            for b in token:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][b]
            self.token_at[node] = k
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states."""
        self.fits: dict[tuple[int, int], bool] = {}
        #: A state: (trie node, last token before it or -1, tokens since then) for each open start.
        self.states: list[tuple] = [((0, -1, 0),)]
        self.index = {self.states[0]: 0}
        self.next = np.full((1024, 256), -1, np.int32)
        self.delta = np.zeros((1024, 256), np.int8)

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: no merge crosses their border.

        Both grow by merges of rising rank; the border holds if at no time the outermost pieces
        merge with each other before either merges inwards.
        """
        if (a, b) in self.fits:
            return self.fits[a, b]
        spine_a, spine_b = [a], [b]
        while spine_a[-1] >= 256:
            spine_a.append(self.right[spine_a[-1]])
        while spine_b[-1] >= 256:
            spine_b.append(self.left[spine_b[-1]])
        i, j, far = len(spine_a) - 1, len(spine_b) - 1, 1 << 60
        held = True
        while True:
            cross = self.rank.get((spine_a[i], spine_b[j]), far)
            up_a, up_b = spine_a[i - 1] if i else far, spine_b[j - 1] if j else far
            if cross < up_a and cross <= up_b:
                held = False
                break
            if up_a == far and up_b == far:
                break
            if up_a <= up_b:
                i -= 1
            else:
                j -= 1
        self.fits[a, b] = held
        return held

    def compile(self, state: int, byte: int) -> None:
        """Fill in one transition."""
        opened, total, last = [], None, -1
        here = 0
        for node, before, since in self.states[state]:
            down = self.child[node].get(byte)
            if down is None:
                continue
            token = self.token_at[down]
            if token >= 0 and total is None and (before < 0 or self.stays(before, token)):
                total, last = since, token
            if self.child[down]:
                opened.append((down, before, since))
        # `since` counts tokens from the open start to the end of the old prefix; the new prefix has
        # one token more than the prefix before the token that now ends it.
        change = 1 - total
        made = tuple((node, before, since + change) for node, before, since in opened) + ((0, last, here),)
        to = self.index.get(made)
        if to is None:
            to = len(self.states)
            self.index[made] = to
            self.states.append(made)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        self.next[state, byte] = to
        self.delta[state, byte] = change

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step all chunks together; returns their last states and changes in count."""
        order = np.argsort(-size, kind="stable")
        at, left, now = start[order], size[order], state[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        rising = left[::-1]
        for k in range(int(left[0]) if len(left) else 0):
            n = len(left) - int(np.searchsorted(rising, k, "right"))
            if not n:
                break
            byte = data[at[:n] + k]
            to = self.next[now[:n], byte]
            if (to < 0).any():
                key = np.unique(now[:n][to < 0] * 256 + byte[to < 0])
                for x in key.tolist():
                    self.compile(x >> 8, x & 255)
                to = self.next[now[:n], byte]
            count[:n] += self.delta[now[:n], byte]
            now[:n] = to
        out_state, out_count = np.empty_like(now), np.empty_like(count)
        out_state[order], out_count[order] = now, count
        return out_state, out_count

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``data[start : start + size]``."""
        if len(self.states) > MAX_STATES:
            self.reset()
        pieces = np.maximum(1, -(-size // CHUNK))
        if not len(size) or pieces.max() == 1:
            return self.run(data, start, size, np.zeros(len(size), np.int64))[1]
        owner = np.repeat(np.arange(len(size)), pieces)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = start[owner] + k * CHUNK
        length = np.minimum(CHUNK, size[owner] - k * CHUNK)
        entry = np.zeros(len(owner), np.int64)
        later = np.flatnonzero(k > 0)
        entry[later] = self.run(data, at[later] - WARM, np.full(len(later), WARM), np.zeros(len(later), np.int64))[0]
        state, found = self.run(data, at, length, entry)
        return self.compose(data, owner, k, at, length, entry, state, found)

    def compose(self, data, owner, k, at, length, entry, state, found) -> np.ndarray:
        """Tokens of each pre-token from its chunks' maps, in order: (start, length, entry, exit, change in count)."""
        while k.max(initial=0):
            right = np.flatnonzero(k & 1)
            left = right - 1
            wrong = right[entry[right] != state[left]]
            if len(wrong):
                entry[wrong] = state[wrong - 1]
                state[wrong], found[wrong] = self.run(data, at[wrong], length[wrong], entry[wrong])
            state[left] = state[right]
            found[left] += found[right]
            length[left] += length[right]
            kept = np.flatnonzero((k & 1) == 0)
            owner, k, at, length, entry, state, found = owner[kept], k[kept] >> 1, at[kept], length[kept], entry[kept], state[kept], found[kept]
        return found.astype(np.int64)


_LOADED: dict[str, CountTransducer] = {}


def count_texts(texts: list[str], transducer: CountTransducer) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    extra = np.zeros(len(texts), np.int64)  # special strings
    parts, owner = [], []
    for k, text in enumerate(texts):
        cut = [text]
        for mark in transducer.special:  # a special string is one token and parts the text
            if mark in text:
                cut = [piece for x in cut for piece in x.split(mark)]
        extra[k] = len(cut) - 1
        parts += cut
        owner += [k] * len(cut)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    whole = "".join(parts)
    data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    text_start = np.cumsum(sizes) - sizes
    char_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    starts = np.flatnonzero(pretoken_starts(points, text_start[text_start < len(points)]))
    begin = char_at[starts]
    size = np.diff(np.append(begin, len(data)))
    tokens = transducer.count(data, begin, size)
    part_of = np.searchsorted(text_start, starts, "right") - 1
    per_text = np.bincount(np.asarray(owner, np.int64)[part_of], tokens, len(texts)).astype(np.int64) if len(starts) else np.zeros(len(texts), np.int64)
    n_bytes = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in texts), np.int64, len(texts))
    return n_bytes, per_text + extra


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = CountTransducer(path)
        for batch in batches:
            n_bytes, n_tokens = count_texts(batch.column(1).to_pylist(), _LOADED[path])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs(doc_id, text)``; null text counts as empty.

    A map without a shuffle. Rows that repeat are counted each, whatever their ids; a text of any
    length is cut into chunks that are stepped through together; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(_counter(tokenizer), schema(ROWS))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by byte_bpe_50k."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", counted.n_tokens > 1024)
