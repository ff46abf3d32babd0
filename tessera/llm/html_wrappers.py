"""Main text of web pages by union-free wrapper inference (operator 8).

A page is a stream of block tags and texts. Repeats inside it fold into groups; then the streams
of one host are aligned one after another into one wrapper, a union-free regular expression:
what only some pages have becomes optional, adjacent likenesses become repeated groups, and
texts that differ become slots. Tasks infer wrappers of the pages they hold, and wrappers of one
host are aligned with each other in rounds, ``FAN`` tasks' at a time, so a host with a third of
all pages meets in small parts. The wrapper counts on how many pages each of its texts stands. A
text that all pages of a host share is furniture: it can't make an element the article's place,
and where no element names the article, slots are the article, and shared texts and links aren't.
Every page is read through the wrapper of its host.
"""

from __future__ import annotations

import bisect
import functools
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, schema, small_batches, table

#: Longest repeat, in tokens, that folds into a group.
PERIOD = 24
#: Wrappers of one host that a round aligns in a task; parts in which the pages of a common host meet its wrapper.
FAN, SALTS = 16, 16
#: Products of lengths up to which streams are aligned by the longest common blocks; longer ones are parted at tokens that both hold once.
SMALL, PIECE = 40_000, 200
#: Wrappers of all hosts are broadcast up to so many bytes; beyond that they are joined by host and salt.
BROADCAST_BYTES = 32 << 20
WRAPPERS = "host string, salt long, pages long, wrapper string"

#: Elements that break lines, of which some end where a sibling starts.
BLOCKS = set(
    "address article aside blockquote body button canvas center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main "
    "math menu nav noscript object ol option p pre section select summary svg table tbody td template tfoot th thead tr ul video audio".split()
)
OPEN_ENDED = {"p", "li", "dd", "dt", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "hr"}
RAW = "script|style|textarea|title|xmp|noembed|noframes"
SILENT = {"html", "body"}
#: Elements whose text is no article, and words in class, id or role that say so.
DROP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "dialog", "menu", "head", "fieldset", "audio", "video"}
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended "
    "subscribe subscription newsletter signup login widget widgets toolbar pagination pager skip hidden complementary contentinfo search dialog form".split()
)
#: Words after which a name tells an element's looks (``has-sidebar`` is a layout, the words before ``with`` still count).
LAYOUT_WORDS = {"has", "with", "no", "without"}
#: Words at a name's end that tell its part, kind or place: what stands before them is what the name is about
#: (``comment-list`` has comments, ``post-ad`` is an advert, but ``related-work`` is work).
PART_WORDS = set(
    "area article articles author avatar bar block body bottom box btn button buttons card column container content desktop entry foot form group head heading icon icons image img inner item items label large left "
    "line link links list main media meta mobile outer page panel post posts primary right row secondary section slot small stories story text thread title to top trail unit wrap wrapper zone".split()
)
#: Where an article is, the most telling first.
REGION_TAGS = ("article", "main")
REGION_WORDS = {"article", "main", "entry", "post", "story", "content", "articlebody"}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")
SIG, UNIT, OPTIONAL, CONSTANT, CHARS, LINKED, PAGES, AT = range(8)


def _signature(name: str, attributes: str) -> str:
    """Tag name with class, id and role, numbers levelled."""
    if "=" not in attributes and "hidden" not in attributes:
        return name
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    marks = [f"{k}={' '.join(sorted(_DIGITS.sub('0', found[k].lower()).split()))}" for k in ("class", "id", "role") if found.get(k)]
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) or "display:none" in found.get("style", "").replace(" ", "").lower():
        marks.append("hidden=hidden")
    return " ".join([name, *marks])


def page_stream(source: str | None) -> tuple[list[list], list[str]]:
    """(items, texts): block tags and texts of a page; a text item names its place in ``texts``."""
    items: list[list] = []
    texts: list[str] = []
    parts: list[str] = []
    linked = depth = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            items.append(["#", None, False, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text), min(linked, len(text)), 1, [len(texts)]])
            texts.append(text)
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(source or ""):
        name = m[3]
        if name is None:
            piece = m[0]
            if m[1] is None and (piece[0] != "<" or piece == "<"):
                piece = html.unescape(piece)
                parts.append(piece)
                linked += len(piece) if depth else 0
            elif m[1] is not None and m[1].lower() == "textarea":
                flush()
            continue
        name, closing = name.lower(), bool(m[2])
        if name == "br":
            parts.append(" ")
        elif name == "a":
            depth = 0 if closing else 1
        elif name in BLOCKS:
            flush()
            if name in SILENT or closing and name in OPEN_ENDED:
                if closing and name in OPEN_ENDED and name != "hr":
                    items.append(["/" + name, None, False, None, 0, 0, 1, []])
                continue
            items.append(["/" + name if closing else _signature(name, m[4] or ""), None, False, None, 0, 0, 1, []])
    flush()
    # An end tag that a sibling's start implies carries nothing.
    kept = [x for x in items if not (x[SIG][0] == "/" and x[SIG][1:] in OPEN_ENDED and x[SIG] not in ("/td", "/th"))]
    return [x for x in kept if x[SIG] not in ("/td", "/th")], texts


def _balanced(unit: list[list]) -> bool:
    """Whether every element that starts in the unit ends in it."""
    stack: list[str] = []
    for x in unit:
        sig = x[SIG]
        if sig[0] in "#(":
            continue
        if sig[0] == "/":
            if not stack or stack.pop() != sig[1:]:
                return False
        elif (name := sig.split(" ", 1)[0]) not in OPEN_ENDED:
            stack.append(name)
    return not stack


def _join(a: list, b: list, apart: bool = False) -> list:
    """Two items of one signature as one; ``apart``: they stand on different pages."""
    unit = None if a[UNIT] is None else [_join(x, y, apart) for x, y in zip(a[UNIT], b[UNIT], strict=True)]
    pages = a[PAGES] + b[PAGES] if apart else max(a[PAGES], b[PAGES])
    return [a[SIG], unit, a[OPTIONAL] or b[OPTIONAL], a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], pages, a[AT] + b[AT]]


def _group(units: list[list[list]]) -> list:
    """Occurrences of a unit as one repeated group."""
    unit = [list(x) for x in units[0]]
    for more in units[1:]:
        unit = [_join(x, y) for x, y in zip(unit, more, strict=True)]
    return ["(" + " ; ".join(x[SIG] for x in unit) + ")+", unit, False, None, 0, 0, max(x[PAGES] for x in unit), []]


def fold(items: list[list]) -> list[list]:
    """Adjacent repeats as groups, short ones first."""
    period = 1
    while period <= min(PERIOD, len(items) // 2):
        sig = [x[SIG] for x in items]
        out: list[list] = []
        i, changed = 0, False
        while i < len(items):
            j = i + period
            if j < len(sig) and sig[i] == sig[j] and sig[i:j] == sig[j : j + period] and _balanced(items[i:j]):
                while sig[i : i + period] == sig[j : j + period]:
                    j += period
                if period == 1 and items[i][UNIT] is not None:
                    group = items[i]
                    for x in items[i + 1 : j]:
                        group = _join(group, x)
                else:
                    group = _group([items[k : k + period] for k in range(i, j, period)])
                    group[OPTIONAL] = all(x[OPTIONAL] for x in items[i:j])
                out.append(group)
                i, changed = j, True
            else:
                out.append(items[i])
                i += 1
        items = out
        period = 1 if changed else period + 1
    return items


def _units(items: list[list]) -> dict[tuple[str, ...], None]:
    """Signatures of all repeated groups, inner ones first."""
    out: dict[tuple[str, ...], None] = {}
    for x in items:
        if x[UNIT] is not None:
            out |= _units(x[UNIT])
            out[tuple(y[SIG] for y in x[UNIT])] = None
    return out


def regroup(items: list[list], units: dict[tuple[str, ...], None]) -> list[list]:
    """Single occurrences of known repeated groups as groups."""
    for unit in units:
        n, sig = len(unit), [x[SIG] for x in items]
        if unit[0] not in sig:
            continue
        out, i = [], 0
        while i < len(items):
            if sig[i] == unit[0] and tuple(sig[i : i + n]) == unit:
                group = _group([items[i : i + n]])
                group[OPTIONAL] = all(x[OPTIONAL] for x in items[i : i + n])
                out.append(group)
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return fold(items)


def _anchors(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of tokens that stand once on both sides, rising on both."""
    once = [{x: k for k, x in enumerate(side)} for side in (left, right)]
    counts = [Counter(side) for side in (left, right)]
    both = [(k, once[1][x]) for x, k in once[0].items() if counts[0][x] == 1 and counts[1].get(x) == 1]
    both.sort()
    tops: list[int] = []  # the longest rising run: patience
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(both):
        at = bisect.bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        tops[at : at + 1], last[at : at + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(both[n])
        n = before[n]
    return out[::-1]


def matches(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of places that an alignment of two streams matches, rising; in time near linear."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(left), 0, len(right))]
    while open_:
        i, j, k, m = open_.pop()
        while i < j and k < m and left[i] == right[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and left[j - 1] == right[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= SMALL:
            out += [(i + a + d, k + b + d) for a, b, n in SequenceMatcher(None, left[i:j], right[k:m], autojunk=False).get_matching_blocks() for d in range(n)]
            continue
        anchors = _anchors(left[i:j], right[k:m])
        if not anchors:  # nothing stands once: parts of equal shares
            parts = max(-(-(j - i) // PIECE), -(-(m - k) // PIECE), 2)
            cuts = [(i + (j - i) * p // parts, k + (m - k) * p // parts) for p in range(parts + 1)]
            open_ += [(a, c, b, d) for (a, b), (c, d) in pairwise(cuts)]
            continue
        a, b = i, k
        for x, y in anchors:
            out.append((i + x, k + y))
            open_.append((a, i + x, b, k + y))
            a, b = i + x + 1, k + y + 1
        open_.append((a, j, b, m))
    return sorted(out)


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """The wrapper of both: mismatches become optional, differing texts become slots."""
    units = _units(wrapper) | _units(other)
    a, b = regroup(wrapper, units), regroup(other, units)
    left, right = [x[SIG] for x in a], [x[SIG] for x in b]
    if left == right:
        return [_join(x, y, True) for x, y in zip(a, b, strict=True)]
    out: list[list] = []
    i = k = 0
    for j, m in [*matches(left, right), (len(a), len(b))]:
        out += [[*x[:OPTIONAL], True, *x[CONSTANT:]] for x in (*a[i:j], *b[k:m])]
        if j < len(a):
            out.append(_join(a[j], b[m], True))
        i, k = j + 1, m + 1
    return fold(out)


def _bare(items: list[list]) -> list[list]:
    """Items without places of texts."""
    return [[*x[:UNIT], x[UNIT] and _bare(x[UNIT]), *x[OPTIONAL:AT], []] for x in items]


def infer(streams: Iterator[list[list]]) -> list[list] | None:
    """One wrapper of many streams."""
    out = None
    for items in streams:
        items = _bare(fold(items))
        out = items if out is None else align(out, items)
    return out


@functools.lru_cache(maxsize=1 << 16)
def _names(sig: str) -> tuple[tuple[str, ...], ...]:
    """Words of each name in class, id and role, up to one that speaks of layout: no name bears on another."""
    names = ([w for w in re.split(r"[^a-z]+", mark.split("=", 1)[-1]) if w] for mark in sig.split(" ")[1:])
    return tuple(tuple(takewhile(lambda w: w not in LAYOUT_WORDS, words)) for words in names)


def _about(sig: str) -> set[str]:
    """All words in class, id and role that don't speak of layout."""
    return {w for words in _names(sig) for w in words}


def _topic(words: tuple[str, ...]) -> str:
    """What a name is about: its last word that doesn't tell a part of something."""
    return next((w for w in reversed(words) if w not in PART_WORDS), "")


@functools.lru_cache(maxsize=1 << 16)
def _drops(sig: str) -> bool:
    """Whether an element is no article: by its tag, or because some whole name is about furniture."""
    return sig.split(" ", 1)[0] in DROP_TAGS or any((words and words[-1] in DROP_WORDS) or _topic(words) in DROP_WORDS for words in _names(sig))


def _paths(items: list[list], stack: list[str] | None = None) -> Iterator[tuple[list, tuple[str, ...]]]:
    """Text items (also of groups) with the elements around them."""
    stack = [] if stack is None else stack
    for x in items:
        sig = x[SIG]
        if sig == "#":
            yield x, tuple(stack)
        elif x[UNIT] is not None:
            yield from _paths(x[UNIT], list(stack))
        elif sig[0] == "/":
            names = [s.split(" ", 1)[0] for s in stack]
            if sig[1:] in names:
                del stack[len(names) - 1 - names[::-1].index(sig[1:]) :]
        else:
            while stack and stack[-1].split(" ", 1)[0] in OPEN_ENDED and sig.split(" ", 1)[0] not in ("ul", "ol", "table", "dl"):
                stack.pop()
            if sig != "hr":
                stack.append(sig)


def _place(path: tuple[str, ...]) -> tuple[bool, int, bool]:
    """(dropped, region, heading): whether the text is no article, and how telling its region is."""
    region, dropped = 9, False
    for sig in path:
        name = sig.split(" ", 1)[0]
        found = REGION_TAGS.index(name) if name in REGION_TAGS else 2 if "role=main" in sig else 3 if _about(sig) & REGION_WORDS and not _drops(sig) else 9
        if name == "header":
            # In an article, its headline stays.
            dropped |= region == 9 or not re.match("h[1-6]", path[-1])
        dropped |= name != "header" and _drops(sig)
        region = min(region, found)
    return dropped, region, bool(path) and bool(re.match("h[1-6]", path[-1]))


def is_fixed(item: list, pages: int) -> bool:
    """Whether all pages of a host show this one text there."""
    return pages > 0 and item[CONSTANT] is not None and item[PAGES] >= pages


def best_region(items: list[list], pages: int) -> int:
    """The most telling kind of region that holds text of the pages' own."""
    return min((region for x, path in _paths(items) for dropped, region, _ in [_place(path)] if not dropped and x[CHARS] and not is_fixed(x, pages)), default=9)


def is_main(item: list, path: tuple[str, ...], region: int, pages: int) -> bool:
    """Whether a slot belongs to the article, in a host whose articles stand in ``region``.

    Where no element names the article, links and texts that all ``pages`` of the host share are
    none (0: too few different pages to tell).
    """
    dropped, own, heading = _place(path)
    if dropped or own > region:
        return False
    if region < 9:
        return True
    return (heading or not is_fixed(item, pages)) and 2 * item[LINKED] <= item[CHARS]


class Wrapper:
    """A host's wrapper, ready to read pages."""

    def __init__(self, text: str | None, pages: int):
        self.pages = pages
        self.items = json.loads(text) if text else []
        self.region = best_region(self.items, pages)
        self.units = _units(self.items)
        self.known: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self.sigs = [x[SIG] for x in self.items]
        self.flags = self._flags(self.items)

    def _flags(self, items: list[list]) -> list[list[bool]]:
        """For each item, whether its texts are main, in order."""
        main = {id(x): is_main(x, path, self.region, self.pages) for x, path in _paths(items)}

        def of(x: list) -> list[bool]:
            return [main[id(x)]] if x[SIG] == "#" else [f for y in x[UNIT] or () for f in of(y)]

        return [of(x) for x in items]

    def read(self, source: str | None) -> str:
        """The article of a page."""
        stream, texts = page_stream(source)
        items = regroup(fold(stream), self.units)
        sigs = tuple(x[SIG] for x in items)
        if sigs not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[sigs] = matches(self.sigs, list(sigs))
        met = {j: i for i, j in self.known[sigs]}
        own = self._flags(items) if len(met) < len(items) else ()
        keep: list[int] = []

        def places(x: list) -> list[list[int]]:
            return [x[AT]] if x[SIG] == "#" else [p for y in x[UNIT] or () for p in places(y)]

        for j, x in enumerate(items):
            flags = self.flags[met[j]] if j in met else own[j]
            keep += [k for at, flag in zip(places(x), flags, strict=True) if flag for k in at]
        if not keep:  # a page of another kind than its host's: read alone
            main = {k for x, path in _paths(stream) if is_main(x, path, best_region(stream, 0), 0) for k in x[AT]}
            keep = list(main)
        return "\n".join(texts[k] for k in sorted(keep))


def _inferrer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts in a task's pages."""
    found: dict[str, tuple[list[list], int]] = {}
    salt = 0
    for batch in batches:
        for host, source, salt in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "salt")), strict=True):  # noqa: B007
            items = _bare(fold(page_stream(source)[0]))
            old = found.get(host)
            found[host] = (items, 1) if old is None else (align(old[0], items), old[1] + 1)
    for host, (items, pages) in found.items():
        yield _wrapper_row(host, salt, pages, items)


def _wrapper_row(host: str, salt: int, pages: int, items: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([salt], pa.int64()), pa.array([pages], pa.int64()), pa.array([json.dumps(items)], pa.string())], ["host", "salt", "pages", "wrapper"])


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the wrappers of each host and salt, which stand side by side."""
    key, items, pages = None, [], 0
    for batch in batches:
        for host, salt, n, text in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "pages", "wrapper")), strict=True):
            if key == (host, salt):
                items, pages = align(items, json.loads(text)), pages + n
                continue
            if key is not None:
                yield _wrapper_row(*key, pages, items)
            key, items, pages = (host, salt), json.loads(text), n
    if key is not None:
        yield _wrapper_row(*key, pages, items)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper) for each host of ``pages(host, html)``, over all its pages.

    ``pages`` is 0 where a host has no more than two different pages, so that none can tell
    furniture from text. Rounds go on until one task's share holds all of a host's wrappers.
    """
    # A task's number is its salt: the parts of a host are as many as tasks that met it.
    parts = pages.select("host", "html", F.spark_partition_id().cast("long").alias("salt")).mapInArrow(_inferrer, schema(WRAPPERS))
    parts, last = materialise(parts, "wrappers"), False
    while not last:
        last = (parts.agg(F.max("salt")).head()[0] or 0) < FAN
        dealt = parts.withColumn("salt", F.floor(F.col("salt") / FAN)).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
        parts = materialise(dealt.mapInArrow(_merger, schema(WRAPPERS)), "wrappers")
    kinds = pages.groupBy(F.col("host").alias("of"), F.xxhash64("html").alias("kind")).agg(F.lit(1).alias("one")).groupBy("of").agg(F.sum("one").alias("kinds"))
    found = parts.join(kinds, F.col("host") == F.col("of"))
    return materialise(found.select("host", F.when(F.col("kinds") > 2, F.col("pages")).otherwise(F.lit(0)).alias("pages"), "wrapper"), "wrappers")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready: dict[str | None, Wrapper] = {}
    for batch in batches:
        out = []
        for source, n, text in zip(*(batch.column(c).to_pylist() for c in ("html", "pages", "wrapper")), strict=True):
            if text not in ready:
                if len(ready) > 256:
                    ready.clear()
                ready[text] = Wrapper(text, n or 0)
            out.append(ready[text].read(source))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text) of every row of ``pages(page_id, url, html)``.

    ``text``: the blocks of the article, one a line; empty for a null, empty or wordless page.
    Pages without a host share one wrapper. Rows that repeat stay, and copies of a page count as
    one when furniture is told from text; other columns are ignored. A page of any length is
    aligned in near-linear time.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host.alias("host"))
    wrappers = host_wrappers(rows)
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).head()[0]
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(wrappers.select("host", "pages", "wrapper")), "host", "left")
    else:
        salted = wrappers.select("host", "pages", "wrapper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "pages", "wrapper").mapInArrow(_reader, schema("page_id long, url string, text string"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
