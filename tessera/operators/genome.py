"""Ordered and interval operators along the genome.

Order carries meaning: rows bring (chr, start) and a tie-break, and windows are dealt out by the
keys the caller names (chromosome, and sample or clone where there are such), never by nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_site_transition, phase_switch_probability
from .storage import keep


def ordinal(df: DataFrame, keys: Sequence[str] = ("chr",), tie: Sequence[str] = ("feature",)) -> DataFrame:
    """Adds ``rn``: the place by start, intervals before points, then ``tie``."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("start", F.desc("is_interval"), *tie)))


def merge_intervals(df: DataFrame, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """(keys, island, start, end, n) of strictly overlapping intervals; empty intervals don't count."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flagged = df.where(F.col("end") > F.col("start")).withColumn("_new", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    numbered = flagged.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


#: Widths of bins, each eight of the level below; the last level is one bin.
WIDTHS = tuple(1024 * 8**i for i in range(8))


def _bin(pos: Column, level: Column | int) -> Column:
    """Number of the bin around a position on a level."""
    if isinstance(level, int):
        return F.floor(pos / WIDTHS[level]).cast("long") if level < len(WIDTHS) else F.lit(0).cast("long")
    out = F.lit(0).cast("long")
    for i, w in enumerate(WIDTHS):
        out = F.when(level == i, F.floor(pos / w).cast("long")).otherwise(out)
    return out


def interval_level(start: Column, end: Column) -> Column:
    """The lowest level on which [start, end) lies in one bin."""
    out = F.lit(len(WIDTHS))
    for i in reversed(range(len(WIDTHS))):
        out = F.when(_bin(start, i) == _bin(end - 1, i), F.lit(i)).otherwise(out)
    return out


def _binned(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """``df`` with the level and bin of each interval: one row each, however long."""
    return df.withColumn("_level", interval_level(start, end)).withColumn("_bin", _bin(start, F.col("_level")))


def _asking(df: DataFrame, pos: Column, least: Column) -> DataFrame:
    """``df`` with a row for each level from ``least`` up and the bin around ``pos`` there: at most nine rows."""
    levels = F.array(*(F.struct(F.lit(i).alias("l"), _bin(pos, i).alias("b")) for i in range(len(WIDTHS) + 1)))
    asked = df.withColumn("_ask", F.explode(levels)).where(F.col("_ask.l") >= least)  # a filter of the array would be interpreted row by row
    return asked.select("*", F.col("_ask.l").alias("_level"), F.col("_ask.b").alias("_bin")).drop("_ask")


def _met(asking: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides in one bin. Both are shuffled: an estimate of a side from its compressed file would broadcast millions of rows."""
    return asking.join(held.hint("merge"), list(keys))


def range_anti(points: DataFrame, ranges: DataFrame, pos: str = "start") -> DataFrame:
    """Points in no ``start <= pos < end`` range of their chromosome.

    A range stands in one bin of the level that holds it, a position asks one bin a level: an
    equi-join of few rows each, however long ranges are.
    """
    held = _binned(ranges.where(F.col("end") > F.col("start")), F.col("start"), F.col("end")).select(F.col("chr").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), "_level", "_bin")
    at = points.select(F.col("chr").alias("_c"), F.col(pos).alias("_p")).where("_c is not null and _p is not null").distinct()
    met = _met(_asking(at, F.col("_p"), F.lit(0)), held, ["_c", "_level", "_bin"]).where((F.col("_p") >= F.col("_s")) & (F.col("_p") < F.col("_e"))).select("_c", "_p").distinct()
    return points.join(met, (F.col("chr") == F.col("_c")) & (F.col(pos) == F.col("_p")), "left_anti")


def point_join(points: DataFrame, ranges: DataFrame, pos: str = "start") -> DataFrame:
    """Points (chr, ``pos``, …) with the other columns of every ``start <= pos < end`` range of their chromosome, met in bins as in ``range_anti``."""
    held = ranges.where(F.col("end") > F.col("start")).withColumnsRenamed({"start": "_s", "end": "_e"})
    met = _met(_asking(points, F.col(pos), F.lit(0)), _binned(held, F.col("_s"), F.col("_e")), ["chr", "_level", "_bin"])
    return met.where((F.col(pos) >= F.col("_s")) & (F.col(pos) < F.col("_e"))).drop("_level", "_bin", "_s", "_e")


def look_back(df: DataFrame, depth: int = 50, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """(…point columns, gene) of points inside the nearest of the ``depth`` rows before that is an interval around them.

    Rows come with ``rn``; points in no such interval go.
    """
    back = Window.partitionBy(*keys).orderBy("rn").rowsBetween(-depth, -1)
    gene = F.when(F.col("is_interval"), F.struct("start", "end", F.col("feature").alias("gene")))
    near = df.withColumn("_near", F.collect_list(gene).over(back)).where(~F.col("is_interval"))
    holds = F.filter("_near", lambda g: (g["start"] <= F.col("start")) & (F.col("start") < g["end"]))
    return near.withColumn("gene", F.try_element_at(holds, F.lit(-1))["gene"]).drop("_near").where("gene is not null")


def overlap_join(rows: DataFrame, islands: DataFrame) -> DataFrame:
    """Rows with every island of their chromosome that they overlap (``max(start) < min(end)``), once each.

    Of two intervals that overlap, the one on the lower level lies in the other's bin: it asks the
    bins above it, and either side may be the lower one.
    """
    a = rows.where(F.col("end") > F.col("start"))
    b = islands.where(F.col("end") > F.col("start")).select("chr", "island", F.col("start").alias("_s"), F.col("end").alias("_e"))
    own, other = _binned(a, F.col("start"), F.col("end")), _binned(b, F.col("_s"), F.col("_e"))
    keys = ["chr", "_level", "_bin"]
    up = _met(_asking(a.withColumn("_own", interval_level(F.col("start"), F.col("end"))), F.col("start"), F.col("_own")).drop("_own"), other, keys)
    down = _met(_asking(b.withColumn("_own", interval_level(F.col("_s"), F.col("_e")) + 1), F.col("_s"), F.col("_own")).drop("_own"), own, keys)
    met = up.unionByName(down).where(F.greatest("start", "_s") < F.least("end", "_e"))
    return met.drop("_level", "_bin", "_s", "_e")


#: Rows of a tile, inside which jumps are followed in arrays.
TILE = 1024
#: A place past all rows.
BEYOND = 1 << 62


def _placed(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(_row, keys, _pos): all columns as one, and the place of the row from 1."""
    return df.select(F.struct("*").alias("_row"), *keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long").alias("_pos"))


def _ahead(keys: Sequence[str]):
    """All rows up to this one."""
    return Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)


def _reaching(df: DataFrame, name: str, reached: str, wanted: Column, keys: Sequence[str]) -> DataFrame:
    """Adds ``name``: the first place whose ``reached``, which never falls, is at least ``wanted``; null where none is.

    Each row stands twice in one order of values, as what is reached and as what is wanted; the
    place seen last on the way down is the answer, so a search is one sort and one pass.
    """
    both = df.withColumn("_asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_value", F.when(F.col("_asks"), wanted).otherwise(F.col(reached)))
    down = Window.partitionBy(*keys).orderBy(F.desc("_value"), "_asks", F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(F.when(~F.col("_asks"), F.col("_pos")), ignorenulls=True).over(down)).where("_asks").drop("_asks", "_value")


def _aside(keys: Sequence[str]) -> tuple[list[Column], Column]:
    """The keys under other names, and whether a row's keys equal these, nulls included."""
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))


def _entries(tiles: DataFrame, keys: Sequence[str], last: int, tile: int) -> DataFrame:
    """(keys, _tile, _entry): the place at which the way from each key's first row enters a tile.

    Only places that some tile's jumps lead to are followed, and each round doubles the tiles that
    a jump spans.
    """
    exits = keep(tiles.select(*keys, F.col("_low"), F.posexplode("_exit").alias("_i", "_next")).select(*keys, (F.col("_low") + F.col("_i")).alias("_at"), "_next"))
    other, same = _aside(keys)
    met = exits.select(*other, F.col("_next").alias("_met")).distinct()
    first = exits.where("_at = 1")
    jumps = keep(exits.join(met, same & (F.col("_at") == F.col("_met")), "left_semi").where("_at > 1").unionByName(first))
    found = first.select(*keys, "_at")
    for _ in range(last.bit_length()):
        to = jumps.select(*other, F.col("_at").alias("_from"), F.col("_next").alias("_then"))
        step = found.join(to, same & (F.col("_at") == F.col("_from"))).where(F.col("_then") < BEYOND).select(*keys, F.col("_then").alias("_at"))
        found = keep(found.unionByName(step))
        jumps = keep(jumps.join(to, same & (F.col("_next") == F.col("_from")), "left").select(*keys, "_at", F.coalesce("_then", "_next").alias("_next")))
    return found.select(*keys, F.floor((F.col("_at") - 1) / tile).alias("_tile"), F.col("_at").alias("_entry"))


def _opened(df: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """(keys, _row, _pos, _opens) of ``df(keys, _row, _pos, _to)``: whether a row is met on the way from its key's first row.

    ``_to`` is the place a row's jump leads to, past its own; null, or past the last row, leads nowhere. Jumps are composed
    with themselves, inside tiles of rows, where arrays hold them, and then from tile to tile, so
    that no step walks row by row and the number of rounds is the logarithm of the rows'.
    """
    depth = (tile - 1).bit_length()
    ends = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("_jump", F.when(F.col("_to") <= ends, F.col("_to")).otherwise(F.lit(BEYOND)))
    held = F.collect_list(F.struct("_pos", "_jump", "_row"))
    tiles = df.withColumn("_tile", F.floor((F.col("_pos") - 1) / tile)).groupBy(*keys, "_tile").agg(held.alias("_rows"))
    tiles = tiles.withColumn("_rows", F.array_sort("_rows", lambda x, y: (x["_pos"] - y["_pos"]).cast("int")))
    tiles = keep(tiles.withColumn("_low", F.col("_tile") * tile + 1).withColumn("_jumps", F.transform("_rows", lambda x: x["_jump"])))
    high = F.col("_low") + F.size("_rows")

    def step(jumps: Column) -> Callable[[Column], Column]:
        """Where jumps lead; places outside the tile stay."""
        return lambda at: F.when(at >= high, at).otherwise(F.get(jumps, (at - F.col("_low")).cast("int")))

    # Arrays are bound by folds and lambdas, so that no plan evaluates them anew for each element.
    doublings = F.sequence(F.lit(1), F.lit(depth))
    last = tiles.agg(F.max("_tile")).first()[0]
    if last:
        into = _entries(tiles.withColumn("_exit", F.aggregate(doublings, F.col("_jumps"), lambda j, _: F.transform(j, step(j)))), keys, last, tile)
        other, same = _aside(keys)
        into = into.select(*other, F.col("_tile").alias("_at_tile"), "_entry")
        tiles = tiles.join(into, same & (F.col("_tile") == F.col("_at_tile")), "left")
    else:
        tiles = tiles.withColumn("_entry", F.lit(1).cast("long"))

    def lengthen(state: Column, _: Column) -> Column:
        way = F.concat(state["way"], F.filter(F.transform(state["way"], step(state["jumps"])), lambda x: x < high))
        return F.struct(F.transform(state["jumps"], step(state["jumps"])).alias("jumps"), way.alias("way"))

    start = F.struct(F.col("_jumps").alias("jumps"), F.filter(F.array("_entry"), lambda x: x.isNotNull()).alias("way"))
    way = F.aggregate(doublings, start, lengthen, lambda state: state["way"])
    rows = F.transform(F.array(way), lambda w: F.transform("_rows", lambda x: F.struct(x["_pos"].alias("_pos"), x["_row"].alias("_row"), F.array_contains(w, x["_pos"]).alias("_opens"))))
    return tiles.select(*keys, F.explode(F.get(rows, 0)).alias("_x")).select(*keys, "_x.*")


def _numbered(opened: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: openings up to the row, from 0."""
    return opened.withColumn(name, F.sum(F.col("_opens").cast("long")).over(_ahead(keys)) - 1)


def _tail_joined(df: DataFrame, keys: Sequence[str], name: str, short: Column) -> DataFrame:
    """Gives rows of each key's last number, where ``short``, the number before."""
    last = F.max(name).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when((F.col(name) > 0) & (F.col(name) == last) & short, F.col(name) - 1).otherwise(F.col(name)))


def _with(df: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The columns of ``df`` from ``rows(_row, name)``, with ``name``."""
    return rows.select(*(F.col("_row")[c].alias(c) for c in df.columns if c != name), name)


def greedy_blocks(df: DataFrame, value: str = "u", least: int = 15, keys: Sequence[str] = ("chr",), order: str = "rn", tile: int = TILE) -> DataFrame:
    """Adds ``block``: a new one opens where the current one has ``least``; a short last one joins its neighbour.

    ``value`` is never negative; null counts as 0. From the running sum each row knows where a block
    that opened there would end; following these jumps from the first row tells the real openings.
    """
    u = F.coalesce(F.col("_row")[value], F.lit(0))
    rows = _placed(df, keys, order).withColumn("_sum", F.sum(u).over(_ahead(keys)))
    rows = _reaching(rows, "_full", "_sum", F.col("_sum") - u + least, keys).withColumn("_to", F.col("_full") + 1)
    out = _numbered(_opened(rows, keys, tile), keys, "block")
    return _with(df, _tail_joined(out, keys, "block", F.sum(u).over(Window.partitionBy(*keys, "block")) < least), "block")


def greedy_bins(df: DataFrame, value: str = "u", length: str = "len", least: int = 300, longest: int = 5_000_000, keys: Sequence[str] = ("chr",), order: str = "rn", tile: int = TILE) -> DataFrame:
    """Adds ``bin``: a new one opens at ``least`` counts or where the length would reach ``longest``.

    A last bin under half of both joins its neighbour. Counts and lengths are never negative; null
    counts as 0. Openings are found as in :func:`greedy_blocks`, by the nearer of the two bounds.
    """
    u, n = (F.coalesce(F.col("_row")[c], F.lit(0)) for c in (value, length))
    rows = _placed(df, keys, order).withColumn("_sum", F.sum(u).over(_ahead(keys))).withColumn("_size", F.sum(n).over(_ahead(keys)))
    rows = _reaching(rows, "_full", "_sum", F.col("_sum") - u + least, keys)
    rows = _reaching(rows, "_long", "_size", F.col("_size") - n + longest, keys)
    long_ = F.when(F.col("_long").isNotNull(), F.greatest(F.col("_long"), F.col("_pos") + 1))
    out = _numbered(_opened(rows.withColumn("_to", F.least(F.col("_full") + 1, long_)), keys, tile), keys, "bin")
    whole = Window.partitionBy(*keys, "bin")
    return _with(df, _tail_joined(out, keys, "bin", (F.sum(u).over(whole) < least / 2) & (F.sum(n).over(whole) < longest / 2)), "bin")


def break_points(df: DataFrame, length: str = "len", longest: int = 5_000_000, keys: Sequence[str] = ("chr",), order: str = "rn") -> DataFrame:
    """Adds ``segment``: rows longer than ``longest`` stand alone, what is between them is a segment."""
    w = Window.partitionBy(*keys).orderBy(order)
    long_ = (F.col(length) > longest).cast("int")
    cut = ((long_ == 1) | (F.coalesce(F.lag(long_).over(w), F.lit(0)) == 1)).cast("int")
    return df.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def profile_segments(df: DataFrame, profile: str = "bafs", gap: int = 10, jump: float = 0.1, keys: Sequence[str] = ("chain",), order: str = "t", tile: int = TILE) -> DataFrame:
    """Adds ``segment``: cut where any mirrored share jumps by ``jump``, over ``gap`` rows after the last cut.

    Whether a row may be a cut doesn't depend on others, so each row knows the next cut after one
    there; the real cuts are found as the openings of :func:`greedy_blocks`.
    """
    rows = _placed(df, keys, order)
    by_place = Window.partitionBy(*keys).orderBy("_pos")
    now = F.transform(F.col("_row")[profile], lambda x: F.least(x, 1 - x))
    rows = rows.withColumn("_now", now).withColumn("_old", F.lag("_now").over(by_place))
    apart = F.zip_with("_now", "_old", lambda x, y: F.abs(x - y))
    may = F.coalesce(F.exists(apart, lambda x: (x > jump) & ~F.isnan(x)), F.lit(False))
    down = Window.partitionBy(*keys).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_may", may).withColumn("_near", F.min(F.when(F.col("_may"), F.col("_pos"))).over(down)).withColumn("_to", F.lead("_near", gap + 1).over(by_place))
    return _with(df, _numbered(_opened(rows, keys, tile), keys, "segment"), "segment")


def run_length(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, run, value, first, last): stretches of one value."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"))


def forward_fill(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """``value`` with gaps (null or NaN) filled from the last row that has one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(F.when(~F.isnan(value), F.col(value)), ignorenulls=True).over(w))


def centimorgans(points: DataFrame, gmap: DataFrame) -> DataFrame:
    """Adds ``cm`` to ``points(chr, pos, …)``: interpolated in ``gmap(chr, pos, cm)``.

    Before a chromosome's first map row it is scaled from 0, after its last one it stays; a
    chromosome that the map lacks gets null. Map rows at one position count as the last of them.
    """
    at = gmap.groupBy("chr", "pos").agg(F.max("cm").alias("cm"))
    both = points.select("*", F.lit(None).cast("long").alias("_p"), F.lit(None).cast("double").alias("_m")).unionByName(at.select("chr", "pos", F.col("pos").alias("_p"), F.col("cm").alias("_m")), allowMissingColumns=True)
    marked = both.withColumn("_map", F.col("_p").isNotNull())
    order = Window.partitionBy("chr").orderBy("pos", F.desc("_map"))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    # The next map row is the last one seen on the way down from the end: a frame that grows is one pass.
    up = Window.partitionBy("chr").orderBy(F.desc("pos"), F.desc("_map")).rowsBetween(Window.unboundedPreceding, 0)
    p0, m0 = (F.last(c, ignorenulls=True).over(down) for c in ("_p", "_m"))
    p1, m1 = (F.last(c, ignorenulls=True).over(up) for c in ("_p", "_m"))
    seen = marked.select("*", p0.alias("_p0"), m0.alias("_m0"), p1.alias("_p1"), m1.alias("_m1")).where(~F.col("_map"))
    inside = F.when(F.col("_p0") == F.col("_p1"), F.col("_m0")).otherwise(F.col("_m0") + (F.col("_m1") - F.col("_m0")) * (F.col("pos") - F.col("_p0")) / F.nullif(F.col("_p1") - F.col("_p0"), F.lit(0)))
    first = F.when(F.col("_p1") == 0, F.col("_m1")).otherwise(F.col("_m1") * F.col("pos") / F.nullif(F.col("_p1"), F.lit(0)))
    cm = F.when(F.col("_p0").isNull(), first).when(F.col("_p1").isNull(), F.col("_m0")).otherwise(inside)
    return seen.withColumn("cm", cm).drop("_p", "_m", "_map", "_p0", "_m0", "_p1", "_m1")


def site_transitions(blocks: DataFrame, nu: float = 1.0, shift: float = -2.0, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """Adds ``p_switch`` and ``log_switch`` from the end of a block to the start of the next (``rn``, ``cm_first``, ``cm_last``)."""
    gap = F.lead("cm_first").over(Window.partitionBy(*keys).orderBy("rn")) - F.col("cm_last")
    return blocks.withColumn("p_switch", phase_switch_probability(gap, nu)).withColumn("log_switch", log_site_transition(F.col("p_switch"), shift))
