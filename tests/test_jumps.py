"""Blocks, bins and segments by jump pointers against plain folds."""

import numpy as np
import pytest

from tessera.operators import genome


def plain_blocks(us, least):
    block, total, out = 0, 0, []
    for u in us:
        if out and total >= least:
            block, total = block + 1, 0
        total += u
        out.append(block)
    return [min(x, block - 1) for x in out] if block and total < least else out


def plain_bins(rows, least, longest):
    at, total, size, out = 0, 0, 0, []
    for u, n in rows:
        if out and (total >= least or size + n >= longest):
            at, total, size = at + 1, 0, 0
        total, size = total + u, size + n
        out.append(at)
    return [min(x, at - 1) for x in out] if at and total < least / 2 and size < longest / 2 else out


def plain_segments(profiles, gap, jump):
    last, segment, out, old = 0, 0, [], None
    for i, row in enumerate(profiles):
        now = [min(x, 1 - x) for x in row]
        if old is not None and i > last + gap and any(abs(x - y) > jump for x, y in zip(now, old, strict=True)):
            last, segment = i, segment + 1
        out.append(segment)
        old = now
    return out


def taken(df, name):
    out = {}
    for r in df.orderBy("chr", "rn").collect():
        out.setdefault(r.chr, []).append(r[name])
    return out


@pytest.mark.parametrize("tile", [4, 1024])
def test_blocks_and_bins(spark, tile):
    rng = np.random.default_rng(5)
    data = {c: [(int(u), int(n)) for u, n in zip(rng.integers(0, 9, size), rng.integers(0, 40, size), strict=True)] for c, size in ((1, 230), (2, 1), (3, 9), (None, 57))}
    data[4] = [(0, 0)] * 20 + [(30, 5)] * 3 + [(0, 200)] * 2
    df = spark.createDataFrame([(c, i, u, n, "x") for c, rows in data.items() for i, (u, n) in enumerate(rows)], "chr int, rn int, u long, len long, block string")
    got = taken(genome.greedy_blocks(df, least=15, tile=tile), "block")
    assert got == {c: plain_blocks([u for u, _ in rows], 15) for c, rows in data.items()}
    got = taken(genome.greedy_bins(df, least=20, longest=100, tile=tile), "bin")
    assert got == {c: plain_bins(rows, 20, 100) for c, rows in data.items()}
    assert genome.greedy_blocks(df.where("rn < 0"), tile=tile).count() == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_profile_segments(spark, tile):
    rng = np.random.default_rng(6)
    data = {c: rng.random((size, 2)).tolist() for c, size in ((1, 90), (2, 1), (3, 5))}
    df = spark.createDataFrame([(c, i, x) for c, rows in data.items() for i, x in enumerate(rows)], "chr int, rn int, bafs array<double>")
    for gap in (0, 3):
        got = taken(genome.profile_segments(df, gap=gap, jump=0.3, keys=("chr",), order="rn", tile=tile), "segment")
        assert got == {c: plain_segments(rows, gap, 0.3) for c, rows in data.items()}
