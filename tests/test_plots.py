"""Tables of plots on small cases."""

from tessera.operators import plots


def test_map_of_slices_and_colours(spark):
    spots = spark.createDataFrame([(1, 0, 3.0, 2.0, None), (2, 0, 5.0, 1.0, float("nan")), (3, 1, 0.0, 4.0, 1.0), (4, 2, 1.0, 0.0, 0.0), (5, 2, 1.0, 1.0, 0.5)], "spot long, sample int, x double, y double, tumour double")
    labels = spark.createDataFrame([(1, 0), (2, 10), (3, 2), (4, 2), (5, None)], "spot long, label int")
    got = {r.spot: r for r in plots.spot_map(spots, labels).collect()}
    assert set(got) == {1, 2, 3, 4}  # a spot without a label isn't drawn
    assert [(got[s].px, got[s].py) for s in (1, 2, 3, 4)] == [(3.0, -2.0), (5.0, -1.0), (15.0, -4.0), (26.0, 0.0)]
    assert [got[s].legend for s in (1, 2, 3)] == [0, 1, 2]  # 10 before 2
    assert (got[1].colour, got[3].colour, got[4].colour) == ("#d3d3d3", "#fc8d62", "#d3d3d3") and got[2].shade == 0.5
    plain = {r.spot: r.colour for r in plots.spot_map(spots.drop("tumour"), labels.where("label > 0")).collect()}
    assert plain == {2: "#66c2a5", 3: "#fc8d62", 4: "#fc8d62"}


def test_tracks_leave_out_empty_clones(spark):
    bulk = spark.createDataFrame([(0, 1, 7, 4, 2.0, 1, 2), (0, 2, 3, 4, 0.0, 0, 0), (1, 1, 7, 9, 1.0, 0, 0)], "clone int, chr int, bin long, umi long, base double, k long, depth long")
    places = plots.bin_places(bulk.select("chr", "bin").distinct())
    assert sorted((r.chr, r.bin, r.place) for r in places.collect()) == [(1, 7, 0), (2, 3, 1)]
    segments = spark.createDataFrame([(0, 7, 1, 1, 2)], "clone int, bin long, state int, a int, b int")
    rows = {r.bin: r for r in plots.clone_tracks(bulk, places, segments).collect()}
    assert set(rows) == {7, 3} and (rows[7].rdr, rows[7].baf, rows[7].major, rows[7].minor, rows[7].colour) == (2.0, 0.5, 2, 1, "lightgoldenrodyellow")
    assert rows[3].rdr is None and rows[3].baf is None and rows[3].colour is None
    assert plots.spot_map(spark.createDataFrame([], "spot long, sample int, x double, y double"), spark.createDataFrame([], "spot long, label int")).count() == 0


def test_lines_cross_chromosomes(spark):
    places = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 2), (2, 21, 3)], "chr int, bin long, place long")
    paths = spark.createDataFrame([(0, 10, 0), (0, 11, 1), (0, 20, 1), (0, 21, 0)], "clone int, bin long, state int")
    states = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.0, 0.2)], "state int, log_mu double, p double")
    got = sorted(tuple(r) for r in plots.clone_lines(paths, places, states).select("first", "end", "state", "mirrored").collect())
    assert got == [(0, 1, 0, 0.5), (1, 3, 1, 0.8), (3, 4, 0, 0.5)]
