"""Labelling of linked slices: what grew with tiles, bins or features beyond its share."""


def test_a_sweep_ends_when_no_later_tile_sees_a_change(spark):
    """A round more once followed every change, though links within tiles were settled; on chains across tiles rounds go on."""
    from tessera.operators import sweep

    n = 40
    rows = [(i, [0.0, 1.5 if i % 10 == 4 else 0.1]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, score array<double>")
    near = [(i, i + 1, 0.5) for i in range(n - 1) if i % 10 != 9]
    zero = spark.createDataFrame([(i, 0) for i in range(n)], "node long, label int")

    def run(links):
        edges = spark.createDataFrame([e for a, b, w in links for e in ((a, b, w), (b, a, w))], "src long, dst long, weight double")
        field = sweep.Field(nodes, edges, tile=10)
        assert field.nodes.select("tile").distinct().count() == 4
        state, edits = field.sweep(field.start(zero))
        found = [0] * n
        for i in range(n):
            cost = list(rows[i][1])
            for a, b, w in links:
                if i in (a, b):
                    cost[found[a + b - i]] += w
            found[i] = int(cost[1] > cost[0])
        assert [r.now for r in state.orderBy("node").collect()] == found and edits == sum(found) > 0
        return field.rounds

    # Nodes 4, 14 … turn first, then those after them, to the end of their tile; links to the next tile hang on nodes that stay.
    assert run([*near, (0, 10, 0.2), (10, 20, 0.2), (20, 30, 0.2)]) == 1
    assert run([*near, (9, 10, 0.5), (19, 20, 0.5), (29, 30, 0.5)]) > 1


def test_few_bins_are_broadcast_to_spots(spark):
    """A join shuffled by bin once had no more tasks than there are bins, however many the spots."""
    from pyspark.sql import functions as F

    from tessera.operators import hmrf as R
    from tessera.operators.hmm import States

    i = F.col("id")
    counts = spark.range(200).select(F.floor(i / 4).alias("spot"), (i % 4).alias("bin"), (i % 7).alias("umi"), (4.0 + i % 3).alias("base"), (i % 4).alias("k"), F.lit(4).cast("long").alias("depth"))
    edges = spark.range(50).select(i.alias("src"), i.alias("dst"))
    paths = spark.range(8).select((i % 2).alias("clone"), F.floor(i / 2).alias("bin"), (i % 2).cast("int").alias("state"))
    states = R.states_table(spark, States(p=(0.5, 0.3), tau=(30.0,) * 2, log_mu=(0.0, 0.3), alpha=(0.1,) * 2))

    def found(limit):
        before, R.BROADCAST_BINS = R.BROADCAST_BINS, limit
        try:
            df = R.spot_llf(counts, edges, paths, states)
        finally:
            R.BROADCAST_BINS = before
        return df._jdf.queryExecution().executedPlan().toString(), {(r.spot, r.clone): r.llf for r in df.collect()}

    (plan, few), (_, many) = found(R.BROADCAST_BINS), found(0)
    assert "hashpartitioning(bin" not in plan and "BroadcastHashJoin" in plan
    assert len(few) == 100 and few.keys() == many.keys() and all(abs(v - many[k]) < 1e-9 for k, v in few.items())


def test_features_of_dealt_lines_are_not_broadcast(spark, small, monkeypatch):
    """Features were broadcast by the size of their file, through the driver, though lines lie by feature already."""
    from tessera import catalogue as Q
    from tessera.plans import bindings as B

    plain = sorted(map(tuple, Q._reads(spark, small).collect()))
    monkeypatch.setattr(B, "TASK_ROWS", 200)
    dealt = Q._reads(spark, small)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "Sort" not in plan
    assert sorted(map(tuple, dealt.collect())) == plain
