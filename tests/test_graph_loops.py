"""Grids of edges, loops over active sets, and sketches that are sent only where they grew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import edgegrid, graph, sketch


def power_law(n_edges=20_000, n=3000, hub_share=0.8):
    """Edges of which a hub has a share, to targets with a popular one among them."""
    r = np.random.default_rng(7)
    hub = int(n_edges * hub_share)
    src = np.concatenate([np.zeros(hub, int), r.zipf(1.6, n_edges - hub) % n])
    dst = np.concatenate([np.arange(hub) % 1_000_000, r.integers(0, n, n_edges - hub)])
    dst[hub : hub + 1500] = 5
    return [(int(a), int(b)) for a, b in zip(src, dst, strict=True)]


def test_no_block_is_twice_the_middle_one(spark):
    edges = spark.createDataFrame(power_law(), "src bigint, dst bigint")
    g = edgegrid.grid(edges, 32)
    sizes = [r["edges"] for r in edgegrid.block_table(g).collect()]
    assert len(sizes) == 32 and max(sizes) <= 2 * np.median(sizes)
    assert sum(sizes) == edges.distinct().count() and g.edges.agg(F.sum("n")).first()[0] == 20_000
    assert g.edges.where("src = 0").select("block").distinct().count() > 20
    cells = np.zeros((edgegrid.CELLS, edgegrid.CELLS), int)
    for s0, s1, t0, t1 in g.ranges:
        cells[s0:s1, t0:t1] += 1
    assert (cells == 1).all()  # rectangles that cover the plane once
    inside = g.edges.select("block", edgegrid.place("src").alias("s"), edgegrid.place("dst").alias("t")).collect()
    assert all(g.ranges[r["block"]][0] <= r["s"] < g.ranges[r["block"]][1] and g.ranges[r["block"]][2] <= r["t"] < g.ranges[r["block"]][3] for r in inside)
    g.drop()


def test_the_grid_is_not_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame(power_law(), "src bigint, dst bigint")
        g = edgegrid.grid(edges, 32)
        values = edges.select(F.col("src").alias("id")).distinct().withColumn("x", F.lit(1.0))
        found = edgegrid.propagate(g, values, F.col("x") * F.col("n"), F.sum)
        wanted = {r["dst"]: float(r["count"]) for r in edges.groupBy("dst").count().collect()}
        assert {r["id"]: r["message"] for r in found.collect()} == wanted
        plan = found._jdf.queryExecution().optimizedPlan().toString() and found._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        name = g.edges._scratch_table
        at = final.splitlines().index(next(x for x in final.splitlines() if f"{name}[" in x or f".{name}" in x))
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        above, low = [], depth(final.splitlines()[at])
        for line in reversed(final.splitlines()[:at]):
            if depth(line) < low:
                low = depth(line)
                above.append(line.strip(" :+-*()0123456789"))
        joined = next(i for i, x in enumerate(above) if x.startswith("SortMergeJoin"))
        assert not any("Exchange" in x for x in above[:joined])
        g.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_planes_that_cannot_be_halved():
    one = np.zeros((4, 4), int)
    one[2, 3] = 9
    assert len(edgegrid.cut_plane(one, 100)) <= 16 and edgegrid.cut_plane(one, 1) == [(0, 4, 0, 4)]
    assert len(edgegrid.cut_plane(np.zeros((2, 2), int), 3)) == 3


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_pagerank_over_any_grid(spark, blocks):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 50) for i in range(40) for j in range(4)] + [(3, 4), (3, 4)], "src bigint, dst bigint")
    value = lambda df: {r["id"]: r["rank"] for r in df.collect()}
    wanted = value(graph.pagerank_delta(spark.range(50), edges, 4, "normalized"))
    assert value(edgegrid.pagerank(spark.range(50), edges, 4, blocks)) == pytest.approx(wanted)
    assert value(edgegrid.pagerank(spark.range(3), edges.where("false"), 2)) == pytest.approx({0: 0.15, 1: 0.15, 2: 0.15})


def test_frontier_meets_the_dense_loop(spark):
    edges = [(i, (i * 7 + j * j) % 60) for i in range(60) for j in range(1 + i % 5)] + [(60, 1), (60, 1)]
    n, bound = 63, 1e-4
    ranks = np.full(n, 0.15)
    out = np.bincount([a for a, _ in edges], minlength=n)
    for _ in range(200):
        new = np.full(n, 0.15)
        for a, b in edges:
            new[b] += 0.85 * ranks[a] / out[a]
        ranks = new
    found = graph.pagerank_frontier(spark.range(n), spark.createDataFrame(edges, "src bigint, dst bigint"), bound)
    got = {r["id"]: r["rank"] for r in found.state.collect()}
    assert len(got) == n and sum(abs(got[i] - ranks[i]) for i in range(n)) <= bound / 0.15 * n
    assert all(ranks[i] - got[i] >= -1e-9 for i in range(n))
    messages = [m for _, m in found.rounds]
    assert messages[0] == len(edges) and messages[-1] < messages[0] / 4 and len(messages) < 100
    assert found.state.where(f"pending > {bound} and degree > 0").count() == 0


def test_frontier_without_edges(spark):
    found = graph.pagerank_frontier(spark.range(3), spark.createDataFrame([], "src bigint, dst bigint"))
    none = graph.pagerank_frontier(spark.range(0), spark.createDataFrame([], "src bigint, dst bigint"))
    assert none.rounds == [] and none.state.collect() == [] and found.rounds == [] and [r["rank"] for r in found.state.collect()] == [0.15] * 3


def plain_counters(spark, n, edges, p, rounds):
    """Registers of each vertex after every round, by dictionaries."""
    state = {i: {} for i in range(n)}
    for r in sketch.counters(spark.range(n), p).collect():
        state[r["id"]][r["reg"]] = r["rank"]
    out = [state]
    for _ in range(rounds):
        new = {i: dict(x) for i, x in out[-1].items()}
        for a, b in edges:
            for reg, rank in out[-1][a].items():
                new[b][reg] = max(new[b].get(reg, 0), rank)
        out.append(new)
    return out


@pytest.mark.parametrize("rsd", [0.4, 0.1])
def test_only_what_grew_is_sent(spark, rsd):
    p, n = sketch.Parameters(rsd), 30
    edges = [(i, i + 1) for i in range(n - 1)] + [(5, 2), (5, 2), (9, 9)]
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    plain = plain_counters(spark, n, edges, p, 40)
    found = sketch.balls(spark.range(n), frame, p)
    got = {i: {} for i in range(n)}
    size = min(sketch.PART, p.m)
    for r in found.state.collect():
        got[r["id"]] |= {r["part"] * size + k: r[f"r{k}"] for k in range(size) if r[f"r{k}"]}
    assert got == {i: {k: v for k, v in x.items() if v} for i, x in plain[-1].items()}
    assert found.rounds[0] == (n - 1, len(set(edges))) and found.rounds[-1][1] < found.rounds[0][1]
    wanted = next(k for k in range(40) if plain[k] == plain[-1])
    assert len(found.rounds) <= wanted + 1
    assert sketch.hyperanf(spark.range(0), frame.where("false"), None, rsd).collect() == []
    exact = {r["id"]: r["estimate"] for r in sketch.hyperanf(spark.range(n), frame, None, rsd).collect()}
    some = {r["id"]: r["estimate"] for r in sketch.hyperanf(spark.range(n), frame, 2, rsd).collect()}
    assert set(exact) == set(range(n)) and exact[n - 1] > some[n - 1] and exact[0] == some[0]
