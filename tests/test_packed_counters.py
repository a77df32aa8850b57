"""Counters as bits: the same registers as by dictionaries for any number of them, in few rows an edge."""

import random

import pytest

from meshframe.operators import sketch
from test_graph_loops import plain_counters


@pytest.mark.parametrize("rsd", [0.4, 0.15, 0.1, 0.03])
def test_bits_hold_the_registers(spark, rsd):
    p, n, r = sketch.Parameters(rsd), 40, random.Random(3)
    edges = sorted({(r.randrange(n - 2), r.randrange(n)) for _ in range(120)})
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    plain = plain_counters(spark, n, edges, p, 2)
    size = min(sketch.PART, p.m)

    def registers(state):
        return {(x["id"], x["part"] * size + k): x[f"r{k}"] for x in state.collect() for k in range(size) if x[f"r{k}"]}

    found = sketch.balls(spark.range(n), frame, p, 2)
    assert registers(found.state) == {(i, k): v for i, x in plain[2].items() for k, v in x.items() if v}
    grown = [{(i, k // size) for i, x in new.items() for k, v in x.items() if v > old[i].get(k, 0)} for old, new in zip([{i: {} for i in range(n)}, plain[0]], plain[:2], strict=True)]
    out = {i: sum(a == i for a, _ in edges) for i in range(n)}
    assert found.rounds == [(sum(out[i] > 0 for i, _ in x), sum(out[i] for i, _ in x)) for x in grown]
    ranks = spark.createDataFrame([(i, k, v) for i, x in plain[2].items() for k, v in x.items()], "id bigint, reg int, rank int")
    of = lambda df: {x["id"]: x["estimate"] for x in df.collect()}
    assert of(sketch.packed_estimate(found.packed, p)) == of(sketch.estimate(ranks, p))


def test_a_counter_goes_along_an_edge_in_few_rows(spark):
    p, n, r = sketch.Parameters(0.1), 300, random.Random(4)
    frame = spark.createDataFrame([(r.randrange(n), r.randrange(n)) for _ in range(20 * n)], "src bigint, dst bigint")
    found = sketch.balls(spark.range(n), frame, p, 1)
    assert found.packed.count() < 2.5 * n < 7 * n < found.state.where(" + ".join(f"r{i}" for i in range(sketch.PART)) + " > 0").count()
