"""Oversampled seeds: the same on any deal, and no worse than the first points."""

import numpy as np
import pytest

from meshframe.operators import cluster

NUMBERS, CATEGORIES, WEIGHT = ["a", "b"], ["c"], 2.0


def points(spark, n=400):
    r = np.random.default_rng(5)
    rows = [(i, float(40 * (i % 5) + r.normal()), float(r.normal()), "xyz"[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string")


def cost(rows, centres):
    far = lambda p, c: (p["a"] - c["a"]) ** 2 + (p["b"] - c["b"]) ** 2 + WEIGHT * (p["c"] != c["c"])
    return sum(min(far(p, c) for c in centres) for p in rows)


def test_any_deal_gives_the_same_seeds(spark):
    df = points(spark)
    one = cluster.oversampled_seeds(df.coalesce(1), 5, NUMBERS, CATEGORIES, WEIGHT)
    assert one == cluster.oversampled_seeds(df.repartition(7, "b"), 5, NUMBERS, CATEGORIES, WEIGHT) and len(one) == 5
    rows = [r.asDict() for r in df.collect()]
    first = rows[:1] + [r for r in rows if r["id"] in (5, 10, 15, 20)]  # all of one cluster
    assert cost(rows, one) < cost(rows, first) / 20 and {round(c["a"] / 40) for c in one} == set(range(5))


def test_candidates_by_brute_force(spark):
    df = points(spark, 60)
    got = cluster.candidates(df, NUMBERS, CATEGORIES, WEIGHT, 6.0, 3)
    rows = [r.asDict() for r in df.collect()]
    assert len({c["id"] for c in got}) == len(got) and sum(c["weight"] for c in got) == 60
    far = lambda p, c: (p["a"] - c["a"]) ** 2 + (p["b"] - c["b"]) ** 2 + WEIGHT * (p["c"] != c["c"])
    near = [min(range(len(got)), key=lambda n: (far(p, got[n]), n)) for p in rows]
    assert [c["weight"] for c in got] == [near.count(n) for n in range(len(got))]
    assert [c["round"] for c in got] == sorted(c["round"] for c in got)


def test_few_and_no_points(spark):
    same = spark.createDataFrame([(i, 1.0, 1.0, None) for i in range(4)], "id long, a double, b double, c string")
    assert cluster.oversampled_seeds(same, 3, NUMBERS, CATEGORIES, WEIGHT) == [{"a": 1.0, "b": 1.0, "c": None}]
    assert cluster.oversampled_seeds(same.where("false"), 3, NUMBERS, CATEGORIES, WEIGHT) == []


def test_runs_over_k(spark):
    costs = cluster.costs_by_k(points(spark), [1, 5], NUMBERS, CATEGORIES, WEIGHT, most_rounds=3)
    assert costs[5] < costs[1] / 50
    assert costs[5] == pytest.approx(cluster.costs_by_k(points(spark).repartition(5), [5], NUMBERS, CATEGORIES, WEIGHT, most_rounds=3)[5])
