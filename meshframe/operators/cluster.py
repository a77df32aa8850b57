"""k-prototypes: k-means for rows of numbers and categories.

The centres are few and bounded by ``k``; they go into the plan as literals, so that an assignment is
a projection without a join.  Where centres times columns are many, the generated code would be too long
for the JVM to compile and would be interpreted; batches of columns are compared in numpy then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meshframe.plans.scratch import cut, observed, release

Centre = dict[str, object]
TERMS = 32  # of all centres in one projection: the JVM compiles no method of over 8,000 bytes


def distance(centre: Centre, numbers: list[str], categories: list[str], weight: float, delta: str = "mismatch") -> Column:
    """Squared differences of numbers plus ``weight`` for each category that differs.

    ``delta="printed"`` counts the categories that are equal instead.
    """
    total = F.lit(0.0)
    for n in numbers:
        total = total + (F.col(n) - F.lit(float(centre[n]))) * (F.col(n) - F.lit(float(centre[n])))
    for c in categories:
        same = F.col(c).eqNullSafe(F.lit(centre[c]))
        total = total + F.when(same if delta == "printed" else ~same, F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def distances(centres: list[Centre], numbers: list[str], categories: list[str], weight: float, delta: str = "mismatch", base: int = 0) -> list[Column]:
    """``distance, cluster`` of centres numbered from ``base``, the least of which is the nearest: of each, or of the nearest alone where there are many terms."""
    if len(centres) * (len(numbers) + len(categories)) <= TERMS:
        return [F.struct(distance(c, numbers, categories, weight, delta).alias("distance"), F.lit(base + i).alias("cluster")) for i, c in enumerate(centres)]
    return [_nearest(centres, numbers, categories, weight, delta, base)]


def _nearest(centres: list[Centre], numbers: list[str], categories: list[str], weight: float, delta: str, base: int) -> Column:
    """The least of :func:`distances` by batches of columns: the same sums in the same order, and the same place for nulls (first) and NaN (last)."""
    far = [[float(c[n]) for n in numbers] for c in centres]
    kinds = [[c[n] for n in categories] for c in centres]

    def same(column: pa.Array, value: object) -> np.ndarray:
        if value is None:
            found = pc.is_null(column)
        elif value != value:
            found = pc.fill_null(pc.is_nan(column), False)
        else:
            found = pc.fill_null(pc.equal(column, pa.scalar(value, column.type)), False)
        return found.to_numpy(zero_copy_only=False)

    @F.arrow_udf("distance double, cluster int")
    def nearest(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        x = [c.to_numpy(zero_copy_only=False) for c in columns[: len(numbers)]]
        best, who = np.zeros(0), np.full(n, base, np.int32)
        with np.errstate(all="ignore"):
            for i in range(len(far)):
                total = np.zeros(n)
                for column, at in zip(x, far[i], strict=True):
                    total += (column - at) * (column - at)
                for column, value in zip(columns[len(numbers) :], kinds[i], strict=True):
                    total += np.where(same(column, value) == (delta == "printed"), float(weight), 0.0)
                if i:
                    nearer = (total < best) | (np.isnan(best) & ~np.isnan(total))
                    best, who = np.where(nearer, total, best), np.where(nearer, np.int32(base + i), who)
                else:
                    best = total
        absent = np.zeros(n, bool)
        for c in columns[: len(numbers)]:
            if c.null_count:
                absent |= c.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(best, mask=absent), pa.array(np.where(absent, np.int32(base), who))], ["distance", "cluster"])

    return nearest(*[F.col(n).cast("double") for n in numbers], *[F.col(c) for c in categories])


def assign(points: DataFrame, centres: list[Centre], numbers: list[str], categories: list[str], weight: float, delta: str = "mismatch") -> DataFrame:
    """``points`` with ``cluster`` and ``distance``: the nearest centre, the least number among ties."""
    best = F.array_min(F.array(*distances(centres, numbers, categories, weight, delta)))
    return points.withColumn("_best", best).select(*points.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance"))


def assign_vectors(points: DataFrame, column: str, centres: list[list[float]]) -> DataFrame:
    """As :func:`assign` for one array of numbers, with the squared distance."""
    square = lambda a, b: (a - b) * (a - b)
    each = [F.struct(F.aggregate(F.zip_with(column, F.array(*map(F.lit, c)), square), F.lit(0.0), lambda t, x: t + x).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    return points.withColumn("_best", F.array_min(F.array(*each))).select(*points.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance"))


def update(assigned: DataFrame, numbers: list[str], categories: list[str], digits: int = 6) -> DataFrame:
    """``cluster, n`` and new centres: means of numbers, rounded to ``digits``, and the most frequent category, the least among ties."""
    means = [F.round(F.avg(n), digits).alias(n) for n in numbers]
    modes = [F.mode(c, True).alias(c) for c in categories]
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *means, *modes)


def seeds(points: DataFrame, k: int, key: str = "id") -> list[Centre]:
    """The points of the ``k`` least keys."""
    return [r.asDict() for r in points.orderBy(key).limit(k).collect()]


def draw(key: str, turn: int) -> Column:
    """A number from 0 to 1 that follows from a row's key and the turn alone, however rows are dealt."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{turn}"))), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def candidates(points: DataFrame, numbers: list[str], categories: list[str], weight: float, each: float, rounds: int = 4, key: str = "id") -> list[Centre]:
    """Oversampled seeds (I5): the point of the least draw, then in each round about ``each`` more.

    A point is drawn with a probability in proportion to its distance from the nearest candidate so far, all
    points at once.  The distances are kept in a table, against which a round computes those to its new
    candidates alone; their sum is observed while the table is written.  Candidates come in the order of
    rounds and keys, with ``round`` and ``weight``, the number of points that are nearest to each (the
    first among equals).  About ``1 + rounds * each`` rows reach the driver.
    """
    first = points.orderBy(draw(key, 0), key).limit(1).collect()
    if not first:
        return []
    found = [first[0].asDict() | {"round": 0}]
    new, state = found, points.select(key, *numbers, *categories, F.lit(None).cast("double").alias("_near"), F.lit(-1).alias("_who"))
    held = None
    for turn in range(1, rounds + 2):
        base = len(found) - len(new)
        before = F.struct(F.coalesce("_near", F.lit(float("inf"))).alias("distance"), F.col("_who").alias("cluster"))
        nearer = F.array_min(F.array(before, *distances(new, numbers, categories, weight, base=base)))
        state = state.withColumn("_best", nearer).select(key, *numbers, *categories, F.col("_best.distance").alias("_near"), F.col("_best.cluster").alias("_who"))
        if turn > rounds:
            break
        seen = Observation()
        state = held = cut(state.observe(seen, F.sum("_near").alias("total")), "seeds", instead_of=held)
        total = observed(seen).get("total", 0)
        if not total:
            break
        drawn = state.where(draw(key, turn) < each * F.col("_near") / float(total)).select(key, *numbers, *categories).orderBy(key).collect()
        new = [r.asDict() | {"round": turn} for r in drawn]
        found = found + new
    nearest = {r["_who"]: r["count"] for r in state.groupBy("_who").count().collect()}
    release(held)
    return [c | {"weight": nearest.get(n, 0)} for n, c in enumerate(found)]


def oversampled_seeds(points: DataFrame, k: int, numbers: list[str], categories: list[str], weight: float, rounds: int = 4, key: str = "id", seed: int = 0) -> list[Centre]:
    """``k`` centres of the :func:`candidates`, each drawn by weight times distance from those before it (fewer where there are no more distinct ones)."""
    given = candidates(points, numbers, categories, weight, 2.0 * k, rounds, key)
    if not given:
        return []
    x = np.array([[float(c[n]) for n in numbers] for c in given]).reshape(len(given), len(numbers))
    kinds = np.array([[repr(c[n]) for n in categories] for c in given], object).reshape(len(given), len(categories))
    mass = np.array([float(c["weight"]) for c in given])
    random, near, chosen = np.random.default_rng(seed), np.full(len(given), np.inf), []
    while len(chosen) < k:
        share = mass * (near if chosen else 1.0)
        if not share.sum():
            break
        chosen.append(int(random.choice(len(given), p=share / share.sum())))
        own = ((x - x[chosen[-1]]) ** 2).sum(1) + weight * (kinds != kinds[chosen[-1]]).sum(1)
        near = np.minimum(near, own)
    return [{c: given[n][c] for c in (*numbers, *categories)} for n in chosen]


def costs_by_k(points: DataFrame, ks: list[int], numbers: list[str], categories: list[str], weight: float, most_rounds: int = 10, key: str = "id") -> dict[int, float]:
    """The cost of the last round of :func:`fit` for each number of clusters, from oversampled seeds."""
    return {k: fit(points, k, numbers, categories, weight, most_rounds, key=key, initial=oversampled_seeds(points, k, numbers, categories, weight, key=key))[1][-1] for k in ks}


def fit(points: DataFrame, k: int, numbers: list[str], categories: list[str], weight: float, most_rounds: int = 20, delta: str = "mismatch", key: str = "id", initial: list[Centre] | None = None) -> tuple[list[Centre], list[float]]:
    """Centres after ``most_rounds`` rounds, or when they stay, and the cost of each round.

    A cluster that loses all points keeps its centre.
    """
    points = cut(points.select(key, *numbers, *categories), "points")
    centres = initial or seeds(points, k, key)
    costs = []
    for _ in range(most_rounds):
        found = assign(points, centres, numbers, categories, weight, delta)
        means = [F.round(F.avg(n), 6).alias(n) for n in numbers]
        rows = found.groupBy("cluster").agg(F.sum("distance").alias("_cost"), *means, *[F.mode(c, True).alias(c) for c in categories]).collect()
        costs.append(float(sum(r["_cost"] for r in rows)))
        new = list(centres)
        for r in rows:
            new[r["cluster"]] = {c: r[c] for c in (*numbers, *categories)}
        stay = all(all(a[c] == b[c] for c in (*numbers, *categories)) for a, b in zip(centres, new, strict=True))
        centres = new
        if stay:
            break
    return centres, costs
