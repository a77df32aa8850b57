"""Seven-point stencil on a 3-D grid of rows ``i, j, k, v``.

A step adds 0.4 of a cell and 0.1 of each of its six neighbours; a side without a neighbour counts
the cell itself.  One step alone is relational: each cell sends its shares to itself and its neighbours,
and the shares are summed by cell.  Several steps go by blocks: a block receives its cells and those
within ``STEPS_PER_EXCHANGE`` of it, and takes as many steps on arrays before cells are exchanged again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.plans.scratch import cut

SELF, SIDE = 0.4, 0.1
BLOCK, STEPS_PER_EXCHANGE = 64, 4
SIDES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def generate(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """A grid of a shape with values that follow from the place."""
    nx, ny, nz = shape
    cells = spark.range(nx * ny * nz).select(F.expr(f"id div {ny * nz}L").alias("i"), F.expr(f"id div {nz}L % {ny}L").alias("j"), F.expr(f"id % {nz}L").alias("k"))
    return cells.withColumn("v", F.pmod(31 * F.col("i") + 7 * F.col("j") + F.col("k"), F.lit(100)).cast("double"))


def _sides_missing(shape: tuple[int, int, int]):  # noqa: ANN202
    ends = [(F.col(a) == e).cast("int") for a, n in zip("ijk", shape, strict=True) for e in (0, n - 1)]
    return sum(ends[1:], ends[0])


def boundary_faces(grid: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``i, j, k, missing``: sides of each cell on which the grid ends."""
    return grid.select("i", "j", "k", _sides_missing(shape).alias("missing"))


def step(grid: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """One stencil step (J3, J4, P7, P8); cells outside ``shape`` receive nothing."""
    own = F.struct("i", "j", "k", ((SELF + SIDE * _sides_missing(shape)) * F.col("v")).alias("v"))
    near = [F.struct(*[(F.col(a) + d).alias(a) for a, d in zip("ijk", s, strict=True)], (SIDE * F.col("v")).alias("v")) for s in SIDES]
    inside = [F.col(f"s.{a}").between(0, n - 1) for a, n in zip("ijk", shape, strict=True)]
    shares = grid.select(F.explode(F.array(own, *near)).alias("s")).where(inside[0] & inside[1] & inside[2])
    return shares.groupBy("s.i", "s.j", "s.k").agg(F.sum("s.v").alias("v"))


def _dense_step(v: np.ndarray, here: np.ndarray, ends: list[tuple[bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """A step on an array; ``ends`` tells at which of its sides the grid ends, and ``here`` which cells there are."""
    out, reached = SELF * v, here.copy()
    for axis, (low, high) in enumerate(ends):
        up = [slice(None)] * 3
        down = [slice(None)] * 3
        up[axis], down[axis] = slice(1, None), slice(None, -1)
        up, down = tuple(up), tuple(down)
        out[up] += SIDE * v[down]
        out[down] += SIDE * v[up]
        reached[up] |= here[down]
        reached[down] |= here[up]
        for at, is_end in ((0, low), (-1, high)):
            if is_end:
                edge = [slice(None)] * 3
                edge[axis] = at
                out[tuple(edge)] += SIDE * v[tuple(edge)]
    return out, reached


def steps_by_block(grid: DataFrame, shape: tuple[int, int, int], steps: int, block: int = BLOCK) -> DataFrame:
    """``steps`` steps after one exchange: a cell goes to each block that it lies within ``steps`` of."""
    near = [F.explode(F.sequence(F.expr(f"greatest(0L, {a} - {steps}L) div {block}L"), F.expr(f"least({n - 1}L, {a} + {steps}L) div {block}L"))).alias(f"b{a}") for a, n in zip("ijk", shape, strict=True)]
    sent = grid.select("i", "j", "k", "v")
    for x in near:
        sent = sent.select("*", x)

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        own = [(b.as_py() * block, min(n, (b.as_py() + 1) * block)) for b, n in zip(key, shape, strict=True)]
        held = [(max(0, lo - steps), min(n, hi + steps)) for (lo, hi), n in zip(own, shape, strict=True)]
        v, here = np.zeros([hi - lo for lo, hi in held]), np.zeros([hi - lo for lo, hi in held], bool)
        at = tuple(cells.column(c).to_numpy() - lo for c, (lo, _) in zip("ijk", held, strict=True))
        np.add.at(v, at, cells.column("v").to_numpy())
        here[at] = True
        ends = [(lo == 0, hi == n) for (lo, hi), n in zip(held, shape, strict=True)]
        for _ in range(steps):
            v, here = _dense_step(v, here, ends)
        inner = tuple(slice(lo - a, hi - a) for (lo, hi), (a, _) in zip(own, held, strict=True))
        found = np.nonzero(here[inner])
        return pa.table({c: f + lo for c, f, (lo, _) in zip("ijk", found, own, strict=True)} | {"v": v[inner][found]})

    return sent.groupBy("bi", "bj", "bk").applyInArrow(run, "i bigint, j bigint, k bigint, v double")


def run(grid: DataFrame, shape: tuple[int, int, int], steps: int, cut_every: int = 4, block: int = BLOCK) -> DataFrame:
    """``steps`` steps (I3, O3); lineage is cut after ``cut_every`` exchanges."""
    state = grid.where(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1) & F.col("k").between(0, shape[2] - 1))
    done = exchanges = 0
    while done < steps:
        now = min(STEPS_PER_EXCHANGE, block, steps - done)
        state = steps_by_block(state, shape, now, block)
        done, exchanges = done + now, exchanges + 1
        if done < steps and exchanges % cut_every == 0:
            state = cut(state, "stencil")
    return state.select("i", "j", "k", "v")


def check(grid: DataFrame) -> DataFrame:
    """``cells, total, least, greatest, norm``."""
    v = F.col("v")
    return grid.agg(F.count(F.lit(1)).alias("cells"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sqrt(F.sum(v * v)).alias("norm"))


def sample_nth(df: DataFrame, n: int, by: str = "cell") -> DataFrame:
    """Every ``n``-th row of a dense key, the last of each ``n``."""
    return df.where(F.pmod(F.col(by), F.lit(n)) == n - 1)
