"""The stencil over the blocks of a layout: interior cells stay with their block, faces travel.

A block is a row that holds its cells as an array, and rows lie by the number of the block, in a table
that every step reads where it lies.  A step exchanges only faces: each block sends the layer at each
inner side to the block beyond it, one row a side.  A block must fit a task, so the layout has to have enough
of them; extents may differ by a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshframe.operators import layout as layouts
from meshframe.operators.grid import _dense_step
from meshframe.plans.scratch import keep, observed

Shape = tuple[int, int, int]
#: The axis of each side and whether it is the high one.
SIDES = [(axis, high) for axis in range(3) for high in (False, True)]
_STATE = "block bigint, cells binary, here binary"


@dataclass
class Steps:
    """The cells after the last step, and how many cells travelled in each."""

    cells: DataFrame
    sent: list[int] = field(default_factory=list)


def extents(block: int, shape: Shape, layout: Shape) -> list[tuple[int, int]]:
    """Ends of a block on each axis, as :func:`meshframe.operators.layout.assign` deals cells."""
    at = np.unravel_index(block, layout)
    return [(-(-int(b) * n // p), -(-(int(b) + 1) * n // p)) for b, n, p in zip(at, shape, layout, strict=True)]


def _neighbour(block: int, layout: Shape, axis: int, high: bool) -> int | None:
    at = [int(x) for x in np.unravel_index(block, layout)]
    at[axis] += 1 if high else -1
    return int(np.ravel_multi_index(at, layout)) if 0 <= at[axis] < layout[axis] else None


def _layer(axis: int, high: bool) -> tuple:
    return tuple(slice(None) if a != axis else slice(-1, None) if high else slice(0, 1) for a in range(3))


def _arrays(b: pa.RecordBatch | pa.Table, row: int, size: list[int]) -> tuple[np.ndarray, np.ndarray]:
    cells, here = b.column("cells")[row].as_buffer(), b.column("here")[row].as_buffer()
    return np.frombuffer(cells, np.float64).reshape(size), np.frombuffer(here, np.bool_).reshape(size)


def dealt(grid: DataFrame, shape: Shape, layout: Shape) -> DataFrame:
    """``block, cells, here``: the cells ``i, j, k, v`` of each block; those that are lacking are 0 and not ``here``."""
    if any(p > n for p, n in zip(layout, shape, strict=True)):
        raise ValueError("a layout has at most a block for each cell of an axis")
    number = (F.col("bx") * layout[1] + F.col("by")) * layout[2] + F.col("bz")
    inside = [F.col(a).between(0, n - 1) for a, n in zip("ijk", shape, strict=True)]
    rows = layouts.assign(grid.where(inside[0] & inside[1] & inside[2]).select("i", "j", "k", "v"), shape, layout).select(number.cast("bigint").alias("block"), "i", "j", "k", "v")

    def build(key: tuple, cells: pa.Table) -> pa.Table:
        ends = extents(key[0].as_py(), shape, layout)
        v = np.zeros([hi - lo for lo, hi in ends])
        here = np.zeros(v.shape, bool)
        at = tuple(cells.column(c).to_numpy() - lo for c, (lo, _) in zip("ijk", ends, strict=True))
        np.add.at(v, at, cells.column("v").to_numpy())
        here[at] = True
        return pa.table({"block": [key[0].as_py()], "cells": pa.array([v.tobytes()], pa.binary()), "here": pa.array([here.tobytes()], pa.binary())})

    # blocks without a cell take part as well: shares may reach them
    every = grid.sparkSession.range(int(np.prod(layout))).select(F.col("id").alias("block"))
    found = every.join(rows.groupBy("block").applyInArrow(build, _STATE), "block", "left")
    zeros = [F.coalesce(c, F.lit(b"")).alias(c) for c in ("cells", "here")]
    return found.select("block", *zeros)


def _filled(cells: np.ndarray | None, here: np.ndarray | None, size: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.zeros(size), np.zeros(size, bool)) if cells is None else (cells, here)


def _own(b: pa.RecordBatch | pa.Table, row: int, shape: Shape, layout: Shape) -> tuple[int, np.ndarray, np.ndarray]:
    block = b.column("block")[row].as_py()
    size = [hi - lo for lo, hi in extents(block, shape, layout)]
    return block, *(_arrays(b, row, size) if len(b.column("cells")[row].as_buffer()) else _filled(None, None, size))


def faces(state: DataFrame, shape: Shape, layout: Shape) -> DataFrame:
    """``block, side, n, cells, here``: the layers that each block receives, ``n`` cells each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in range(b.num_rows):
                block, v, here = _own(b, row, shape, layout)
                for axis, high in SIDES:
                    if (to := _neighbour(block, layout, axis, high)) is not None:
                        own = v[_layer(axis, high)]
                        out.append((to, SIDES.index((axis, not high)), own.size, own.tobytes(), here[_layer(axis, high)].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "side", "n", "cells", "here"])

    return state.mapInArrow(run, "block bigint, side int, n bigint, cells binary, here binary")


def step(state: DataFrame, received: DataFrame, shape: Shape, layout: Shape) -> DataFrame:
    """The blocks after a step, of their cells and the faces that they received."""

    def run(own: pa.Table, around: pa.Table) -> pa.Table:
        block, v, here = _own(own, 0, shape, layout)
        size = v.shape
        pad = [[0, 0] for _ in range(3)]
        for side in around.column("side").to_pylist():
            pad[SIDES[side][0]][SIDES[side][1]] = 1
        wide, there = np.pad(v, pad), np.pad(here, pad)
        inner = tuple(slice(lo, lo + n) for (lo, _), n in zip(pad, size, strict=True))
        for row, side in enumerate(around.column("side").to_pylist()):
            axis, high = SIDES[side]
            at = list(inner)
            at[axis] = slice(-1, None) if high else slice(0, 1)
            layer = [1 if a == axis else n for a, n in enumerate(size)]
            wide[tuple(at)], there[tuple(at)] = _arrays(around, row, layer)
        ends = [(lo == 0, hi == n) for (lo, hi), n in zip(extents(block, shape, layout), shape, strict=True)]
        wide, there = _dense_step(wide, there, ends)
        return pa.table({"block": [block], "cells": pa.array([np.ascontiguousarray(wide[inner]).tobytes()], pa.binary()), "here": pa.array([np.ascontiguousarray(there[inner]).tobytes()], pa.binary())})

    return state.groupBy("block").cogroup(received.groupBy("block")).applyInArrow(run, _STATE)


def unpacked(state: DataFrame, shape: Shape, layout: Shape) -> DataFrame:
    """``i, j, k, v`` of the cells that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block, v, here = _own(b, row, shape, layout)
                found = np.nonzero(here)
                ends = extents(block, shape, layout)
                yield pa.RecordBatch.from_arrays([*[pa.array(f + lo, pa.int64()) for f, (lo, _) in zip(found, ends, strict=True)], pa.array(v[found])], ["i", "j", "k", "v"])

    return state.mapInArrow(run, "i bigint, j bigint, k bigint, v double")


def run(grid: DataFrame, shape: Shape, layout: Shape, steps: int) -> Steps:
    """``steps`` steps of the stencil over the blocks of ``layout``; the values do not depend on it."""
    state = keep(dealt(grid, shape, layout), "block", "halo-blocks")
    found = Steps(state)
    for _ in range(steps):
        seen = Observation()
        sent = faces(state, shape, layout).observe(seen, F.sum("n").alias("cells"))
        state = keep(step(state, sent, shape, layout), "block", "halo-blocks", instead_of=state)
        found.sent.append(observed(seen).get("cells", 0))
    found.cells = unpacked(state, shape, layout)
    return found


def planned(grid: DataFrame, shape: Shape, nodes: int, steps: int) -> Steps:
    """:func:`run` with the layout that :func:`meshframe.operators.layout.choose` finds for the grid."""
    asked = grid.sparkSession.createDataFrame([(0, *shape, nodes, steps)], "request int, nx bigint, ny bigint, nz bigint, nodes bigint, steps bigint")
    best = layouts.choose(asked).first()
    return run(grid, shape, tuple(min(best[c], n) for c, n in zip(("xp", "yp", "zp"), shape, strict=True)), steps)
