"""Edges as a two-dimensional grid: each block a range of sources by a range of targets, all of about one size.

Sources and targets are placed on lines by a hash of their id.  The plane is counted in cells, as many
however large the graph, and halved, across the longer side that can be, until there are enough
blocks.  The edges of a hub fill one row of cells, which is cut by target; those into a
popular target fill a column, which is cut by source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.operators.graph import BASE, DAMPING, initial_state
from meshframe.plans.scratch import drop, keep

CELLS = 128  # a side of the plane


def place(of: str) -> Column:
    """The cell of an id on its line."""
    return F.shiftrightunsigned(F.xxhash64(of), 57).cast("int")


def cut_plane(counts: np.ndarray, blocks: int) -> list[tuple[int, int, int, int]]:
    """Rectangles ``s0, s1, t0, t1`` (ends exclusive) of a matrix of counts, each halved at its middle edge until there are ``blocks``.

    The largest is halved next; one cell cannot be.  Together they cover the plane.
    """
    found = [(0, counts.shape[0], 0, counts.shape[1])]
    size = lambda r: int(counts[r[0] : r[1], r[2] : r[3]].sum())
    halves = lambda r: [h for axis in (0, 1) if (h := _halved(counts, r, axis))]
    sizes, done = [size(found[0])], []
    while found and len(found) + len(done) < blocks:
        n = int(np.argmax(sizes))
        r, _ = found.pop(n), sizes.pop(n)
        pairs = halves(r)
        if not pairs:
            done.append(r)
            continue
        for half in min(pairs, key=lambda p: (max(map(size, p)), abs((p[0][1] - p[0][0]) - (p[0][3] - p[0][2])))):
            found.append(half)
            sizes.append(size(half))
    return sorted(found + done)


def _halved(counts: np.ndarray, r: tuple[int, int, int, int], axis: int) -> tuple | None:
    s0, s1, t0, t1 = r
    line = counts[s0:s1, t0:t1].sum(1 - axis).cumsum()
    if len(line) < 2:
        return None
    at = int(np.abs(line[:-1] - line[-1] / 2).argmin()) + 1
    return ((s0, s0 + at, t0, t1), (s0 + at, s1, t0, t1)) if axis == 0 else ((s0, s1, t0, t0 + at), (s0, s1, t0 + at, t1))


@dataclass
class Grid:
    """``edges``: ``block, src, dst, n`` (n: how often the edge stands), ``homes``: the blocks of each source; both lie by block and source.  ``ranges`` are the rectangles of the blocks."""

    edges: DataFrame
    homes: DataFrame
    ranges: list[tuple[int, int, int, int]]

    def drop(self) -> None:
        drop(self.edges, self.homes)


def grid(edges: DataFrame, blocks: int = 64) -> Grid:
    """The grid of ``src, dst`` with about ``blocks`` blocks; equal edges become one with a number."""
    simple = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    placed = keep(simple.withColumns({"s": place("src"), "t": place("dst")}), ["src", "dst"], "edges")
    counts = np.zeros((CELLS, CELLS), np.int64)
    for r in placed.groupBy("s", "t").count().collect():  # at most CELLS * CELLS rows
        counts[r["s"], r["t"]] = r["count"]
    ranges = cut_plane(counts, blocks)
    cells = [(s, t, b) for b, (s0, s1, t0, t1) in enumerate(ranges) for s in range(s0, s1) for t in range(t0, t1)]
    of_cell = edges.sparkSession.createDataFrame(cells, "s int, t int, block int")
    laid = keep(placed.join(F.broadcast(of_cell), ["s", "t"]).select("block", "src", "dst", "n"), ["block", "src"], "edge-grid")
    homes = keep(laid.select("block", "src").distinct(), ["block", "src"], "edge-homes")
    drop(placed)
    return Grid(laid, homes, ranges)


def block_table(g: Grid) -> DataFrame:
    """``block, source_from, source_to, target_from, target_to, edges``: ranges of cells, ends exclusive."""
    spark = g.edges.sparkSession
    ranges = spark.createDataFrame([(b, *r) for b, r in enumerate(g.ranges)], "block int, source_from int, source_to int, target_from int, target_to int")
    counted = g.edges.groupBy("block").agg(F.count(F.lit(1)).alias("edges"))
    return ranges.join(counted, "block", "left").select(*ranges.columns, F.coalesce("edges", F.lit(0)).alias("edges"))


def propagate(g: Grid, values: DataFrame, message: Column, combine: Callable[[Column], Column], out: str = "message") -> DataFrame:
    """As :func:`meshframe.operators.graph.propagate`, by blocks: values go to the blocks of their source, edges stay where they lie.

    ``message`` may use ``n``, the number of equal edges.
    """
    sent = g.homes.join(values, g.homes["src"] == values["id"]).drop("src").withColumnRenamed("id", "src")
    each = g.edges.join(sent, ["block", "src"]).select(F.col("dst").alias("id"), message.alias("_m"))
    return each.groupBy("id").agg(combine(F.col("_m")).alias(out))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int, blocks: int = 64) -> DataFrame:
    """``id, rank`` after ``rounds`` rounds of the normalized mode, over the grid."""
    g = grid(edges, blocks)
    first = keep(initial_state(vertices, edges), "id", "grid-state")
    degrees, state = first.select("id", "degree"), first
    for n in range(rounds):
        sums = propagate(g, state.where("delta is not null"), F.col("delta") * F.col("n"), F.sum, "total")
        rank = BASE + DAMPING * F.coalesce("total", F.lit(0.0))
        new = degrees.join(sums, "id", "left").select("id", "degree", rank.alias("rank"), F.try_divide(rank, F.col("degree")).alias("delta"))
        state = keep(new, "id", "grid-state", instead_of=state if state is not first else None) if n + 1 < rounds else new
    return state.select("id", "rank")
