"""Restarted GCR with a block-wise incomplete LU preconditioner.

Elimination and triangular solves go row after row and are no relational operators: they run as grouped
Arrow functions, one group a block, on arrays, a level of rows that do not need each other at a time.  Blocks are runs of ``block_rows`` rows, a bounded number, and a
part of the method: entries outside a row's block are left out of the factors, so the number of
steps depends on the blocks and not on how Spark deals out rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshframe.operators import linalg
from meshframe.plans.scratch import cut, drop, keep, observed, release

TOLERANCE, MOST_STEPS, RESTART = 6.7247278541769e-05, 30, 5
CANCELLED = 1e-4  # share of a product beyond which its sum of parts is not trusted


class Block:
    """The entries of a block by rows, with entries of equal places added up; rows and columns are numbered in it."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> None:
        self.names = np.unique(np.concatenate([row, col]))
        self.n = len(self.names)
        key = np.searchsorted(self.names, row) * self.n + np.searchsorted(self.names, col)
        self.key, at = np.unique(key, return_inverse=True)
        self.val = np.bincount(at, val, len(self.key))
        self.row, self.col = self.key // self.n, self.key % self.n
        self.ptr = np.searchsorted(self.row, np.arange(self.n + 1))
        own = np.arange(self.n) * (self.n + 1)
        self.diagonal = np.minimum(np.searchsorted(self.key, own), len(self.key) - 1)
        self.lacking = self.key[self.diagonal] != own

    def levels(self, upper: bool = False) -> np.ndarray:
        """Rows of one level need only rows of lower levels: those left of the diagonal, or right of it.

        All entries push their rows up at once until none moves, as often as there are levels.
        """
        side = self.col > self.row if upper else self.col < self.row
        row, col = self.row[side], self.col[side]
        level = np.zeros(self.n, np.int64)
        while len(low := np.flatnonzero(level[row] <= level[col])):
            np.maximum.at(level, row[low], level[col[low]] + 1)
        return level

    def need_pivots(self, rows: np.ndarray) -> None:
        """Raise an error that names the first of ``rows`` whose diagonal entry is absent or zero."""
        bad = rows[self.lacking[rows] | (self.val[self.diagonal[rows]] == 0)]
        if len(bad):
            raise ZeroDivisionError(f"row {self.names[bad.min()]} has no pivot")

    def factor(self) -> None:
        """Replace the values by those of the unit-lower and upper factors on the same places."""
        lower = np.flatnonzero(self.col < self.row)
        order = np.arange(len(lower)) - np.searchsorted(self.row[lower], self.row[lower])  # of an entry left of the diagonal in its row
        level = self.levels()[self.row[lower]]
        by = np.lexsort((order, level))
        lower, group = lower[by], (level * (order.max(initial=0) + 1) + order)[by]
        # what a step of elimination changes: entry t loses the product of p, left of it, and q, above it
        first, last = self.diagonal[self.col[lower]] + 1, self.ptr[self.col[lower] + 1]
        first = np.where(self.lacking[self.col[lower]], last, first)
        n = np.maximum(last - first, 0)
        p = np.repeat(np.arange(len(lower)), n)
        q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + first[p]
        want = self.row[lower[p]] * self.n + self.col[q]
        t = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        here = self.key[t] == want
        p, q, t = p[here], q[here], t[here]
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(begins, np.append(begins[1:], len(group))[: len(begins)], strict=True):
            pivots = self.col[lower[a:b]]
            self.need_pivots(pivots)
            self.val[lower[a:b]] /= self.val[self.diagonal[pivots]]
            x, y = np.searchsorted(p, (a, b))
            self.val[t[x:y]] -= self.val[lower[p[x:y]]] * self.val[q[x:y]]

    def solve(self, x: np.ndarray, levels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The vector through the lower and then the upper factor, by the levels of the rows in each."""
        x = x.astype(float)
        self.need_pivots(np.arange(self.n))
        for upper, level in zip((False, True), levels, strict=True):
            side = np.flatnonzero(self.col > self.row if upper else self.col < self.row)
            side = side[np.argsort(level[self.row[side]], kind="stable")]
            rows = np.argsort(level, kind="stable")
            for k in range(int(level.max(initial=-1)) + 1):
                a, b = np.searchsorted(level[self.row[side]], (k, k + 1))
                at = side[a:b]
                own = rows[slice(*np.searchsorted(level[rows], (k, k + 1)))]
                x[own] -= np.bincount(self.row[at], self.val[at] * x[self.col[at]], self.n)[own]
                if upper:
                    x[own] /= self.val[self.diagonal[own]]
        return x


def _block(table: pa.Table) -> Block:
    return Block(*[table.column(c).to_numpy() for c in ("row", "col", "val")])


def ilu0(matrix: DataFrame, block_rows: int) -> DataFrame:
    """``block, row, col, val, low, up``: unit-lower and upper factors on the pattern of each diagonal block.

    ``low`` and ``up`` are the levels of an entry's row in the solves with the lower and the upper factor,
    found once here.  Repeated entries add up.  A row that is eliminated with and whose diagonal entry is absent or
    becomes zero is an error that names it.
    """
    block = F.floor(F.col("row") / block_rows)
    own = matrix.where(block == F.floor(F.col("col") / block_rows)).select(block.alias("block"), "row", "col", "val")

    def factor(table: pa.Table) -> pa.Table:
        b = _block(table)
        b.factor()
        place = {"block": pa.array(np.full(len(b.val), table.column("block")[0].as_py()), pa.int64()), "row": b.names[b.row], "col": b.names[b.col]}
        return pa.table(place | {"val": b.val, "low": pa.array(b.levels()[b.row], pa.int32()), "up": pa.array(b.levels(True)[b.row], pa.int32())})

    return own.groupBy("block").applyInArrow(factor, "block bigint, row bigint, col bigint, val double, low int, up int")


SWEEP_ROWS = 4096  # of a block that a task sweeps at once; the factors do not depend on it
_SWEPT = "block bigint, own boolean, row array<bigint>, col array<bigint>, val array<double>, change double, flat bigint"


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and for each the number of its range."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - (np.cumsum(n) - n)[which] + first[which], which


def _array(table: pa.Table, column: str) -> np.ndarray:
    value = table.column(column)[0]
    return value.values.to_numpy() if value.is_valid else np.zeros(0, np.int64)


def _swept(row: np.ndarray, col: np.ndarray, a: np.ndarray, val: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The entries of a block, by row and column, after a sweep; ``others`` are row, column and value of entries on and right of the diagonal of rows elsewhere."""
    own = col >= row
    r, c, v = (np.concatenate([x[own], y]) for x, y in zip((row, col, val), others, strict=True))
    pivot = r == c
    by = np.argsort(r[pivot])
    pivot_row, d = r[pivot][by], v[pivot][by]
    by = np.lexsort((c[~pivot], r[~pivot]))
    r, c, v = r[~pivot][by], c[~pivot][by], v[~pivot][by]
    lower = np.flatnonzero(~own)
    q, p = _ranges(np.searchsorted(r, col[lower]), np.searchsorted(r, col[lower], "right"))
    names = np.unique(np.concatenate([row, col]))
    key = np.searchsorted(names, row) * len(names) + np.searchsorted(names, col)
    at = np.minimum(np.searchsorted(names, c), max(0, len(names) - 1))
    q, p = (x[names[at[q]] == c[q]] for x in (q, p))
    want = np.searchsorted(names, row[lower[p]]) * len(names) + at[q]
    t = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
    here = key[t] == want
    new = a - np.bincount(t[here], val[lower[p[here]]] * v[q[here]], len(row))
    at = np.minimum(np.searchsorted(pivot_row, col[lower]), max(0, len(pivot_row) - 1))
    lacking = np.flatnonzero(pivot_row[at] != col[lower])
    if len(lacking):
        raise ZeroDivisionError(f"row {col[lower[lacking]].min()} has no pivot")
    divided = d[at] != 0
    new[lower] = np.where(divided, new[lower] / np.where(divided, d[at], 1.0), val[lower])
    return new


def ilu0_by_sweeps(matrix: DataFrame, tolerance: float = 1e-13, most_sweeps: int = 100, block_rows: int = SWEEP_ROWS) -> tuple[DataFrame, list[float]]:
    """``row, col, val`` of the factors of a whole matrix as one block, by sweeps, and the largest change of each sweep.

    A published fixed point: each entry of the pattern is what its own equation gives with the others of the
    sweep before, ``l = (a - sum l u) / d`` left of the diagonal and ``u = a - sum l u`` elsewhere.  The
    equations depend on each other in no circle, so as many sweeps as they are deep give the factors of
    the elimination, and in practice far fewer.  Runs of ``block_rows`` rows lie together as arrays, and no task
    holds the matrix: a sweep moves the values of a block to where its places lie, and to other blocks those rows
    from the diagonal on that they eliminate with.  It ends when
    the largest change, in proportion to the entry, is at most ``tolerance``, and raises an error where
    that is not so after ``most_sweeps``.  A row whose diagonal entry is absent or becomes zero is an error that names it.
    """

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        row, col, val = (table.column(c).to_numpy() for c in ("row", "col", "val"))
        by = np.lexsort((col, row))
        row, col, val = row[by], col[by], val[by]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1])])
        row, col, a = row[new], col[new], np.bincount(np.cumsum(new) - 1, val)
        lacking = np.setdiff1d(row, row[row == col])
        block = key[0].as_py()
        wanted = np.unique(col[(col < row) & (col // block_rows != block)])
        return pa.table({"block": [block], "row": [row], "col": [col], "a": [a], "wanted": [wanted], "lacking": pa.array(lacking[:1].tolist() or [None], pa.int64())})

    def told(block: int, places: pa.Table, val: np.ndarray, change: float) -> pa.Table:
        """The values of a block, and of the rows that others want of it."""
        row, col = _array(places, "row"), _array(places, "col")
        flat = row[(row == col) & (val == 0)]
        out = [(block, True, None, None, val, change, int(flat.min()) if len(flat) else None)]
        to, want = _array(places, "to"), _array(places, "want")
        right = np.flatnonzero(col >= row)
        for block in np.unique(to):
            asked = want[to == block]
            at, _ = _ranges(np.searchsorted(row[right], asked), np.searchsorted(row[right], asked, "right"))
            out.append((int(block), False, row[right[at]], col[right[at]], val[right[at]], 0.0, None))
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in _SWEPT.split(", ")]
        return pa.table({n: pa.array(list(x), k) for n, x, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    def first(key: tuple, places: pa.Table) -> pa.Table:
        return told(key[0].as_py(), places, _array(places, "a"), 0.0)

    def sweep(key: tuple, places: pa.Table, values: pa.Table) -> pa.Table:
        if not places.num_rows:
            return values.slice(0, 0)  # rows that only others name
        own = values.filter(values.column("own"))
        sent = values.filter(pc.invert(values.column("own")))
        others = [np.concatenate([np.zeros(0, k), *[x.values.to_numpy() for x in sent.column(c)]]) for c, k in (("row", np.int64), ("col", np.int64), ("val", float))]
        old = _array(own, "val")
        new = _swept(_array(places, "row"), _array(places, "col"), _array(places, "a"), old, others)
        moved = new != old
        change = np.abs(new[moved] - old[moved]) / np.maximum(np.abs(new[moved]), 1e-300)
        return told(key[0].as_py(), places, new, float(change.max(initial=0.0)))

    block = F.floor(F.col("row") / block_rows).cast("bigint")
    entries = matrix.select(block.alias("block"), "row", "col", "val")
    packed = cut(entries.groupBy("block").applyInArrow(pack, "block bigint, row array<bigint>, col array<bigint>, a array<double>, wanted array<bigint>, lacking bigint"), "ilu-packed")
    lacking = packed.agg(F.min("lacking")).first()[0]
    if lacking is not None:
        raise ZeroDivisionError(f"row {lacking} has no pivot")
    asked = packed.select(F.col("block").alias("to"), F.explode("wanted").alias("row"))
    asked = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("to", "row")).alias("w")).select("block", F.col("w.to").alias("to"), F.col("w.row").alias("want"))
    places = keep(packed.drop("wanted", "lacking").join(linalg.long(asked), "block", "left"), "block", "ilu-places")
    release(packed)
    state = keep(places.groupBy("block").applyInArrow(first, _SWEPT), "block", "ilu-sweep")
    changes: list[float] = []
    while True:
        no_pivot = state.agg(F.min("flat")).first()[0]
        if no_pivot is not None:
            raise ZeroDivisionError(f"row {no_pivot} has no pivot")
        swept = places.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(sweep, _SWEPT)
        seen = Observation()
        state = keep(swept.observe(seen, F.max("change").alias("change")), "block", "ilu-sweep", instead_of=state)
        changes.append(float(observed(seen).get("change", 0.0)))
        if changes[-1] <= tolerance:
            own = state.where("own").select("block", "val")
            each = places.select("block", "row", "col").join(linalg.long(own), "block").select(F.explode(F.arrays_zip("row", "col", "val")).alias("e"))
            return each.select("e.row", "e.col", "e.val"), changes
        if len(changes) == most_sweeps:
            raise ArithmeticError(f"after {most_sweeps} sweeps an entry still changes by {changes[-1]} of itself")


def ilu_solve(factors: DataFrame, vector: DataFrame, block_rows: int) -> DataFrame:
    """``row, val``: the vector through the lower and then the upper factor of each block.

    Rows that the vector lacks are 0; rows that have no factors keep their value.  A row of the
    factors without a pivot is an error that names it.
    """
    r = vector.select(F.floor(F.col("row") / block_rows).alias("block"), "row", "val")

    def solve(v: pa.Table, m: pa.Table) -> pa.Table:
        row, val = v.column("row").to_numpy(), v.column("val").to_numpy()
        if not m.num_rows:
            return pa.table({"row": row, "val": val})
        b = _block(m)
        levels = (np.zeros(b.n, np.int64), np.zeros(b.n, np.int64))
        for level, c in zip(levels, ("low", "up"), strict=True):
            level[np.searchsorted(b.names, m.column("row").to_numpy())] = m.column(c).to_numpy()
        at = np.minimum(np.searchsorted(b.names, row), b.n - 1)
        inside = b.names[at] == row
        solved = b.solve(np.bincount(at[inside], val[inside], b.n), levels)
        return pa.table({"row": np.concatenate([b.names, row[~inside]]), "val": np.concatenate([solved, val[~inside]])})

    return r.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(solve, "row bigint, val double")


def gcr(matrix: DataFrame, b: DataFrame, x0: DataFrame, block_rows: int | None = None, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS, restart: int = RESTART) -> tuple[DataFrame, list[float]]:
    """``row, val`` of the solution, and the residual norm before the first and after each step (I4).

    Without ``block_rows`` there is no preconditioner.  The loop ends below ``tolerance`` or after
    ``most_steps``, which the last norm tells apart, or where a direction's product with the matrix is 0 while the
    residual is not: no step along it helps.  One frame has the vectors as columns: the solution, the
    residual, and at most ``restart`` pairs of directions.  A step writes two tables, the preconditioned
    residual and this frame; all dot products that it needs are observed while the frame is written, those of
    the next direction by way of its parts.  Only where these nearly cancel is one taken by a pass of
    its own.  Matrix and factors are dealt once, by column and by block, so a step exchanges vectors
    and the products of entries.
    """
    matrix = keep(matrix.select("row", "col", "val"), "col", "gcr-matrix")
    factors = keep(ilu0(matrix, block_rows), "block", "gcr-factors") if block_rows else None

    def precondition(frame: DataFrame, column: str) -> DataFrame:
        v = frame.select("row", F.col(column).alias("val"))
        return ilu_solve(factors, v, block_rows) if factors is not None else v

    def stored(df: DataFrame, held: list[int], old: DataFrame | None) -> tuple[DataFrame, dict[str, float]]:
        """The frame, written, and its dot products: of residual and ``az``, and of each with the held directions."""
        pairs = {"rr": ("r", "r"), "ra": ("r", "az"), "aa": ("az", "az")}
        for j in held:
            pairs |= {f"a{j}": ("az", f"q{j}"), f"r{j}": ("r", f"q{j}")} | {f"q{i}{j}": (f"q{i}", f"q{j}") for i in held if i <= j}
        seen = Observation()
        sums = [F.sum(F.col(a) * F.col(b)).alias(n) for n, (a, b) in pairs.items()]
        out = cut(df.observe(seen, *sums), "gcr-frame", instead_of=old)
        found = observed(seen)
        return out, {n: float(found.get(n, 0.0)) for n in pairs}

    def step_of(dot: dict[str, float], held: list[int], frame: DataFrame, new: int) -> tuple[float, float]:
        """``r q`` and ``q q`` of a new direction ``q = az + sum of beta q``."""
        beta = {j: -dot[f"a{j}"] / dot[f"q{j}{j}"] for j in held}
        rq = dot["ra"] + sum(beta[j] * dot[f"r{j}"] for j in held)
        qq = dot["aa"] + sum(2 * beta[j] * dot[f"a{j}"] for j in held) + sum((1 if i == j else 2) * beta[i] * beta[j] * dot[f"q{i}{j}"] for i in held for j in held if i <= j)
        if held and qq < CANCELLED * dot["aa"]:
            got = linalg.dots(frame, {"rq": ("r", f"q{new}"), "qq": (f"q{new}", f"q{new}")}).first()
            return got["rq"], got["qq"]
        return rq, qq

    first = cut(linalg.align({"x": x0, "r": linalg.residual(matrix, b, x0)}), "gcr-state")
    wide, held, new = first, [], 0
    z = cut(precondition(wide, "r"), "gcr-z")
    norms: list[float] = []
    held_frame = first
    for s in range(most_steps + 1):
        columns = [c for c in wide.columns if c != "row"]
        both = wide.join(linalg.long(z.select("row", F.col("val").alias("z"))), "row", "left").join(linalg.long(linalg.spmv(matrix, z).select("row", F.col("val").alias("az"))), "row", "left")
        held_frame, dot = stored(both.select("row", *columns, F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("az", F.lit(0.0)).alias("az")), held, held_frame)
        norms.append(float(np.sqrt(dot["rr"])))
        if norms[-1] <= tolerance or s == most_steps:
            break
        beta = {j: -dot[f"a{j}"] / dot[f"q{j}{j}"] for j in held}
        turned = linalg.combine(held_frame, "z", {f"p{j}": v for j, v in beta.items()}, "_p")
        turned = linalg.combine(turned, "az", {f"q{j}": v for j, v in beta.items()}, "_q")
        new = s % restart
        kept = [j for j in held if j != new] if new else []
        frame = turned.select("row", "x", "r", *[F.col(f"{c}{j}") for j in kept for c in "pq"], F.col("_p").alias(f"p{new}"), F.col("_q").alias(f"q{new}"))
        rq, qq = step_of(dot, held, frame, new)
        if qq == 0:
            break
        held = [*kept, new]
        wide = linalg.axpy(linalg.axpy(frame, "x", rq / qq, f"p{new}", "x"), "r", -rq / qq, f"q{new}", "r")
        z = cut(precondition(wide, "r"), "gcr-z", instead_of=z)
    drop(matrix, factors)
    release(z)
    return held_frame.select("row", F.col("x").alias("val")), norms
