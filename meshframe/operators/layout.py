"""Search of the cheapest block layout of a grid, block assignment and block topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the cost model: words a second of memory and network, and the share of cells that may be sent.
MEMORY_RATE, LIMIT = 250, 0.01


def layouts(requests: DataFrame) -> DataFrame:
    """All layouts ``xp * yp * zp = used`` for ``used`` from 1 to ``nodes`` of each request, with ``cost`` and ``feasible``.

    The cost counts the cells on inner faces, twice for each node, and the cells over the steps.
    """
    ints = [F.col(c).cast("bigint").alias(c) for c in ("nx", "ny", "nz", "nodes", "steps")]
    r = requests.select("request", *ints)
    used = r.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "nodes")).alias("used"))
    divisors = F.filter(F.sequence(F.lit(1).cast("bigint"), F.col("used")), lambda d: F.pmod(F.col("used"), d) == 0)
    x = used.select("*", F.explode(divisors).alias("xp"))
    rest = F.expr("used div xp")
    y = x.select("*", F.explode(F.filter(F.sequence(F.lit(1).cast("bigint"), rest), lambda d: F.pmod(rest, d) == 0)).alias("yp"))
    z = y.withColumn("zp", F.expr("used div xp div yp"))
    faces = (F.col("xp") - 1) * F.col("ny") * F.col("nz") + (F.col("yp") - 1) * F.col("nx") * F.col("nz") + (F.col("zp") - 1) * F.col("nx") * F.col("ny")
    volume = F.col("nx") * F.col("ny") * F.col("nz")
    cost = 2 * F.col("used") * faces + F.expr("nx * ny * nz div steps")
    return z.withColumn("cost", cost).withColumn("feasible", F.col("cost") <= MEMORY_RATE * LIMIT * volume)


def choose(requests: DataFrame) -> DataFrame:
    """``request, used, xp, yp, zp, cost``: most nodes first, then the least cost, then the least ``xp, yp``.

    Without a feasible layout the answer is one block, with the cost null.
    """
    order = F.struct(-F.col("used"), "cost", "xp", "yp")
    best = layouts(requests).where("feasible").groupBy("request").agg(F.min_by(F.struct("used", "xp", "yp", "zp", "cost"), order).alias("b"))
    one = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(1).cast("bigint")).alias(c)
    return requests.select("request").join(best, "request", "left").select("request", *[one(c) for c in ("used", "xp", "yp", "zp")], F.col("b.cost").alias("cost"))


def _part(axis: str, n: int, parts: int) -> Column:
    return F.floor(F.col(axis) * parts / n).cast("int")


def assign(grid: DataFrame, shape: tuple[int, int, int], layout: tuple[int, int, int]) -> DataFrame:
    """``grid`` with ``bx, by, bz``: blocks of nearly equal extents (L2, L3)."""
    return grid.select("*", *[_part(a, n, p).alias(f"b{c}") for a, c, n, p in zip("ijk", "xyz", shape, layout, strict=True)])


def assign_shell(grid: DataFrame, shape: tuple[int, int, int], layout: tuple[int, int]) -> DataFrame:
    """``grid`` with ``bx, by``: the solver's blocks of the plane (L3); layers are not cut.

    Each half of ``x`` is cut apart, into half of the blocks of equal width (the last takes what is
    left), and blocks of ``y`` have one row more than a share, so the last may be smaller or empty.
    """
    (nx, ny, _), (px, py) = shape, layout
    if px % 2 or px > nx:
        raise ValueError("an even number of blocks along x, at most its cells")
    half = F.when(F.col("i") >= nx // 2, 1).otherwise(0)
    inside = F.expr(f"least({px // 2 - 1}L, (i - {nx // 2} * if(i >= {nx // 2}, 1, 0)) div {nx // 2 // (px // 2)}L)")
    return grid.select("*", (half * (px // 2) + inside).cast("int").alias("bx"), F.expr(f"j div {ny // py + 1}L").cast("int").alias("by"))


def blocks(assigned: DataFrame) -> DataFrame:
    """``bx, by, bz`` with the ends of each block, ``x0, x1, y0, y1, z0, z1`` (M9); ends are exclusive."""
    ends = [e for a, c in zip("ijk", "xyz", strict=True) for e in (F.min(a).alias(f"{c}0"), (F.max(a) + 1).alias(f"{c}1"))]
    return assigned.groupBy("bx", "by", "bz").agg(*ends)


def neighbours(table: DataFrame, layout: tuple[int, int, int]) -> DataFrame:
    """``bx, by, bz, side, block``: the number of the block on each of six sides, -1 where there is none."""
    moves = [(-1, 0, 0), (0, 1, 0), (1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1)]
    sides = F.array(*[F.struct(F.lit(n).alias("side"), *[(F.col(f"b{c}") + d).alias(c) for c, d in zip("xyz", m, strict=True)]) for n, m in enumerate(moves)])
    each = table.select("bx", "by", "bz", F.explode(sides).alias("s"))
    inside = [F.col(f"s.{c}").between(0, p - 1) for c, p in zip("xyz", layout, strict=True)]
    number = (F.col("s.x") * layout[1] + F.col("s.y")) * layout[2] + F.col("s.z")
    return each.select("bx", "by", "bz", F.col("s.side").alias("side"), F.when(inside[0] & inside[1] & inside[2], number).otherwise(-1).alias("block"))


def halo_sizes(table: DataFrame, layout: tuple[int, int, int]) -> DataFrame:
    """``bx, by, bz, halo``: cells that each block receives from its neighbours."""
    ext = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"}
    area = {"x": ext["y"] * ext["z"], "y": ext["x"] * ext["z"], "z": ext["x"] * ext["y"]}
    sides = [(F.when(F.col(f"b{c}") > 0, area[c]).otherwise(0) + F.when(F.col(f"b{c}") < p - 1, area[c]).otherwise(0)) for c, p in zip("xyz", layout, strict=True)]
    return table.select("bx", "by", "bz", (sides[0] + sides[1] + sides[2]).alias("halo"))
