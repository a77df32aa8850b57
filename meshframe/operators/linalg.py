"""Sparse matrices as rows ``row, col, val`` and vectors as rows ``row, val``.

The matrix of a sphere shell has 19 entries a cell: itself, its neighbours in the plane, and five
cells above and below.  ``x`` is periodic, beyond a pole lies the cell half way round, and beyond the
first and last layer lies nothing.

A vector or a matrix is as long as the grid, so none is ever broadcast: joins by row or column are merges
(``long``), since the size of the files that rows are made from says little about these rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The offsets of the 19 coefficients in their order in the files.
OFFSETS_X = [0, -1, 1, 0, 0, 1, 1, -1, -1, 0, -1, 1, 0, 0, 0, -1, 1, 0, 0]
OFFSETS_Y = [0, 0, 0, -1, 1, 1, -1, -1, 1, 0, 0, 0, -1, 1, 0, 0, 0, -1, 1]
OFFSETS_Z = [0, 0, 0, 0, 0, 0, 0, 0, 0, -1, -1, -1, -1, -1, 1, 1, 1, 1, 1]


def long(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, whatever its size is thought to be."""
    return df.hint("merge")


def coefficient(row: Column, m: Column) -> Column:
    """A diagonally dominant stand-in for measured coefficients."""
    return F.when(m == 0, F.lit(20.0)).otherwise(-(1.0 + F.pmod(row * 19 + m, F.lit(7))) / F.lit(10.0))


def build(cells: DataFrame, shape: tuple[int, int, int], value=coefficient) -> DataFrame:  # noqa: ANN001
    """``row, col, val`` of all cells ``i, j, k`` of a shell (J7, P13, P14, P15); ``val`` is ``value(row, m)``."""
    nx, ny, nz = shape
    if nx % 2 or nx < 6 or ny < 2:
        raise ValueError("a shell needs an even number of at least 6 columns and 2 rows")
    offsets = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for m, (x, y, z) in enumerate(zip(OFFSETS_X, OFFSETS_Y, OFFSETS_Z, strict=True))])
    row = (F.col("i") * ny + F.col("j")) * nz + F.col("k")
    near = cells.select(row.alias("row"), F.col("i"), F.col("j"), F.col("k"), F.explode(offsets).alias("o"))
    j, k = F.col("j") + F.col("o.y"), F.col("k") + F.col("o.z")
    over = (j < 0) | (j >= ny)
    x = F.pmod(F.col("i") + F.col("o.x") + F.when(over, nx // 2).otherwise(0), F.lit(nx))
    col = (x * ny + F.greatest(F.lit(0), F.least(j, F.lit(ny - 1)))) * nz + k
    return near.where(k.between(0, nz - 1)).select("row", col.alias("col"), value(F.col("row"), F.col("o.m")).alias("val"))


def from_coefficients(coef: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """As :func:`build`, with the values of ``coef`` (``i, j, k`` and an array ``coef`` of 19)."""
    ny, nz = shape[1:]
    built = build(coef.select("i", "j", "k"), shape, lambda row, m: m)
    row = (F.col("i") * ny + F.col("j")) * nz + F.col("k")
    return built.join(long(coef.select(row.alias("row"), "coef")), "row").select("row", "col", F.get("coef", F.col("val").cast("int")).alias("val"))


def row_pointers(matrix: DataFrame, rows_per_block: int = 4096) -> DataFrame:
    """``row, n, ptr``: entries of each row and of all rows before it.

    Rows are summed in blocks of ``rows_per_block`` and those in blocks of as many; only the totals of
    the outer blocks, one for ``rows_per_block ** 2`` rows, are summed in one task.
    """
    counts = matrix.groupBy("row").agg(F.count(F.lit(1)).alias("n")).withColumn("_block", F.floor(F.col("row") / rows_per_block))

    def before(by: str, *within: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inner = counts.groupBy("_block").agg(F.sum("n").alias("n")).withColumn("_outer", F.floor(F.col("_block") / rows_per_block))
    outer = inner.groupBy("_outer").agg(F.sum("n").alias("n")).select("_outer", before("_outer").alias("_outer_start"))
    starts = inner.withColumn("_inner_start", before("_block", "_outer")).join(outer, "_outer").select("_block", (F.col("_inner_start") + F.col("_outer_start")).alias("_start"))
    return counts.withColumn("_in", before("row", "_block")).join(starts, "_block").select("row", "n", (F.col("_start") + F.col("_in")).alias("ptr"))


def sorted_rows(matrix: DataFrame) -> DataFrame:
    """``row, cols, vals`` in the order of columns (O1, M15); a row has at most 19 entries."""
    entries = F.array_sort(F.collect_list(F.struct("col", "val")))
    return matrix.groupBy("row").agg(entries.alias("e")).select("row", F.transform("e", lambda x: x["col"]).alias("cols"), F.transform("e", lambda x: x["val"]).alias("vals"))


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """``row, val``: matrix times vector (J5, A7); repeated entries add up."""
    v = vector.select(F.col("row").alias("_at"), F.col("val").alias("_x"))
    return matrix.join(long(v), matrix["col"] == F.col("_at")).groupBy("row").agg(F.sum(F.col("val") * F.col("_x")).alias("val"))


def align(vectors: dict[str, DataFrame]) -> DataFrame:
    """Vectors as columns of one frame (J9); a row that one lacks is 0 there."""
    named = [v.select("row", F.col("val").alias(n)) for n, v in vectors.items()]
    joined = reduce(lambda a, b: a.join(long(b), "row", "full"), named)
    return joined.select("row", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in vectors])


def axpy(frame: DataFrame, y: str, a: float, x: str, out: str) -> DataFrame:
    """``out = y + a * x`` (P9, P10, P11 with -1)."""
    return frame.withColumn(out, F.col(y) + F.lit(float(a)) * F.col(x))


def combine(frame: DataFrame, base: str, terms: dict[str, float], out: str) -> DataFrame:
    """``out = base + sum of factor * column`` in the order of ``terms``."""
    total = F.col(base)
    for name, factor in terms.items():
        total = total + F.lit(float(factor)) * F.col(name)
    return frame.withColumn(out, total)


def dots(frame: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with a dot product for each name, in one pass."""
    return frame.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(n) for n, (a, b) in pairs.items()])


def residual(matrix: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """``row, val``: ``b - A x``."""
    both = align({"b": b, "ax": spmv(matrix, x)})
    return axpy(both, "b", -1.0, "ax", "val").select("row", "val")


def norm(vector: DataFrame) -> DataFrame:
    """One row ``norm`` (A10)."""
    return vector.agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("norm"))
