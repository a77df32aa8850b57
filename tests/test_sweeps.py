"""Factors of a whole matrix by joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import linalg, solver


def entries(df):
    return {(r.row, r.col): r.val for r in df.collect()}


@pytest.fixture(scope="module")
def matrix(spark):
    cells = spark.range(60).select((F.expr("id div 9")).alias("i"), F.expr("id div 3 % 3").alias("j"), (F.col("id") % 3).alias("k")).where("i < 6")
    return linalg.build(cells, (6, 3, 3))


def test_equal_to_the_elimination_of_one_block(spark, matrix):
    found, changes = solver.ilu0_by_sweeps(matrix)
    assert entries(found) == pytest.approx(entries(solver.ilu0(matrix, 1000)), rel=1e-10)
    assert changes[-1] <= 1e-13 < changes[0] and len(changes) < 40


def test_a_strong_coupling_takes_its_depth(spark):
    n = 8
    rows = [(i, j, 1.0 + (i == j) * 0.5 + 0.1 * i) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    df = spark.createDataFrame([*rows, (0, 0, 1.0)], "row bigint, col bigint, val double")
    found, changes = solver.ilu0_by_sweeps(df)
    assert entries(found) == pytest.approx(entries(solver.ilu0(df, 100)), rel=1e-9) and len(changes) <= 2 * n + 1
    with pytest.raises(ArithmeticError, match="after 2 sweeps"):
        solver.ilu0_by_sweeps(df, most_sweeps=2)


@pytest.mark.parametrize(("rows", "named"), [([(0, 0, 1.0), (1, 0, 1.0)], "row 1"), ([(0, 0, 0.0), (1, 0, 1.0), (1, 1, 1.0)], "row 0")])
def test_rows_without_a_pivot(spark, rows, named):
    with pytest.raises(ZeroDivisionError, match=named):
        solver.ilu0_by_sweeps(spark.createDataFrame(rows, "row bigint, col bigint, val double"))


def test_nothing(spark):
    found, changes = solver.ilu0_by_sweeps(spark.createDataFrame([], "row bigint, col bigint, val double"))
    assert found.collect() == [] and changes == [0.0] and np.isfinite(changes).all()


@pytest.mark.parametrize("block_rows", [5, 7, 64])
def test_blocks_of_a_sweep_do_not_matter(spark, matrix, block_rows):
    found, changes = solver.ilu0_by_sweeps(matrix, block_rows=block_rows)
    assert entries(found) == pytest.approx(entries(solver.ilu0(matrix, 1000)), rel=1e-10) and len(changes) < 40


def test_a_sweep_moves_rows_of_other_blocks_alone(spark, matrix, monkeypatch):
    kept, keep = [], solver.keep
    monkeypatch.setattr(solver, "keep", lambda df, *a, **k: kept.append(keep(df, *a, **k)) or kept[-1])
    solver.ilu0_by_sweeps(matrix)
    assert kept[-1].count() == 1  # one block, so nothing but its values


def test_a_pivot_row_that_is_absent(spark):
    with pytest.raises(Exception, match="row 3 has no pivot"):
        solver.ilu0_by_sweeps(spark.createDataFrame([(9, 3, 1.0), (9, 9, 1.0)], "row bigint, col bigint, val double"), block_rows=4)[0].collect()
