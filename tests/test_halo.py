"""The stencil over blocks of any layout, and what travels between them."""

import pytest
from pyspark.sql import functions as F

from meshframe.operators import grid, halo, layout

SHAPE = (7, 5, 4)


def cells(df):
    return {(r.i, r.j, r.k): r.v for r in df.collect()}


@pytest.fixture(scope="module")
def start(spark):
    return grid.generate(spark, SHAPE)


@pytest.mark.parametrize("blocks", [(1, 1, 1), (3, 2, 1), (7, 5, 4), (2, 1, 3)])
def test_any_layout_gives_the_same(spark, start, blocks):
    found = halo.run(start, SHAPE, blocks, 3)
    assert cells(found.cells) == pytest.approx(cells(grid.step(grid.step(grid.step(start, SHAPE), SHAPE), SHAPE)))
    sizes = layout.halo_sizes(layout.blocks(layout.assign(start, SHAPE, blocks)), blocks)
    assert found.sent == [sizes.agg(F.sum("halo")).first()[0]] * 3


def test_lacking_cells_are_reached_in_time(spark, start):
    some = start.where("i < 2 and j <> 3")
    found = halo.run(some.unionByName(start.where("i = 0").withColumn("i", F.lit(-1).cast("bigint"))), SHAPE, (4, 2, 1), 2)
    wanted = cells(grid.step(grid.step(some, SHAPE), SHAPE))
    assert cells(found.cells) == pytest.approx(wanted) and max(i for i, _, _ in wanted) == 3


def test_planned_and_refused(spark, start):
    assert cells(halo.planned(start, SHAPE, 4, 1).cells) == pytest.approx(cells(grid.step(start, SHAPE)))
    assert cells(halo.run(start, SHAPE, (2, 2, 2), 0).cells) == cells(start)
    assert halo.run(start.where("i > 99"), SHAPE, (2, 2, 2), 1).cells.collect() == []
    with pytest.raises(ValueError, match="at most a block"):
        halo.run(start, SHAPE, (8, 1, 1), 1)


def test_only_faces_are_exchanged(spark, start):
    state = halo.keep(halo.dealt(start, SHAPE, (3, 2, 1)), "block", "halo-test")
    plan = halo.step(state, halo.faces(state, SHAPE, (3, 2, 1)), SHAPE, (3, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "MapInArrow" in plan[plan.index("Exchange") :]
