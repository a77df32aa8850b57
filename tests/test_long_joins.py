"""Vectors and matrices are as long as the grid: no plan broadcasts one, however small the files look."""

import pytest

from meshframe.plans import catalog

QUERIES = ["spmv", "residual_init", "residual_norm", "vector_dot", "axpy", "linear_combination", "ilu0_factor", "ilu_apply"]


@pytest.mark.parametrize("name", QUERIES)
def test_nothing_is_broadcast(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_step_of_the_solver_broadcasts(spark, sf, monkeypatch):
    from meshframe.operators import solver

    plans, cut = [], solver.cut
    monkeypatch.setattr(solver, "cut", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *a, **k))
    catalog.QUERIES["gcr_step_limit"](spark, sf).collect()
    assert len(plans) > 4 and not any("Broadcast" in x for x in plans)
