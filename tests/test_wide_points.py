"""Points of many columns: no generated method is too long for the JVM to compile, and the nearest centres are those of the plain expression."""

import re

import pytest
from pyspark.sql import functions as F

from meshframe.operators import cluster
from meshframe.plans import catalog
from meshframe.sources import records

COMPILED = 8000  # bytes of a method, above which HotSpot leaves it interpreted


def longest(spark, df):
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


def test_wide_assignments_are_compiled(spark, tmp_path):
    spark.createDataFrame([], records.kdd_schema()).write.parquet(str(tmp_path / "kdd"))
    points = spark.read.parquet(str(tmp_path / "kdd"))
    found = cluster.assign(points, catalog._KDD_CENTRES, catalog._KDD_NUMBERS, records.KDD_CATEGORIES, 100.0)
    assert longest(spark, found.select("cluster", "distance")) < COMPILED


@pytest.mark.parametrize("delta", ["mismatch", "printed"])
def test_batches_are_as_the_expression(spark, monkeypatch, delta):
    nan = float("nan")
    rows = [(n, float(n * 7 % 11), n * 3 % 5, "xyz"[n % 3], float(n % 2)) for n in range(300)]
    rows += [(300, None, 1, "x", 0.0), (301, nan, 1, "x", 0.0), (302, 1.0, None, None, None), (303, float("inf"), 1, "q", nan), (304, 2.0, 2, None, nan), (305, 1e200, 1, "z", 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b int, c string, d double").repartition(3)
    centres = [{"a": 1.0, "b": 2, "c": "x", "d": 0.0}, {"a": 1.0, "b": 2, "c": "x", "d": 0.0}, {"a": 9.0, "b": 0, "c": None, "d": nan}, {"a": nan, "b": 0, "c": "z", "d": 1.0}]

    def got(terms):
        monkeypatch.setattr(cluster, "TERMS", terms)
        found = cluster.assign(df, centres, ["a", "b"], ["c", "d"], 0.7, delta)
        assert ("ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()) == (terms == 0)
        return [tuple(map(repr, r)) for r in found.orderBy("id").collect()]

    assert got(0) == got(1000)
    monkeypatch.setattr(cluster, "TERMS", 0)
    some = cluster.candidates(df.where("id < 300"), ["a", "b"], ["c", "d"], 0.7, 5.0, 2)
    monkeypatch.setattr(cluster, "TERMS", 1000)
    assert some == cluster.candidates(df.where("id < 300"), ["a", "b"], ["c", "d"], 0.7, 5.0, 2) and len(some) > 2
    assert cluster.assign(df.where(F.lit(False)), centres, ["a", "b"], ["c", "d"], 0.7, delta).count() == 0
