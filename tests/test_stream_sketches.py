"""Counters kept over a stream are those of one pass over all rows, after any number of runs."""

import pytest
from pyspark.sql import functions as F

from meshframe.functions.hashing import with_jenkins64
from meshframe.operators import sketch
from meshframe.streaming import sketches

P = sketch.Parameters(0.1)
KEY = "spark.sql.streaming.stateStore.providerClass"


def at_once(rows):
    named = rows.where("kind is not null and who is not null").select(F.col("kind").alias("id"), F.col("who").alias("number"))
    h = with_jenkins64(named, "number", "h")
    placed = h.select("id", sketch.register(F.col("h"), P).alias("reg"), sketch.first_set(F.col("h"), P).alias("rank"))
    return sorted(tuple(r) for r in sketch.union(placed).collect())


def test_growing_input_over_restarts(spark, tmp_path):
    source, base = str(tmp_path / "in"), f"file://{tmp_path}/base"
    rows = lambda low, high: spark.createDataFrame([(["hot", "hot", "cold", None][i % 4], None if i % 50 == 0 else i * i, "x") for i in range(low, high)], "kind string, who bigint, reg string")
    before = spark.conf.get(KEY, None)
    run = lambda: sorted(tuple(r) for r in sketches.run_available(spark, source, "kind", "who", P, base, 2).collect())
    logged = lambda: spark.read.parquet(f"{base}/grown").groupBy("batch").count().where("batch >= 0").collect()

    rows(0, 400).repartition(3).write.parquet(source)  # two batches of at most two files
    assert run() == at_once(rows(0, 400))
    first = {r["batch"]: r["count"] for r in logged()}
    assert run() == at_once(rows(0, 400)) and {r["batch"]: r["count"] for r in logged()} == first  # nothing new

    rows(400, 2000).coalesce(1).write.mode("append").parquet(source)
    assert run() == at_once(rows(0, 2000))
    second = {r["batch"]: r["count"] for r in logged()}
    assert len(second) == len(first) + 1 and {k: second[k] for k in first} == first

    rows(0, 2000).coalesce(1).write.mode("append").parquet(source)  # seen before: no register grows
    assert run() == at_once(rows(0, 2000))
    assert {r["batch"]: r["count"] for r in logged()} == second
    assert spark.conf.get(KEY, None) == before


def test_a_batch_that_was_stopped_is_repeated(spark, tmp_path):
    """The files of the last batch and its end mark are lost: it runs again under its number, and the counters are the same."""
    source, base = str(tmp_path / "in"), tmp_path / "base"
    rows = spark.range(500).select(F.lit("all").alias("kind"), F.col("id").alias("who"))
    rows.repartition(3).write.parquet(source)
    run = lambda: sorted(tuple(r) for r in sketches.run_available(spark, source, "kind", "who", P, f"file://{base}", 1).collect())
    wanted = run()
    assert wanted == at_once(rows)
    last = max(int(x.name) for x in (base / "state" / "commits").iterdir() if x.name.isdigit())
    for gone in (base / "state" / "commits" / str(last), base / "state" / "commits" / f".{last}.crc", *(base / "grown" / f"batch={last}").iterdir()):
        gone.unlink(missing_ok=True)
    assert run() == wanted


@pytest.mark.parametrize("kept", ["false", "who is null"])
def test_nothing_to_count(spark, tmp_path, kept):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", None)], "kind string, who bigint").where(kept).write.parquet(source)
    assert sketches.run_available(spark, source, "kind", "who", P, f"file://{tmp_path}/base").isEmpty()
