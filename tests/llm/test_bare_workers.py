"""Every query runs where workers cannot import the package: a session started from another folder, without PYTHONPATH."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.host", "127.0.0.1").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, sys.argv[1])
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op"):
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_bare_workers(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", CODE, str(REPO), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    ran = [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran ")]
    assert done.returncode == 0, f"after {ran}: {done.stderr[-2000:]}"
    assert len(ran) == 12


def test_next_texts_over_other_splits(spark, sf, odd):
    """op4 numbers rows by their place in files, so a table that is split otherwise gives the same."""
    from meshframe.llm import syncmers

    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    rows = lambda path: sorted(map(repr, syncmers.op4_syncmers(spark, path).collect()))
    whole = [rows(p) for p in (sf, odd)]
    spark.conf.set(key, "20k")
    try:
        assert [rows(p) for p in (sf, odd)] == whole
    finally:
        spark.conf.set(key, before)
