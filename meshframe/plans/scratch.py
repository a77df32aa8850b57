"""Lineage cuts: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder of this process where it is unset and all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="meshframe-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def job_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that stays."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm or spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _delete() -> None:
    for spark, name in _tables:
        with contextlib.suppress(Exception):
            spark.sql(f"drop table if exists {name}")
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            _remove(spark, path)


def cut(df: DataFrame, what: str, codec: str = "zstd", instead_of: DataFrame | None = None, light: bool = False) -> DataFrame:
    """``df`` written and read again: its plan is a scan from here on, and lost executors do not matter.

    ``instead_of`` is an older result of this function that nothing but ``df`` still reads; its files go.
    ``light`` tables are dealt anew before they are written, into as few files as their size wants.
    """
    if light:
        df = df.hint("rebalance")
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    release(instead_of)
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of results of :func:`cut` that nothing reads any more."""
    for x in tables:
        if x is not None:
            _remove(x.sparkSession, x._scratch_path)


def keep(df: DataFrame, key: str | list[str], what: str = "kept", instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder whose buckets are those of a shuffle by ``key``, a column or several.

    A join or an aggregation by ``key`` reads it where it lies, however many jobs follow.  ``instead_of``
    is an older result of this function that nothing but ``df`` still reads; it goes, entry and files.  The
    entries of others go when this process ends, as their files do.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, what)
    name = "meshframe_" + path.rsplit("-", 1)[-1]
    _tables.append((spark, name))
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._scratch_path, out._scratch_table = path, name
    drop(instead_of)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete results of :func:`keep` that nothing reads any more."""
    for x in tables:
        if x is not None:
            x.sparkSession.sql(f"drop table if exists {x._scratch_table}")
            release(x)


def observed(seen: Observation) -> dict[str, int]:
    """The counts of an observation whose frame was written; a sum over no rows is 0.

    A frame that is empty by plan has no counters, for which there is no other sign than a failing read.
    """
    try:
        return {k: v or 0 for k, v in seen.get.items()}
    except Py4JJavaError:
        return {}
