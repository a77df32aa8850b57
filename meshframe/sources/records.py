"""Text and binary records of grids and vectors, and network-connection rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.sources import cells
from meshframe.sources.cells import COEFFICIENTS


def coefficient_text(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, k, coef``: blank-separated lines ``i j k num val`` gathered by cell in the order of ``num``."""
    lines = spark.read.schema("i bigint, j bigint, k bigint, num int, val double").option("sep", " ").csv(path)
    entries = F.array_sort(F.collect_list(F.struct("num", "val")))
    return lines.groupBy("i", "j", "k").agg(F.transform(entries, lambda e: e["val"]).alias("coef"))


def write_coefficient_text(coef: DataFrame, path: str) -> None:
    each = coef.select("i", "j", "k", F.posexplode("coef").alias("num", "val"))
    each.select(F.concat_ws(" ", "i", "j", "k", "num", "val")).write.text(path)


def vector_text(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, k, val`` of blank-separated lines."""
    return spark.read.schema("i bigint, j bigint, k bigint, val double").option("sep", " ").csv(path)


def write_vector_text(vector: DataFrame, path: str) -> None:
    vector.select(F.concat_ws(" ", "i", "j", "k", "val")).write.text(path)


def write_coefficient_records(coef: DataFrame, path: str) -> None:
    """``i, j, k, coef`` as a folder of files of records, in any order."""
    cells.write(coef, path, COEFFICIENTS, headed=True)


def write_vector_records(vector: DataFrame, path: str) -> None:
    """``i, j, k, val`` as a folder of files of records."""
    cells.write(vector, path, headed=True)


def coefficient_records(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, k, coef`` of 168-byte records: three ints, padding, 19 doubles."""
    return cells.read(spark, path, COEFFICIENTS, headed=True)


def vector_records(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, k, val`` of 24-byte records: three ints, padding, a double."""
    return cells.read(spark, path, headed=True)


def block(df: DataFrame, i: tuple[int, int], j: tuple[int, int]) -> DataFrame:
    """Rows of a block of the plane, ends exclusive (S14): ranges of columns, which reach the scan where they are stored."""
    return df.where(F.col("i").between(i[0], i[1] - 1) & F.col("j").between(j[0], j[1] - 1))


# The published columns of connection records, d double, i integer, s text.
KDD = """
duration:i protocol_type:s service:s flag:s src_bytes:i dst_bytes:i land:i wrong_fragment:i urgent:i hot:i
num_failed_logins:i logged_in:i num_compromised:i root_shell:i su_attempted:i num_root:i num_file_creations:i
num_shells:i num_access_files:i num_outbound_cmds:i is_host_login:i is_guest_login:i count:i srv_count:i
serror_rate:d srv_serror_rate:d rerror_rate:d srv_rerror_rate:d same_srv_rate:d diff_srv_rate:d
srv_diff_host_rate:d dst_host_count:i dst_host_srv_count:i dst_host_same_srv_rate:d dst_host_diff_srv_rate:d
dst_host_same_src_port_rate:d dst_host_srv_diff_host_rate:d dst_host_serror_rate:d dst_host_srv_serror_rate:d
dst_host_rerror_rate:d dst_host_srv_rerror_rate:d label:s
"""
KDD_CATEGORIES = ["protocol_type", "service", "flag", "land", "logged_in", "is_host_login", "is_guest_login"]


def kdd_schema() -> T.StructType:
    kinds = {"i": T.LongType(), "d": T.DoubleType(), "s": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in KDD.split())])


def kdd(spark: SparkSession, path: str) -> DataFrame:
    """Connection records of 42 comma fields."""
    return spark.read.schema(kdd_schema()).csv(path)
