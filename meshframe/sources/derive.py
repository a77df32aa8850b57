"""Graphs, grids, images and points made from the star-schema tables, and the same in DuckDB SQL.

The tables hold none of these; each definition follows columns with dense keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NY = NZ = 5
IMAGE_HEIGHT = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: each part of an order and the part of its next line; repeated edges count each (M1)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` of all parts, with and without edges (M2, M3)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: each user and the user of the next event of the same type and hour."""
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null")


def user_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, i, j, k, v``: parts as a grid of count/25 x 5 x 5 cells, z fastest (M8)."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("cell"),
        F.floor(p / (NY * NZ)).cast("bigint").alias("i"),
        F.pmod(F.floor(p / NZ), F.lit(NY)).cast("bigint").alias("j"),
        F.pmod(p, F.lit(NZ)).alias("k"),
        F.col("p_retailprice").alias("v"),
    )


def grid_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return ((-1 if n is None else n) // (NY * NZ) + 1, NY, NZ)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x, y, argb``: orders as an image of height 100."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    channels = [F.pmod(c, F.lit(256)), F.pmod(o * 7, F.lit(256)), F.pmod(o * 13 + c, F.lit(256)), F.pmod(c * 3, F.lit(256))]
    argb = sum((ch * (1 << s) for ch, s in zip(channels, (24, 16, 8, 0), strict=True)), F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "orders").select(F.floor(o / IMAGE_HEIGHT).cast("bigint").alias("x"), F.pmod(o, F.lit(IMAGE_HEIGHT)).alias("y"), argb.alias("argb"))


def image_width(spark: SparkSession, sf_dir: str) -> int:
    n = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return (-1 if n is None else n) // IMAGE_HEIGHT + 1


def mixed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, n0, n1`` (numbers) and ``c0, c1`` (categories) of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("n0"), F.col("p_retailprice").alias("n1"), F.col("p_brand").alias("c0"), F.col("p_type").alias("c1"))


#: The same relations as DuckDB CTEs.
SQL = {
    "part_edges": "part_edges as (select * from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) dst from lineitem) where dst is not null)",
    "user_edges": "user_edges as (select * from (select user_id src, lead(user_id) over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) dst from events) where dst is not null)",
    "part_vertices": "part_vertices as (select p_partkey id from part)",
    "user_vertices": "user_vertices as (select distinct user_id id from events)",
    "grid": "grid as (select p_partkey cell, p_partkey // 25 i, (p_partkey // 5) % 5 j, p_partkey % 5 k, p_retailprice v from part)",
    "pixels": "pixels as (select o_orderkey // 100 x, o_orderkey % 100 y, (o_custkey % 256) * 16777216 + ((o_orderkey * 7) % 256) * 65536 + ((o_orderkey * 13 + o_custkey) % 256) * 256 + (o_custkey * 3) % 256 argb from orders)",
    "points": "points as (select p_partkey id, p_size::double n0, p_retailprice n1, p_brand c0, p_type c1 from part)",
}
