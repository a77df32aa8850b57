"""Degrees kept up to date over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.plans.scratch import new_path


def event_counts(stream: DataFrame) -> DataFrame:
    """``user_id, events, total`` of a stream or table of events."""
    return stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def run_available(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The counts after the files of table ``name`` were read as a stream; state and result lie in the shared folder.

    The table is a file of ``directory`` or a folder in it.
    """
    schema = spark.read.parquet(f"{directory}/{name}").schema
    base = new_path(spark, "event-counts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{directory}/{name}") if status.isDirectory() else reader.option("pathGlobFilter", name).parquet(directory)
    counts = event_counts(stream)

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    query = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{base}/result")
