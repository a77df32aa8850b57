"""HyperLogLog counters kept by key over a stream, in the state of an operator.

The state of a key is its registers in parts of ``PART``, so that the rows of a hot key are united by
many tasks; before they are dealt, tasks unite what they read, and send at most a row a register and
batch of rows.  Only registers that grew leave the operator: a stream of values that were seen
before gives no rows, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meshframe.functions.hashing import with_jenkins64
from meshframe.operators.sketch import PART, Parameters, first_set, register, union

_ROW = "id string, reg int, rank int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GrownRegisters(StatefulProcessor):
    """State: the ranks of a part of a key's registers.  Output: ``id, reg, rank`` of those that a micro-batch raised."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._ranks = handle.getValueState("ranks", "ranks array<int>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803, ARG002
        before = list(self._ranks.get()[0]) if self._ranks.exists() else [-1] * PART
        after = before.copy()
        for frame in rows:
            for reg, rank in zip(frame["reg"] % PART, frame["rank"], strict=True):
                after[reg] = max(after[reg], int(rank))
        grown = [i for i in range(PART) if after[i] > before[i]]
        if grown:
            self._ranks.update((after,))
            first = int(key[1]) * PART
            yield pd.DataFrame({"id": [key[0]] * len(grown), "reg": pd.Series([first + i for i in grown], dtype="int32"), "rank": pd.Series([after[i] for i in grown], dtype="int32")})

    def close(self) -> None:
        pass


def grown(stream: DataFrame, key: str, value: str, p: Parameters) -> DataFrame:
    """``id, reg, rank`` of registers that grow as ``stream`` goes on: counters of distinct ``value`` (whole numbers) by ``key``.

    A row whose key or value is null counts nowhere.  ``union`` of all rows so far gives the counters.
    """

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(["id", "reg"], as_index=False, sort=False)["rank"].max()

    named = stream.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{value}`").cast("bigint").alias("number")).where("id is not null and number is not null")
    hashed = with_jenkins64(named, "number", "h")
    rows = hashed.select("id", register(F.col("h"), p).alias("reg"), first_set(F.col("h"), p).alias("rank")).mapInPandas(united, _ROW)
    parts = rows.withColumn("part", F.floor(F.col("reg") / PART).cast("int")).groupBy("id", "part")
    return parts.transformWithStateInPandas(statefulProcessor=GrownRegisters(), outputStructType=_ROW, outputMode="Update", timeMode="None")


def run_available(spark: SparkSession, source: str, key: str, value: str, p: Parameters, base: str, files_per_batch: int = 1000) -> DataFrame:
    """``id, reg, rank`` of all files of ``source`` so far, of which a run reads those that are new.

    ``base`` holds the checkpoint with the state, and ``grown`` of each micro-batch in a folder of its
    number: a batch that was stopped is repeated under that number and takes the place of what it had
    written.  The state store is RocksDB while the stream runs; the setting of the session comes back.
    """
    schema = spark.read.parquet(source).schema
    name = source.rstrip("/")
    pattern = f"{name[:-1]}[{name[-1]}]"  # a pattern may name a folder of files or a single file, a plain path of a stream only a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    spark.createDataFrame([], _ROW).write.mode("overwrite").parquet(f"{base}/grown/batch=-1")  # so that there is a table before the first file

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/grown/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        writer = grown(stream, key, value, p).writeStream.outputMode("update").foreachBatch(save)
        writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return union(spark.read.schema(f"{_ROW}, batch bigint").parquet(f"{base}/grown"))
