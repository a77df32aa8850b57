"""What the operators of this subpackage share: stored tables, Arrow row mapping, names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meshframe.plans.scratch import cut, release  # noqa: F401

#: Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.
store = cut


BATCH_BYTES = 8 << 20


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``BATCH_BYTES``; a row is never cut."""
    for batch in batches:
        n = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other tasks beside the executor's heap."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` yields dicts of column lists or arrays in the order of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(_small(batches)):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in zip(arrow, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            del columns, arrays
        _give_back()

    return df.mapInArrow(run, schema)


SUM_VALUES, SUM_PARTS = 2048, 64
_SUMS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("values", T.BinaryType())])


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of a group, whose rows are held a batch at a time."""
    weight, total = 0.0, None
    for batch in batches:
        for w, v in zip(batch.column(2), batch.column(3), strict=True):
            x = np.frombuffer(v.as_buffer(), np.float64)
            weight, total = weight + w.as_py(), x.copy() if total is None else total + x
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "weight": [weight], "values": pa.array([total.tobytes()], pa.binary())})


def sum_over_tasks(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], tuple[float, np.ndarray] | None]) -> tuple[float, np.ndarray] | None:
    """The sums of the weights and arrays of numbers that ``fn`` gives for each partition; nothing where it gives nothing.

    Arrays go in blocks, and a block is summed over ``SUM_PARTS`` shares of the tasks and then over the
    shares, so that however many tasks there are, none adds up all of them and the driver gets one array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if (found := fn(batches)) is not None:
            weight, values = found
            part = TaskContext.get().partitionId() % SUM_PARTS
            for at in range(0, len(values), SUM_VALUES):
                yield {"block": [at // SUM_VALUES], "part": [part], "weight": [float(weight)], "values": [values[at : at + SUM_VALUES].astype(np.float64).tobytes()]}

    sums = map_batches(df, run, _SUMS)
    for by in (["block", "part"], ["block"]):
        sums = sums.groupBy(*by).applyInArrow(_summed, _SUMS)
    rows = sorted(sums.collect(), key=lambda r: r["block"])  # a row for SUM_VALUES numbers
    return (rows[0]["weight"], np.concatenate([np.frombuffer(bytes(r["values"])) for r in rows])) if rows else None


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that is not in ``taken``, whatever the letter case."""
    low = {x.lower() for x in taken}
    name = base
    while name.lower() in low:
        name += "_"
    return name


def needed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns of ``df``: extra ones, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))
