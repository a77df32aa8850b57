"""Keep the vocabulary of a growing corpus: documents, words and estimated distinct words by language and source.

    spark-submit jobs/vocabulary.py --config jobs/vocabulary.json

Reads the files of ``documents`` (``text, lang, source``) as a stream, those that are new since the last run
alone, and ends when it has them all.  A run takes them in batches of ``files_per_batch`` files.  Of each
batch it keeps HyperLogLog registers and counts, under ``output``:

* ``registers``, partitioned by ``batch``: ``lang, source, reg, rank, words, documents``;
* ``report``, partitioned by ``lang``: the counts and the estimate over all batches so far.

Registers unite by their maximum, so texts that come again, in other files, add to the counts and not to
the distinct words; nothing of an old text is read again.  ``checkpoint`` and ``output`` belong together.  A
batch that was stopped is repeated under its number with the same files, and takes the place of what it had
written; the report is made from the registers after the stream has ended, and without new files is the same.

Words are runs of letters and digits (all characters beyond ASCII count), with A-Z in lower case.  A null
or empty language or source is ``und``; null and empty texts are documents without words.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from meshframe.functions.hashing import with_jenkins64
from meshframe.operators import sketch

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_REGISTERS = "lang string, source string, reg int, rank int, words bigint, documents bigint"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(documents: DataFrame) -> DataFrame:
    """``lang, source, word, words, documents`` of each word once a group, and under a null word the documents without any."""
    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    found = F.filter(F.split(low, _BETWEEN), lambda w: w != "")
    key = [F.when(F.col(c) != "", F.col(c)).otherwise("und").alias(c) for c in ("lang", "source")]
    each = documents.select(*key, F.posexplode_outer(found).alias("at", "word"))
    return each.groupBy("lang", "source", "word").agg(F.count("word").alias("words"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("documents"))


def registers(documents: DataFrame, p: sketch.Parameters) -> DataFrame:
    """``lang, source, reg, rank, words, documents`` of a batch; ``reg`` is null for the documents without words."""
    numbered = words(documents).withColumn("number", F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("bigint"))
    hashed = with_jenkins64(numbered, "number", "h")
    reg = F.when(F.col("word").isNotNull(), sketch.register(F.col("h"), p))
    rank = F.when(F.col("word").isNotNull(), sketch.first_set(F.col("h"), p))
    placed = hashed.select("lang", "source", reg.alias("reg"), rank.alias("rank"), "words", "documents")
    return placed.groupBy("lang", "source", "reg").agg(F.max("rank").alias("rank"), F.sum("words").alias("words"), F.sum("documents").alias("documents"))


def report(registers: DataFrame, p: sketch.Parameters) -> DataFrame:
    """``source, documents, words, distinct_words, lang`` of the registers of all batches."""
    one = registers.groupBy("lang", "source", "reg").agg(F.max("rank").alias("rank"), F.sum("words").alias("words"), F.sum("documents").alias("documents"))
    counters = one.select(F.struct("lang", "source").alias("id"), "reg", F.coalesce("rank", F.lit(0)).alias("rank"))
    sizes = sketch.estimate(counters, p).select("id.lang", "id.source", F.round("estimate", 4).alias("distinct_words"))
    counts = one.groupBy("lang", "source").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"))
    return counts.join(sizes, ["lang", "source"]).select("source", "documents", "words", "distinct_words", "lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, rsd: float = 0.05, files_per_batch: int = 1000) -> DataFrame:
    """Take what is new, write the report, and give it read back."""
    p = sketch.Parameters(rsd)
    schema = spark.read.parquet(documents).select("text", "lang", "source").schema
    name = documents.rstrip("/")
    pattern = f"{name[:-1]}[{name[-1]}]"  # a pattern may name a folder of files or a single file, a plain path of a stream only a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    spark.createDataFrame([], _REGISTERS).write.mode("overwrite").parquet(f"{output}/registers/batch=-1")  # so that there is a table before the first file
    taken = 0

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal taken
        path = f"{output}/registers/batch={number}"
        registers(batch, p).write.mode("overwrite").parquet(path)
        new = spark.read.schema(_REGISTERS).parquet(path).agg(F.sum("documents")).first()[0] or 0
        taken += new
        log.info("wrote %s from %s documents", path, new)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %s new documents", documents, taken)
    found = report(spark.read.schema(f"{_REGISTERS}, batch bigint").parquet(f"{output}/registers"), p)
    found.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/report")
    back = spark.read.schema(found.schema).parquet(f"{output}/report")
    log.info("wrote %s/report: %s rows", output, back.count())
    return back


if __name__ == "__main__":
    main(run, __doc__)
