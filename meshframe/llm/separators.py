"""Token counts by scanning flat token streams for separators.

A stream is ids and nothing else: little-endian numbers of one width, each document followed by the
end-of-document id.  It is read in blocks that know nothing of documents.  Each block is searched
for the separator with one vector comparison; a prefix scan over the blocks' small summaries (ids,
separators, place of the last separator) then gives every block the document that is open at its
start, and the boundary that falls between blocks is stitched from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.bytebpe import ByteBpe, definition, in_worker
from meshframe.llm.common import map_batches, needed, store, table

BLOCK_IDS = 1 << 19

STREAM_SCHEMA = "stream int, block long, payload binary"


def write_streams(docs: DataFrame, tokenizer_path: str, block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenize ``docs`` into one flat stream a partition, in the shared folder.

    Returns the blocks ``(stream, block, payload)`` and the list of documents ``(stream, ordinal,
    doc_id)``, which has the order of documents and no lengths.  Null texts are empty documents.
    """
    source = needed(docs, doc_id, text)
    model = definition(tokenizer_path)
    schema = T.StructType([T.StructField("stream", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("first_ordinal", T.LongType()), T.StructField("doc_ids", T.ArrayType(source.schema[0].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = in_worker(model)
        end = bpe.special["<|endoftext|>"]
        width = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        stream = TaskContext.get().partitionId()
        end_of_document = np.array([end], width)
        open_parts, n_open, block, ordinal = [], 0, 0, 0

        def payload(at: int, data: np.ndarray) -> dict:
            return {"stream": [stream], "block": [at], "payload": [data.tobytes()], "first_ordinal": [None], "doc_ids": [None]}

        for batch in batches:
            for x in batch.column(1):
                ids = bpe.encode(x.as_py()).astype(width)
                open_parts += [ids, end_of_document]
                n_open += len(ids) + 1
                if n_open >= block_ids:
                    data = np.concatenate(open_parts)
                    whole = n_open // block_ids * block_ids
                    for i in range(0, whole, block_ids):
                        yield payload(block, data[i : i + block_ids])
                        block += 1
                    open_parts, n_open = [data[whole:].copy()], n_open - whole
            if batch.num_rows:
                yield {"stream": [stream], "block": [None], "payload": [None], "first_ordinal": [ordinal], "doc_ids": [batch.column(0).to_pylist()]}
                ordinal += batch.num_rows
        if n_open:
            yield payload(block, np.concatenate(open_parts))

    stored = store(map_batches(source, run, schema), "token-streams")
    blocks = stored.where("payload is not null").select("stream", "block", "payload")
    listed = stored.where("payload is null").select("stream", "first_ordinal", F.posexplode("doc_ids").alias("at", "doc_id"))
    return blocks, listed.select("stream", (F.col("first_ordinal") + F.col("at")).alias("ordinal"), "doc_id")


def flat_file_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks ``stream, block, payload`` of flat files of any size that another program wrote; a file is one stream.

    ``path`` is a file, or a folder whose files are taken, on a file system that pyarrow and all executors
    can open.  The streams are numbered by path, and empty files have no blocks.  The driver lists the
    files; a task reads the byte ranges of its blocks and nothing else.  A file whose size is no multiple
    of ``width`` is an error.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = system.get_file_info(at)
    files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File)
    if bad := [p for p, n in files if n % width]:
        raise ValueError(f"{bad[0]}: its size is no multiple of {width}")
    scheme = path.split("://")[0] if "://" in path else "file"
    step = block_ids * width
    listed = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(files) if n], "stream int, path string, size long")
    blocks = listed.select("stream", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {step}L"))).alias("block"))
    blocks = blocks.repartition("path", "block")
    schema = T.StructType([T.StructField("stream", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow import fs

        for batch in batches:
            for stream, name, size, block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                system, at = fs.FileSystem.from_uri(f"{scheme}://{name}")
                with system.open_input_file(at) as f:
                    yield {"stream": [stream], "block": [block], "payload": [f.read_at(min(step, size - block * step), block * step)]}

    return map_batches(blocks, run, schema)


def scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """The documents of flat streams: ``stream, ordinal, start, n_tokens, terminated``.

    ``n_tokens`` leaves out the separator, ``start`` is the place of the first id in the stream.
    Ids after a stream's last separator are a document that is not terminated; an empty stream or an
    empty table has none.  Adjacent separators give a document of no tokens.
    """
    kind = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}[width]
    schema = T.StructType([T.StructField("stream", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ends", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"stream": batch.column(0), "block": batch.column(1), "n_ids": [], "ends": []}
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), kind)
                out["n_ids"].append(len(ids))
                out["ends"].append(np.flatnonzero(ids == separator).astype(np.int32))
            yield out

    found = store(map_batches(blocks.select("stream", "block", "payload"), run, schema), "separators")
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    light = found.select("stream", "block", "n_ids", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = (
        light.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("ordinal0", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("last_end", F.col("base") + F.col("last"))
        .withColumn("open_from", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
    )
    joined = found.join(carried.select("stream", "block", "base", "ordinal0", "open_from"), ["stream", "block"])
    ends = joined.select("stream", "ordinal0", "open_from", F.transform("ends", lambda e: F.col("base") + e).alias("ends"))
    starts = F.concat(F.array("open_from"), F.transform("ends", lambda e: e + 1))
    each = ends.select("stream", "ordinal0", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size("ends")).alias("start"), F.col("ends").alias("end"))).alias("at", "doc"))
    closed = each.select("stream", (F.col("ordinal0") + F.col("at")).alias("ordinal"), F.col("doc.start").alias("start"), (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = carried.groupBy("stream").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last_end") + 1, F.lit(0)).alias("start"))
    rest = rest.where("n_ids > start").select("stream", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(rest)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``, counted from flat streams.

    ``n_tokens`` is without the end id.  Null and empty texts have 0 tokens, and strings of special
    tokens are ordinary text, so that no text can forge a boundary.  Repeated rows and null ids stay as
    they are, since a document is known by its place in a stream.  Texts of any length go over as many
    blocks as they need; extra columns are left behind, and an empty table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    blocks, listed = write_streams(table(spark, sf_dir, "documents"), path)
    bpe = ByteBpe(definition(path))
    counted = scan(blocks, bpe.special["<|endoftext|>"], 2 if bpe.size <= 1 << 16 else 4)
    return counted.join(listed, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "ordinal", "start", "terminated")


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
