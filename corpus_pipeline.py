"""From raw documents to token ids: quality, near duplicates, benchmark leaks, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and gives a frame that is written as Parquet and read again
as the ``docs`` of the next.  All but the last keep the columns of documents, whatever they are
besides ``doc_id`` and ``text``; texts of any length are read whole, and empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshframe.llm import neardup, pieces, quality, suffixes
from meshframe.llm.common import store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; fitted on this input and ``labels``.

    Null and empty texts have the score of the empty text, rows without id never train, repeated rows
    share their fate, and without labels all stay.
    """
    return quality.remove(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 on five-word shingles connect, that of the least id.

    Null, empty and blank texts are in no group and stay; rows without id stay only where no row of their
    group has one, one of them; of rows repeated with their id one stays.
    """
    return neardup.remove(docs, 5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts, repeated rows and rows without id stay as they are."""
    return suffixes.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and the ids of each document that is left; null and empty texts are the end id alone."""
    import public_tokenizers

    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The quality stage is a fitted network and the encoding is a library's: not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, stored = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored = store(stage(spark, docs, sf_dir), name, instead_of=stored)
    return STAGES[-1][1](spark, docs, sf_dir)
