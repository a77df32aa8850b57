"""SentencePiece encoding and decoding through a table of distinct marked chunks.

In a vocabulary whose pieces hold the whitespace marker only at their start, no merge crosses from a
letter to a marker.  A text therefore falls apart into chunks, each a run of markers and the letters
up to the next marker, and the ids of a text are the ids of its chunks in order.  Text is invented
from few distinct chunks: those of a batch of texts are numbered, each distinct one is looked up in a
table or else segmented by the library, and the ids are joined back to all places by their numbers.

The table lives in a task and has two generations; when the young one holds ``TABLE_CHUNKS`` chunks or
``TABLE_CHARS`` new characters, it takes the place of the old one, so memory does not grow with the
vocabulary of the corpus and frequent chunks stay.  No row is shuffled: for a table
of the whole corpus, the distinct chunks of every task would cross the network to be made one, and
again with their ids to reach the texts, which would cross it too to meet them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import free_name, map_batches, needed, table

TABLE_CHUNKS, TABLE_CHARS = 200_000, 8_000_000
MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")


class ChunkEncoder:
    """Ids of whole texts, equal to the library's ``encode(text)``, by the table of distinct chunks."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        probe = " a  b " + MARK + "c"
        if self.sp.decode(self.sp.encode(probe)) != probe.replace(MARK, " "):
            raise ValueError("this model changes texts before it segments them")
        self.table: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.chars = 0

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each starting with its markers written as spaces."""
        text = " " + text.replace(MARK, " ")
        if "  " in text or text[-1] == " ":
            return _CHUNK.findall(text)
        return text.split(" ")[1:]

    def look_up(self, chunks: list[str]) -> list[list[int]]:
        """The ids of distinct chunks; those that the table lacks are segmented.

        A full table becomes the old one, from which chunks that are met again are taken back.
        """
        found, old = self.table, self.old
        found.update((c, old[c]) for c in chunks if c not in found and c in old)
        if missing := [c for c in chunks if c not in found]:
            # the library puts one marker in front of each chunk, so one is left out here
            bare = [c[1:] if c[0] == " " else c for c in missing]
            found.update(zip(missing, self.sp.encode(bare, num_threads=1), strict=True))
            if " " in found:  # a lone marker: the library gives nothing for an empty text
                found[" "] = [self.sp.piece_to_id(MARK)]
            self.chars += sum(map(len, missing))
        ids = [found[c] for c in chunks]
        if len(found) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.table, self.old, self.chars = {}, found, 0
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is the empty text."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        plain = pc.and_not(pc.greater(pc.binary_length(texts), 0), odd)
        # texts with single blanks between words fall apart without a look at each word
        words = pc.split_pattern(texts.filter(plain).cast(pa.large_string()), " ")
        numbered = words.flatten().dictionary_encode()
        chunks, number = [" " + w for w in numbered.dictionary.to_pylist()], numbered.indices.to_numpy()
        sizes = [np.diff(words.offsets.to_numpy())]
        numbers = [number]
        # in the others, runs of blanks belong to chunks
        place = {c: i for i, c in enumerate(chunks)}
        for t in texts.filter(odd).to_pylist():
            own = self.chunks(t)
            numbers.append(np.array([place.setdefault(c, len(place)) for c in own], number.dtype))
            sizes.append(np.array([len(own)]))
        ids = self.look_up(list(place))
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        first, at = np.cumsum(n) - n, np.concatenate(numbers)
        ends = np.cumsum(n[at])
        out = flat[np.repeat(first[at] - ends + n[at], n[at]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], *sizes]))]
        found = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kinds = [plain.to_numpy(zero_copy_only=False), odd.to_numpy(zero_copy_only=False)]
        each = [np.zeros(0, np.int32)] * len(texts)
        for i, x in zip(np.concatenate([np.flatnonzero(k) for k in kinds]).tolist(), found, strict=True):
            each[i] = x
        return each


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encode_fn(model: bytes, end_id: int | None, end_from_model: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = ChunkEncoder(model)
        end = encoder.sp.eos_id() if end_from_model else end_id
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            last = np.array([] if end is None else [end], np.int32)
            values = [np.append(ids, last) for ids in encoder.encode_all(batch.column(batch.num_columns - 1))]
            offsets = np.cumsum([0, *map(len, values)])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))
            yield columns

    return run


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", end_id: int | None = None) -> DataFrame:
    """``df`` with a column ``ids`` (array of int) in place of an older column of that name.

    The ids are those of the library's ``encode(text)``; the model's end id, or ``end_id``, follows.
    Null and empty texts give the end id alone.  All other columns stay, repeated rows stay repeated.
    """
    model = model_bytes(model_path)
    keep = [c for c in df.columns if c.lower() != ids.lower()]
    spare = free_name([*df.columns, ids], "encoded_text")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(spare))
    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    return map_batches(source, _encode_fn(model, end_id, end_id is None), schema).drop(spare)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text`` in place of an older one: the library's ``decode`` of each row's ids; null ids decode to the empty text."""
    model = model_bytes(model_path)
    keep = [c for c in df.columns if c.lower() != text.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    if ids not in keep:
        raise ValueError(f"no column {ids} that is not also the result")
    at = keep.index(ids)
    schema = T.StructType([*source.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            columns[text] = [sp.decode(x.as_py() or []) for x in batch.column(at)]
            yield columns

    return map_batches(source, run, schema)


def encoded(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` of each whole text.

    Encoding, decoding and digests are one pass, so that without ``with_ids`` no ids leave the task.
    Null and empty texts are the end id alone.
    """
    model = model_bytes(model_path)
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))][: 4 + with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = ChunkEncoder(model)
        end = encoder.sp.eos_id()
        decimal = [str(i) for i in range(encoder.sp.get_piece_size())]
        for batch in batches:
            n, ids_sha, decoded_sha, all_ids = [], [], [], []
            for values in encoder.encode_all(batch.column(1)):
                ids = [*values.tolist(), end]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(encoder.sp.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.append(values, np.int32(end)))
            yield {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha} | ({"ids": all_ids} if with_ids else {})

    return map_batches(needed(docs, "doc_id", "text"), run, schema)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as ids with an end id, and decoded again.

    Null and empty texts: one id, and the empty text.  Repeated rows give repeated rows, null ids stay.
    Texts of any length are encoded whole, extra columns are left behind, and an empty table gives no rows.
    """
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


QUERIES = {"op2_pieces": op2_pieces}
SQL: dict[str, str] = {}
