"""Token-id files compressed by Re-Pair grammars, one grammar a shard.

A shard holds whole documents in ascending id.  Its ids are rewritten in rounds: the most frequent
adjacent pairs get nonterminals, and every place where such a pair stands is replaced, from left to
right without overlap.  The file has the rules, the length that each rule expands to, and the
sequence that is left.  With the lengths, any range of ids is decoded from the few symbols that
cover it.

The classic algorithm replaces one pair at a time.  Here a round takes all pairs that stand at least
a ``SHARE``-th as often as the most frequent one did, so that a round is a few passes of vector code;
where two pairs of a round overlap, the left one wins.  When no such pair is left, the bound falls
to a ``SHARE``-th of the largest count, and so on until no pair stands ``LEAST`` times.  Counts are
exact: places are first dropped whose pair falls into a hash bin with too few places for any pair to
reach the bound, and the pairs of the others are sorted and counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.bytebpe import definition, in_worker
from meshframe.llm.common import free_name, map_batches, needed, store, table

SHARD_IDS = 1 << 21
SHARE, LEAST, BIN_BITS = 64, 16, 18
# Odd multipliers that spread the bits of a pair over the bins.
_SPREAD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0x2C1B3C6D)]


def _bin_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash bin of each pair of unsigned symbols."""
    h = first * _SPREAD[0]
    h += second * _SPREAD[1]
    h ^= h >> np.uint32(15)
    h *= _SPREAD[2]
    h >>= np.uint32(32 - BIN_BITS)
    return h.astype(np.intp)  # as places are, so that neither counts nor look-ups convert it


def _bins(seq: np.ndarray) -> np.ndarray:
    """A hash bin of the pair at each place but the last."""
    u = seq.view(np.uint32)
    return _bin_of(u[:-1], u[1:])


def _pairs(seq: np.ndarray, places: np.ndarray) -> np.ndarray:
    return seq[places].astype(np.int64) << 32 | seq[places + 1]


def compress(ids: np.ndarray, base: int, least: int = LEAST, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The rules (two symbols each, the first rule is symbol ``base``) and the sequence that is left.

    No pair is left that stands ``least`` times, overlaps counted; ``least`` is 4 or more.
    """
    if least < 4:  # with fewer, all pairs of a round could lose their places to each other
        raise ValueError("least")
    seq = np.ascontiguousarray(ids, np.int32)
    rules, n_rules, bound = [np.zeros((0, 2), np.int32)], 0, None
    while len(seq) > 1:
        bins = _bins(seq)
        in_bin = np.bincount(bins, minlength=1 << BIN_BITS)
        if bound is None:
            bound = max(least, int(in_bin.max()) // share)
        places = np.flatnonzero((in_bin >= bound)[bins])
        key = _pairs(seq, places)
        ordered = np.sort(key)
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), ordered[1:] != ordered[:-1]]))
        found = ordered[begins[np.diff(begins, append=len(key)) >= bound]]
        if not len(found):
            if bound == least:
                break
            bound = max(least, bound // share)
            continue
        # the bin of a place tells its found pair, but where several pairs share the bin
        slot = np.full(1 << BIN_BITS, -1, np.int32)
        slot[_bin_of((found >> 32).astype(np.uint32), (found & 0xFFFFFFFF).astype(np.uint32))] = np.arange(len(found))
        which = slot[bins[places]]
        near = which >= 0
        places, key, which = places[near], key[near], which[near]
        other = np.flatnonzero(found[which] != key)
        which[other] = np.minimum(np.searchsorted(found, key[other]), len(found) - 1)
        hit = found[which] == key
        places, which = places[hit], which[hit]
        opens = np.diff(places, prepend=-2) != 1  # the first place of each run of overlapping pairs
        taken = (places - np.maximum.accumulate(np.where(opens, places, 0))) % 2 == 0
        places, which = places[taken], which[taken]
        # half of all places are taken, so some pair has two of them
        kept = np.bincount(which, minlength=len(found)) >= 2
        number = np.where(kept, np.cumsum(kept) - 1, -1)[which]
        places, number = places[number >= 0], number[number >= 0]
        pair = found[kept]
        rules.append(np.stack([pair >> 32, pair & 0xFFFFFFFF], 1).astype(np.int32))
        seq = seq.copy()
        seq[places] = base + n_rules + number
        stays = np.ones(len(seq), bool)
        stays[places + 1] = False
        seq, n_rules = seq[stays], n_rules + len(pair)
    return np.concatenate(rules), seq


def _steps(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that name no rule of their own run, in order."""
    last, start = rules.max(1, initial=0) - base, 0
    while start < len(rules):
        inner = np.flatnonzero(last[start:] >= start)
        end = start + int(inner[0]) if len(inner) else len(rules)
        yield start, end
        start = end


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.ones(base + len(rules), np.int64)
    for start, end in _steps(rules, base):
        out[base + start : base + end] = out[rules[start:end]].sum(1)
    return out[base:]


def narrow(symbols: np.ndarray, top: int) -> bytes:
    """Numbers up to ``top``: the low 16 bits of all, then a plane of one bit each for every higher bit that ``top`` needs."""
    planes = [np.packbits(symbols >> k & 1, bitorder="little").tobytes() for k in range(16, top.bit_length())]
    return b"".join([(symbols & 0xFFFF).astype("<u2").tobytes(), *planes])


def widen(data: bytes, n: int, top: int) -> np.ndarray:
    """The ``n`` numbers that :func:`narrow` wrote."""
    out, at = np.frombuffer(data, "<u2", n).astype(np.int32), 2 * n
    for k in range(16, top.bit_length()):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n, bitorder="little").astype(np.int32) << k
        at += -(-n // 8)
    return out


class Grammar:
    """Reads ids of a shard: all of them, or a range."""

    def __init__(self, rules: np.ndarray, expanded: np.ndarray, seq: np.ndarray, base: int) -> None:
        self.seq, self.base = seq, base
        self.length = np.concatenate([np.ones(base, np.int64), expanded])
        self.ends = np.cumsum(self.length[seq])
        ends = np.cumsum(self.length)
        self.first = ends - self.length
        self.flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        self.flat[:base] = np.arange(base)
        for start, end in _steps(rules, base):
            self.flat[self.first[base + start] : ends[base + end - 1]] = self._expand(rules[start:end].ravel())

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        n = self.length[seq]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[seq] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def all(self) -> np.ndarray:
        return self._expand(self.seq)

    def range(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``, expanding only the symbols that cover them."""
        lo = int(np.searchsorted(self.ends, start, "right"))
        hi = int(np.searchsorted(self.ends, start + n, "left")) + 1
        before = int(self.ends[lo - 1]) if lo else 0
        return self._expand(self.seq[lo:hi])[start - before : start - before + n]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """Write ids of ``docs`` in ascending ``doc_id`` as compressed shards in the shared folder; gives the files.

    Ranges of ``doc_id`` are sorted each on its own; nulls come first, rows with equal ids lie in any
    order.  A row is a shard: ``part, shard, start`` (ids before it in its part), ``n_ids``,
    ``doc_ids``, ``doc_lengths``, ``rules``, ``rule_lengths``, ``sequence``, ``n_symbols`` in it, ``base``.  With ``special``,
    strings of special tokens have their ids.
    """
    source = needed(docs, doc_id, text)
    tie = free_name(source.columns, "tie")
    # the second key lets rows of one id lie in several ranges
    source = source.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(F.col(f"`{doc_id}`"), F.col(tie)).sortWithinPartitions(F.col(f"`{doc_id}`"), F.col(tie)).drop(tie)
    model = definition(tokenizer_path)
    long, binary = T.LongType(), T.BinaryType()
    schema = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(x, long) for x in ("shard", "start", "n_ids")], T.StructField("doc_ids", T.ArrayType(source.schema[0].dataType)), T.StructField("doc_lengths", T.ArrayType(long, False)), *[T.StructField(x, binary) for x in ("rules", "rule_lengths", "sequence")], T.StructField("n_symbols", long), T.StructField("base", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = in_worker(model, special)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        names, parts, n = [], [], 0
        end = np.array([end_id], np.int32)

        def row() -> dict:
            ids = np.concatenate([x for p in parts for x in (p, end)])
            rules, seq = compress(ids, bpe.size)
            top = bpe.size + len(rules) - 1
            return {"part": [part], "shard": [shard], "start": [start], "n_ids": [len(ids)], "doc_ids": [names], "doc_lengths": [[len(p) + 1 for p in parts]], "rules": [narrow(rules.ravel(), top)], "rule_lengths": [lengths(rules, bpe.size).astype("<u4").tobytes()], "sequence": [narrow(seq, top)], "n_symbols": [len(seq)], "base": [bpe.size]}

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), map(bpe.encode, batch.column(1).to_pylist()), strict=True):
                names.append(name)
                parts.append(ids)
                n += len(ids) + 1
                if n >= shard_ids:
                    yield row()
                    names, parts, shard, start, n = [], [], shard + 1, start + n, 0
        if parts:
            yield row()

    return store(map_batches(source, run, schema), "id-files")


def shard_of(row) -> Grammar:  # noqa: ANN001
    """The reader of a row of the files."""
    n = len(row["rule_lengths"]) // 4
    top = row["base"] + n - 1
    rules = widen(row["rules"], 2 * n, top).reshape(-1, 2)
    return Grammar(rules, np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64), widen(row["sequence"], row["n_symbols"], top), row["base"])


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    # one row for each part, and parts are partitions of the writing stage: few, and of fixed size
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = files.join(F.broadcast(sums), "part").withColumn("start", F.col("start") + F.col("before"))
    names = ["start", "doc_ids", "doc_lengths", "rules", "rule_lengths", "sequence", "n_symbols", "base"]
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())][: 4 + with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
                ids = memoryview(shard_of(row).all().astype("<u4")).cast("B")
                ends = np.cumsum(row["doc_lengths"])
                slices = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), row["doc_lengths"], strict=True)]
                out = {"doc_id": row["doc_ids"], "start": row["start"] + ends - np.array(row["doc_lengths"]), "n_tokens": row["doc_lengths"], "ids_crc32": [zlib.crc32(x) for x in slices]}
                yield out | ({"ids": [bytes(x) for x in slices]} if with_ids else {})

    return map_batches(placed.select(*names), run, schema)


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, written as Re-Pair shards and read back.

    Null and empty texts: the end id alone.  Strings of special tokens have their ids, as in the library
    without further settings; documents are told apart by their lengths.  Repeated rows give repeated
    rows, null ids come first.  A text of any length lies in one shard, extra columns are left behind, and
    an empty table gives no rows.
    """
    import public_tokenizers

    files = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, special=True)
    return read(files, with_ids=False)


QUERIES = {"op10_repair": op10_repair}
SQL: dict[str, str] = {}
