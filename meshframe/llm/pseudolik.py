"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts the symbol of each word of a text from the symbols around it:
the vectors of ``SPAN`` symbols on either side are added, passed through a tanh layer, and a two-level
softmax gives the probability of the symbol's class and of the symbol in its class.  The sum of the
conditional log-probabilities of all words is the score of a text.

The vocabulary is every word of the corpus.  The ``FREQUENT`` most frequent words are symbols of their
own, all others share ``BUCKETS`` symbols by checksum, and a word's probability given its symbol is its
share of the symbol's words in the whole corpus.  So the network has one size, and what grows with the
corpus is a table of counts that no task holds: counts of the ``HEAD`` most frequent words (of up to
``WORD_BYTES`` bytes) are broadcast, and the words of a text beyond them are joined to the table.

The network is written in numpy and trained on all texts once, in ``ROUNDS`` rounds.  A round takes the
texts of one share by hash; each task goes over its own from the common parameters, in batches, and at
the end of the round parameters and step sizes are averaged over tasks by their numbers of words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import map_batches, needed, store, sum_over_tasks, table

CLASSES = 32
SYMBOLS = CLASSES * CLASSES
BUCKETS = 256
FREQUENT = SYMBOLS - 1 - BUCKETS
HEAD, WORD_BYTES = 1 << 17, 64
SPAN, WIDTH, BATCH, RATE, ROUNDS = 2, 16, 16384, 0.1, 4
CHUNK_WORDS, TABLE_WORDS = 1 << 17, 400_000


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all whole texts; words are runs without ASCII white space.

    A task adds up its words in a table that is sent on when it holds ``TABLE_WORDS``.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter[bytes] = Counter()

        def rows() -> dict:
            return {"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": list(held.values())}

        for batch in batches:
            for x in batch.column(0):
                held.update((x.as_py() or "").encode().split())
                if len(held) > TABLE_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return map_batches(needed(docs, text), run, schema).groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head of the word counts and the words of each bucket; what a task needs of the corpus."""

    def __init__(self, words: list[bytes], n: np.ndarray, in_bucket: np.ndarray) -> None:
        self.words, self.n, self.in_bucket = words, n, in_bucket

    @staticmethod
    def of(counts: DataFrame, head: int = HEAD) -> Vocabulary:
        """Words by falling count; ties in the order of words.

        At most ``head`` of them: where more words share the last count, none of these is in the head.
        """
        short = counts.where(F.octet_length("word") <= WORD_BYTES)
        # how many words there are of each count, with few steps between large ones: a bounded number of rows
        kind = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2(F.col("n") / 4096) * 256))
        steps = sorted(((r["low"], r["words"]) for r in short.groupBy(kind).agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("words")).collect()), reverse=True)
        inside = [low for (low, _), upto in zip(steps, np.cumsum([w for _, w in steps]), strict=True) if upto <= head]
        found = short.where(F.col("n") >= inside[-1]).collect() if inside else []
        found.sort(key=lambda r: (-r["n"], r["word"].encode()))
        words, n = [r["word"].encode() for r in found], np.array([r["n"] for r in found], np.int64)
        totals = counts.groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect()
        in_bucket = np.zeros(BUCKETS, np.int64)
        for r in totals:  # at most BUCKETS rows
            in_bucket[r["b"]] = r["n"]
        for w, k in zip(words[:FREQUENT], n, strict=False):
            in_bucket[zlib.crc32(w) % BUCKETS] -= k
        return Vocabulary(words, n, in_bucket)

    def plain(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """What a broadcast holds: lists and arrays alone, which a worker that lacks this package can read."""
        return self.words, self.n, self.in_bucket

    def index(self) -> None:
        """Make what look-ups need, in the process that looks up."""
        self.at = {w: i for i, w in enumerate(self.words)}
        self.own = {w: i + 1 for i, w in enumerate(self.words[:FREQUENT])}
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in self.words], np.int64)
        place = np.arange(len(self.words))
        own = place < FREQUENT
        # the last element is for words beyond the head
        self.symbol = np.append(np.where(own, place + 1, 1 + FREQUENT + bucket), 0).astype(np.int32)
        self.bucket_log = np.log(np.maximum(self.in_bucket, 1))
        self.log = np.append(np.where(own, 0.0, np.log(np.maximum(self.n, 1)) - self.bucket_log[bucket]) if len(place) else [], 0.0)
        self.single = np.append(self.n == 1, False)

    def symbols(self, text: str | None) -> np.ndarray:
        """The symbols of a text's words alone."""
        get, first = self.own.get, 1 + FREQUENT
        return np.array([get(w) or first + zlib.crc32(w) % BUCKETS for w in (text or "").encode().split()], np.int32)

    def numbers(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """The symbols of a text's words, their places in the head (-1 beyond it), the words beyond it and their buckets."""
        get = self.at.get
        words = (text or "").encode().split()
        place = np.array([get(w, -1) for w in words], np.int32)
        symbol = self.symbol[place]
        far = np.flatnonzero(place < 0)
        beyond = [words[i] for i in far.tolist()]
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in beyond], np.int64)
        symbol[far] = 1 + FREQUENT + bucket
        return symbol, place, beyond, bucket


class WindowNetwork:
    """The parameters and their training; the order of ``parts`` is fixed, so that they can be averaged."""

    def __init__(self, values: np.ndarray) -> None:
        self.shapes = [(2 * SPAN, SYMBOLS, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, CLASSES), (CLASSES, CLASSES)]
        self.values = np.array(values, np.float32)
        self.parts = self.split(self.values)

    @staticmethod
    def start(vocabulary: Vocabulary) -> WindowNetwork:
        """Small random parameters; the biases are at the frequencies of classes and of symbols in them."""
        net = WindowNetwork(np.zeros(WindowNetwork.size(), np.float32))
        rng = np.random.default_rng(7)
        for p in net.parts:
            if p.ndim > 1:
                p[:] = rng.normal(0, 0.1, p.shape)
        n = np.ones(SYMBOLS)
        own = vocabulary.n[:FREQUENT]
        n[1 : 1 + len(own)] += own
        n[1 + FREQUENT :] += vocabulary.in_bucket
        n = n.reshape(CLASSES, CLASSES)
        net.parts[3][:] = np.log(n.sum(1) / n.sum())
        net.parts[5][:] = np.log(n / n.sum(1, keepdims=True))
        return net

    @staticmethod
    def size() -> int:
        return 2 * SPAN * SYMBOLS * WIDTH + WIDTH + WIDTH * CLASSES + CLASSES + CLASSES * WIDTH * CLASSES + CLASSES * CLASSES

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        """Views of a flat array in the shapes of the parts."""
        parts, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            parts.append(flat[at : at + n].reshape(s))
            at += n
        return parts

    @staticmethod
    def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of several texts in a row, and those around each; beyond a text stands the edge mark 0."""
        edge = np.zeros(SPAN, np.int32)
        row = np.concatenate([x for t in texts for x in (t, edge)] or [edge])
        row = np.concatenate([edge, row])
        at = np.flatnonzero(row)
        around = np.stack([row[at + o] for o in (*range(-SPAN, 0), *range(1, SPAN + 1))])
        return row[at], around

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.parts[0][0][around[0]]
        for table_, a in zip(self.parts[0][1:], around[1:], strict=True):
            total += table_[a]
        return np.tanh(total + self.parts[1])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        """Over the first axis."""
        x -= x.max(0)
        np.exp(x, out=x)
        x /= x.sum(0)
        return x

    @staticmethod
    def _log_softmax(x: np.ndarray) -> np.ndarray:
        """Over the first axis."""
        x -= x.max(0)
        x -= np.log(np.exp(x).sum(0))
        return x

    def log_probabilities(self, word: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of each word given those around it."""
        by = np.argsort((word // CLASSES).astype(np.int8), kind="stable")  # words of a class lie together
        word, around = word[by], around[:, by]
        h = self._hidden(around)
        kind, inner = word // CLASSES, word % CLASSES
        found = self._log_softmax(self.parts[2].T @ h.T + self.parts[3][:, None])[kind, np.arange(len(word))].astype(np.float64)
        ends = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        for c, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if lo < hi:
                logs = self._log_softmax(self.parts[4][c].T @ h[lo:hi].T + self.parts[5][c][:, None])
                found[lo:hi] += logs[inner[lo:hi], np.arange(hi - lo)]
        out = np.empty(len(word))
        out[by] = found
        return out

    def train(self, word: np.ndarray, around: np.ndarray, memory: list[np.ndarray]) -> None:
        """One step of adaptive gradient descent; ``memory`` holds sums of squared gradients."""
        tables, bias, u, c0, v, c1 = self.parts
        n = len(word)
        by = np.argsort((word // CLASSES).astype(np.int8), kind="stable")  # words of a class lie together
        word, around = word[by], around[:, by]
        kind, inner = word // CLASSES, word % CLASSES
        h = self._hidden(around)
        d = self._softmax(u.T @ h.T + c0[:, None])
        d[kind, np.arange(n)] -= 1
        dh = (u @ d).T
        grads = [None, None, h.T @ d.T, d.sum(1), np.zeros_like(v), np.zeros_like(c1)]
        ends = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        for c, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if lo < hi:
                e = self._softmax(v[c].T @ h[lo:hi].T + c1[c][:, None])
                e[inner[lo:hi], np.arange(hi - lo)] -= 1
                grads[4][c], grads[5][c] = h[lo:hi].T @ e.T, e.sum(1)
                dh[lo:hi] += (v[c] @ e).T
        dz = dh * (1 - h * h)
        grads[1] = dz.sum(0)
        grads[0] = np.empty_like(tables)
        columns = dz.T.astype(np.float64)
        for o, a in enumerate(around):
            for j, column in enumerate(columns):
                grads[0][o][:, j] = np.bincount(a, column, SYMBOLS)
        for p, g, m in zip(self.parts, grads, memory, strict=True):
            g /= n
            m += g * g
            p -= RATE * g / (np.sqrt(m) + 1e-6)


def fit(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> WindowNetwork:
    """The network trained on all whole texts of ``docs``, each once; null texts are empty, and without words it stays at its start."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())
    network = WindowNetwork.start(vocabulary)
    held_memory = np.full(network.size(), 1e-8)
    source = needed(docs, text)
    for k in range(rounds):
        values, memory_ = network.values, held_memory

        def run(batches: Iterator[pa.RecordBatch], values: np.ndarray = values, memory_: np.ndarray = memory_) -> tuple[float, np.ndarray] | None:
            vocabulary, net = None, None
            held, n, total = [], 0, 0

            def learn() -> int:
                word, around = net.contexts(held)
                for i in range(0, len(word), BATCH):
                    net.train(word[i : i + BATCH], around[:, i : i + BATCH], memory)
                held.clear()
                return len(word)

            for batch in batches:
                if net is None:
                    vocabulary, net = Vocabulary(*sent.value), WindowNetwork(values)
                    vocabulary.index()
                    flat = memory_.astype(np.float32)
                    memory = net.split(flat)
                for x in batch.column(0):
                    held.append(vocabulary.symbols(x.as_py()))
                    n += len(held[-1])
                    if n >= CHUNK_WORDS:
                        total += learn()
                        n = 0
            if net is not None:
                total += learn()
            return (total, np.concatenate([net.values, flat]).astype(np.float64) * total) if total else None

        share = source.where(F.pmod(F.coalesce(F.xxhash64(f"`{text}`"), F.lit(0)), F.lit(rounds)) == k)
        if found := sum_over_tasks(share, run):
            network, held_memory = WindowNetwork(found[1][: network.size()] / found[0]), found[1][network.size() :] / found[0]
    sent.destroy()
    return network


def score(docs: DataFrame, network: WindowNetwork, vocabulary: Vocabulary, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, log_likelihood, per_word, n_single`` of every row.

    ``n_single`` is how many words of the text stand nowhere else in the corpus, that of ``counts``.  A
    word that ``counts`` lacks counts as one that stands once.  Without words the sum is 0 and the mean
    is null.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary.plain(), network.values))  # HEAD words of bounded length and a fixed number of parameters
    far = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("m", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("single", T.LongType()), T.StructField("far", far)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from xxhash import xxh64_intdigest as digest

        model = None
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            if model is None:
                plain, values = sent.value
                words = Vocabulary(*plain)
                words.index()
                model = WindowNetwork(values)
            sizes, sums, singles, beyond = [], [], [], []
            held, n = [], 0

            def flush() -> None:
                word, around = model.contexts(held)
                found = np.zeros(len(word) + 1)
                for i in range(0, len(word), BATCH):
                    found[i + 1 : i + 1 + BATCH] = model.log_probabilities(word[i : i + BATCH], around[:, i : i + BATCH])
                ends = np.cumsum([len(t) for t in held], dtype=np.int64)
                each = np.cumsum(found)[np.concatenate([[0], ends])]
                sums.extend(np.diff(each).tolist())
                held.clear()

            given = []
            for x in batch.column(1):
                symbol, place, others, bucket = words.numbers(x.as_py())
                sizes.append(len(symbol))
                given.append(float(words.log[place].sum() - words.bucket_log[bucket].sum()))
                singles.append(int(words.single[place].sum()))
                beyond.append(np.unique(np.array([digest(w, 42) for w in others], np.uint64).view(np.int64), return_counts=True))
                held.append(symbol)
                n += len(symbol)
                if n >= CHUNK_WORDS:
                    flush()
                    n = 0
            flush()
            each = [np.concatenate([np.zeros(0, np.int64), *[b[k] for b in beyond]]) for k in (0, 1)]
            pairs = pa.StructArray.from_arrays([pa.array(each[0]), pa.array(each[1].astype(np.int32))], ["h", "m"])
            rest = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(b[0]) for b in beyond]]), pa.int32()), pairs)
            yield {"doc_id": batch.column(0), "row": np.arange(row, row + batch.num_rows), "n_words": sizes, "logs": [a + b for a, b in zip(sums, given, strict=True)], "single": singles, "far": rest}
            row += batch.num_rows

    rows = store(map_batches(needed(docs, doc_id, text), run, schema), "scored")
    sent.destroy()
    # the words beyond the head, each of them rarer than those in it
    each = rows.select("row", F.explode("far").alias("x")).select("row", "x.h", "x.m")
    known = counts.select(F.xxhash64("word").alias("h"), "n")
    n = F.coalesce("n", F.lit(1))
    found = each.join(known, "h", "left").groupBy("row").agg(F.sum(F.col("m") * F.log(n)).alias("_logs"), F.sum(F.when(n == 1, F.col("m")).otherwise(0)).alias("_single"))
    joined = rows.drop("far").join(found, "row", "left")
    total = F.col("logs") + F.coalesce("_logs", F.lit(0.0))
    return joined.select(F.col("doc_id").alias(doc_id), "n_words", total.alias("log_likelihood"), F.try_divide(total, F.col("n_words")).alias("per_word"), (F.col("single") + F.coalesce("_single", F.lit(0))).alias("n_single"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored by a network trained on all of them.

    Null, empty and blank texts: no words, sum 0, null mean.  Repeated rows are trained on and scored
    each; texts of any length count whole.  Null ids stay null, extra columns are left behind, and an
    empty table gives no rows.
    """
    docs = needed(table(spark, sf_dir, "documents"), "doc_id", "text")
    counts = store(count_words(docs), "word-counts")
    vocabulary = Vocabulary.of(counts)
    return score(docs, fit(docs, vocabulary), vocabulary, counts)


QUERIES = {"op7_pseudo_likelihood": op7_pseudo_likelihood}
SQL: dict[str, str] = {}
