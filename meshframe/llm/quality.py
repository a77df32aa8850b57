"""A quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning with the non-negative risk estimator: for a class prior ``p``, a model
``g`` and the sigmoid loss, the risk is ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))``.
The part in the maximum estimates the risk on negatives that nobody labelled; where it falls below
zero the model overfits, and its gradient is turned round, as in the published training rule.

Known negatives are used for one number only: the prior is estimated as the share of label 1 among
the labelled rows of the training folds.

The model is a network with one hidden layer over counts of characters, words and lines of the whole
text and over its runs of four bytes and its words, hashed to ``GRAMS`` classes each.  Positives are a
sample of at most ``POSITIVES`` labelled rows, the least by a hash of the id.  The network starts from a
fit on the driver to them and ``START`` unlabelled rows, and then takes ``STEPS_OVER_ALL`` steps whose
risk and gradient are summed over all documents of the training folds, whether labelled or not.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import fold_of, free_name, map_batches, needed, store, sum_over_tasks, table

POSITIVES, START, GRAMS = 10_000, 20_000, 128
GRAM_WEIGHT = 0.05  # of hashed classes beside the other features: they are many, and few labels would fit them by chance
HIDDEN, STEPS, STEPS_OVER_ALL, RATE, RATE_OVER_ALL, DECAY = 16, 600, 16, 0.02, 0.005, 1e-5
THRESHOLD = 0.3

_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]


def describe(text: str | None) -> list[float]:
    """The features of a whole text; null is the empty text."""
    data = (text or "").encode()
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    w, m = max(1, len(words)), max(1, len(lines))
    again = sum(map(operator.eq, words, words[1:]))
    kinds = [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[32], counts[10], counts[128:].sum(), counts[:9].sum() + counts[11:32].sum() + counts[127]]
    shares = np.array([*[counts[b] for b in _SIGNS], *kinds]) / n
    rest = [np.log1p(len(data)), np.log1p(len(words)), len(set(words)) / w, len(set(lines)) / m, len(data) / w, len(words) / m]
    rest[4:] = np.log1p(rest[4:]).tolist()
    return [*np.log1p(200 * shares).tolist(), *rest, np.log1p(100 * again / w), *_hashed(data.lower())]


def _hashed(data: bytes) -> list[float]:
    """Shares of the classes of runs of four bytes, and of the classes of words."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(2 * GRAMS)
    if len(x) > 3:
        h = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        out[:GRAMS] = np.bincount(((h ^ h >> np.uint32(12)) % np.uint32(GRAMS)).view(np.int32), minlength=GRAMS) / len(h)
    if words := data.split():
        out[GRAMS:] = np.bincount(np.array([zlib.crc32(w) for w in words], np.int64) % GRAMS, minlength=GRAMS) / len(words)
    return np.log1p(50 * out).tolist()


N_FEATURES = len(_SIGNS) + 7 + 7 + 2 * GRAMS


class Network:
    """One hidden layer; fitted with the non-negative positive-unlabelled risk."""

    def _sums(self, x: np.ndarray) -> np.ndarray:
        """The loss of calling rows negative, and its gradient, both summed over scaled rows.

        That loss is the score ``p`` itself, and that of calling a row positive is ``1 - p``: both are
        bounded, so an error in the prior costs little however sure the model is of positives.
        """
        h = np.tanh(x @ self.w[0] + self.w[1])
        p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]).clip(-30, 30)))
        d = p * (1 - p)
        back = np.outer(d, self.w[2]) * (1 - h * h)
        return np.concatenate([[p.sum()], (x.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]]).astype(np.float64)

    def gradient(self, positives: np.ndarray, prior: float, n: float, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """The estimate of the risk on negatives, and the gradient of the training rule.

        ``sums`` are those of :meth:`_sums` over the ``n`` rows without labels.  Where the estimate is
        below zero, its own gradient is turned round.
        """
        known = prior * self._sums(positives) / len(positives)
        hidden = sums / n - known
        return hidden[0], (hidden[1:] if hidden[0] >= 0 else -hidden[1:]) - (known[1:] if hidden[0] >= 0 else 0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = ((x - self.mean) / self.scale).clip(-20, 20)
        x[:, -2 * GRAMS :] *= GRAM_WEIGHT
        return x

    def _descend(self, gradient: np.ndarray, step: int, rate: float) -> None:
        """One step of Adam, with decay of the weights."""
        at = 0
        for i, (v, a, b) in enumerate(zip(self.w, self.first, self.second, strict=True)):
            g = gradient[at : at + v.size].reshape(v.shape) + (DECAY * v if i in (0, 2) else 0)
            at += v.size
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def fit(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
        """From small random weights, ``STEPS`` steps over both samples."""
        both = np.concatenate([positives, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = self.scaled(positives), self.scaled(unlabelled)
        rng = np.random.default_rng(1)
        self.w = [rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.array([np.log(prior / (1 - prior))])]
        self.first, self.second = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        for step in range(1, STEPS + 1):
            self._descend(self.gradient(p, prior, len(u), self._sums(u))[1], step, RATE)
        return self

    def go_on(self, positives: np.ndarray, rows: DataFrame, prior: float, steps: int = STEPS_OVER_ALL) -> Network:
        """``steps`` steps over the positives and all of ``rows`` (``features``)."""
        p = self.scaled(positives)
        for step in range(STEPS + 1, STEPS + 1 + steps):
            model = self

            def run(batches: Iterator[pa.RecordBatch], model: Network = model) -> tuple[float, np.ndarray] | None:
                n, total = 0, 0.0
                for batch in batches:
                    if batch.num_rows:
                        x = np.array(batch.column(0).flatten(), np.float64).reshape(-1, N_FEATURES)
                        n, total = n + len(x), total + model._sums(model.scaled(x))
                return (n, total) if n else None

            if found := sum_over_tasks(rows.select("features"), run):
                self._descend(self.gradient(p, prior, *found)[1], step, RATE_OVER_ALL)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(self.scaled(x) @ self.w[0] + self.w[1])
        return 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]).clip(-30, 30)))


class Constant:
    """The model where positives or unlabelled rows are lacking: the prior, or 1 without any label."""

    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def described(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """``docs`` without its text, with an array of features."""
    keep = [c for c in docs.columns if c not in (text, out)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.FloatType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(keep)}
            values = np.array([describe(x.as_py()) for x in batch.column(len(keep))], np.float32).reshape(batch.num_rows, N_FEATURES)
            columns[out] = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, N_FEATURES, dtype=np.int32)), pa.array(values.ravel()))
            yield columns

    return map_batches(source, run, schema)


def fit(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, start: int = START) -> Network | Constant:
    """A model from ``rows`` (``doc_id, features``) and ``labels`` (``doc_id, quality``), training folds alone.

    A document with several labels is positive if all are 1; null labels and null ids are left out, as
    are documents without an id.  ``positives`` bounds the labelled rows that are used, ``start`` the
    unlabelled ones of the first fit alone.  Unlabelled documents that repeat count each, positives once.
    """
    train = fold_of(F.col("doc_id")) != 0
    known = needed(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(train)
    known = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    candidates = rows.where("doc_id is not null").where(train)

    def some(df: DataFrame, by: Column, most: int) -> DataFrame:
        """The ``most`` rows of the least hash ``by``; what is sorted has about half as many more, whatever the size of the table."""
        share = min(1.0, 1.5 * most / max(1, df.count()))
        hashed = free_name(df.columns, "hash")
        below = df.withColumn(hashed, by)
        below = below if share == 1 else below.where(F.col(hashed) < int(share * 2**64) - 2**63)
        return below.orderBy(hashed).limit(most).drop(hashed)

    def matrix(df: DataFrame) -> np.ndarray:
        held = df.select("features").toArrow().column(0).combine_chunks()
        return np.array(held.flatten(), np.float32).reshape(-1, N_FEATURES)

    # documents are sampled from the labels alone, which are lighter, and each is one row, however often it repeats
    wanted = some(known.where("good").select("doc_id"), F.xxhash64("doc_id"), positives)
    p = matrix(candidates.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"]))
    u = matrix(some(candidates, F.xxhash64("doc_id", F.monotonically_increasing_id()), start))
    if share is None or not len(p) or not len(u) or share == 1:
        return Constant(1.0 if share is None else share)
    prior = min(share, 0.99)
    return Network().fit(p, u, prior).go_on(p, candidates, prior)


def score(rows: DataFrame, model: Network | Constant, out: str = "score") -> DataFrame:
    """``rows`` with a score from 0 to 1 in place of their features; higher is likelier good."""
    keep = [c for c in rows.columns if c not in ("features", out)]
    source = rows.select(*[F.col(f"`{c}`") for c in keep], "features")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(keep)}
            columns[out] = model.score(np.array(batch.column(len(keep)).flatten(), np.float64).reshape(-1, N_FEATURES))
            yield columns

    return map_batches(source, run, schema)


def remove(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` whose score reaches ``threshold``, all columns as they are.

    Null and empty texts have the score of the empty text, texts of any length are described whole, and
    repeated rows are scored each.  Without labels every row stays.
    """
    rows = store(described(docs.select(F.col("`doc_id`"), F.col(f"`{text}`")), text), "described")
    model = fit(rows, labels)
    scored = free_name(docs.columns, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(scored, T.DoubleType(), False)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = np.array([describe(t.as_py()) for t in batch.column(at)], np.float32).reshape(batch.num_rows, N_FEATURES)
            yield {**{i: batch.column(i) for i in range(batch.num_columns)}, "score": model.score(x.astype(np.float64))}

    return map_batches(docs, run, schema).where(F.col(scored) >= threshold).drop(scored)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored; null and empty texts get the score of the empty text.

    Rows with a null id never train (their remainder is that of the empty text), repeated rows are scored
    each and alike, texts of any length count whole.  Extra columns are left behind; without labels every
    score is 1, and an empty table gives no rows.
    """
    rows = store(described(needed(table(spark, sf_dir, "documents"), "doc_id", "text")), "described")
    model = fit(rows, table(spark, sf_dir, "labels"))
    scored = score(rows, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
