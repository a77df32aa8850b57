"""Language identification by interpolated Kneser-Ney models of characters.

A word is a run of letters and marks, in lower case, with a blank on either side; contexts do not reach over
the blanks, and runs of over ``LONGEST`` letters (as in scripts without blanks) are cut.  Each language has
a model of ``ORDER`` characters: raw counts at the highest order and for grams that start a word, numbers of
distinct characters to the left below it, one discount an order.  A model is a sorted array of 64-bit
hashes an order, with the logarithms of the probability and of the back-off weight beside it.  A text's
language is that of the lowest cross-entropy a character.

Counting, calibration and scoring are passes of Spark over the table.  Models come from a sample of the
labelled rows of about ``SAMPLE`` characters a language and ``SAMPLES`` in all, which bounds what is
broadcast: an array entry is 16 bytes, and a character makes at most ``ORDER`` of them.  Rows of up to
``WHOLE`` characters are taken or left as they are, longer ones by stretches.  Other labelled rows, about
``CALIBRATION`` a language, fit the confidence: a logistic curve over the margin to the second language
and the length, and for each language the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import map_batches, needed, store, table

ORDER, LONGEST = 5, 64
SAMPLE, SAMPLES, WHOLE = 1 << 20, 1 << 22, 1 << 16
CALIBRATION = 4000
STRETCH = 50_000  # words of a text that are held at once
CACHED = 250_000  # words whose scores a task keeps
REJECTED_SHARE = 0.001  # of calibration texts of a language that its bound on cross-entropy rejects
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (LONGEST - 1))


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a whole text, at most ``STRETCH`` at once where it is long."""
    text = text.lower()
    if len(text) <= 2 * STRETCH:
        if found := _WORD.findall(text):
            yield found
        return
    found = (m[0] for m in _WORD.finditer(text))
    while held := list(islice(found, STRETCH)):
        yield held


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null without an id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with a blank before each and one at the end, the longest gram at each place (0: none), and the word of each place.

    The blank after a word is its last character, and the start of the next.
    """
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blanks = np.flatnonzero(code == 32)
    before = np.repeat(blanks[:-1], np.diff(blanks))  # for places 1 and on: the blank that starts the word
    since = np.arange(1, len(code)) - before
    longest = np.concatenate([[0], np.minimum(since + 1, ORDER)])
    return code, longest, np.concatenate([[0], np.repeat(np.arange(len(words)), np.diff(blanks))])


def _hashes(code: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the gram that ends at each place; the first places of an order are not used."""
    out = [(code + np.uint64(1)) * _BASE]
    for n in range(1, ORDER):
        longer = out[0].copy()
        longer[1:] += out[-1][:-1] * np.uint64(0xD1342543DE82EF95 + 2 * n)
        longer ^= longer >> np.uint64(29)
        out.append(longer)
    return out


@dataclass
class Level:
    """One order of a model: sorted hashes, log probabilities, and log back-off weights of the grams as contexts."""

    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arrays, and which are found."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def model_of(words: list[str], counts: np.ndarray) -> tuple[list[Level], float]:
    """The levels of a model of distinct words with their counts, and the log probability of a character never seen."""
    code, longest, word = _laid_out(words)
    hashes, weight = _hashes(code), np.asarray(counts, np.float64)[word]
    levels, firsts, numbers = [], [], []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(longest >= n)
        keys, first, inverse = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
        levels.append(keys)
        firsts.append(at[first])
        numbers.append(np.bincount(inverse, weights=weight[at], minlength=len(keys)))
    for n in range(ORDER - 1, 0, -1):  # below the highest order: distinct characters to the left, but for grams that start a word
        shorter = np.searchsorted(levels[n - 1], hashes[n - 1][firsts[n]])
        left = np.bincount(shorter, minlength=len(levels[n - 1])).astype(np.float64)
        starts = longest[firsts[n - 1]] == n if n > 1 else np.zeros(len(left), bool)
        numbers[n - 1] = np.where(starts | (left == 0), numbers[n - 1], left)
    backs = [np.zeros(len(k)) for k in levels]
    c, total, kinds = numbers[0], numbers[0].sum(), len(levels[0])
    d = _discount(c)
    none = d * kinds / total / (kinds + 1)
    p = [(c - d) / total + none]
    for n in range(2, ORDER + 1):
        c, first, d = numbers[n - 1], firsts[n - 1], _discount(numbers[n - 1])
        context = np.searchsorted(levels[n - 2], hashes[n - 2][first - 1])
        total = np.bincount(context, weights=c, minlength=len(levels[n - 2]))
        share = d * np.bincount(context, minlength=len(levels[n - 2])) / np.maximum(total, 1e-300)
        lower = p[-1][np.searchsorted(levels[n - 2], hashes[n - 2][first])]
        p.append(np.maximum(c - d, 0) / total[context] + share[context] * lower)
        backs[n - 2] = np.where(total > 0, np.log(np.where(total > 0, share, 1)), 0)
    return [Level(k, np.log(x).astype(np.float32), b.astype(np.float32)) for k, x, b in zip(levels, p, backs, strict=True)], float(math.log(none))


@dataclass
class Models:
    """Models of several languages with their calibration; what is sent to tasks is :meth:`plain`."""

    langs: list[str]
    levels: list[list[Level]]
    none: list[float]
    curve: tuple[float, float, float] = (0.0, 2.0, 0.0)  # confidence: constant, of the margin, of margin times log length
    bounds: tuple[float, ...] = ()

    def plain(self) -> tuple:
        """Lists and arrays alone, so that a worker that lacks this package can read a broadcast of it."""
        return self.langs, [[(x.keys, x.logp, x.back) for x in own] for own in self.levels], self.none, self.curve, self.bounds

    @staticmethod
    def from_plain(x: tuple) -> Models:
        return Models(x[0], [[Level(*y) for y in own] for own in x[1]], *x[2:])

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row a word: log probabilities by language, then the number of characters, its end included."""
        code, longest, word = _laid_out(words)
        hashes = _hashes(code)
        key = np.zeros(len(code), np.uint64)
        for n in range(1, ORDER + 1):
            at = longest == n
            key[at] = hashes[n - 1][at] + np.uint64(n)
        place = np.arange(1, len(code))
        _, first, inverse = np.unique(key[1:], return_index=True, return_inverse=True)
        grams, most = place[first], longest[place[first]]
        logp = np.empty((len(grams), len(self.langs)))
        for k, (own, none) in enumerate(zip(self.levels, self.none, strict=True)):
            out, left = np.zeros(len(grams)), np.arange(len(grams))
            for n in range(ORDER, 0, -1):
                now = left[most[left] >= n]
                at, found = own[n - 1].find(hashes[n - 1][grams[now]])
                out[now[found]] += own[n - 1].logp[at[found]]
                rest = now[~found]
                if n > 1:
                    at, known = own[n - 2].find(hashes[n - 2][grams[rest] - 1])
                    out[rest[known]] += own[n - 2].back[at[known]]
                else:
                    out[rest] += none
                left = np.concatenate([left[most[left] < n], rest])
            logp[:, k] = out
        by_word = np.add.reduceat(np.column_stack([logp[inverse], np.ones(len(inverse))]), np.flatnonzero(np.diff(np.concatenate([[-1], word[1:]]))), axis=0)
        return by_word


class _Scorer:
    """Texts in, sums by language out; the scores of words stay at hand until there are ``CACHED``."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.share = max(1, len(models.langs) // 4)  # with more languages, fewer words are held
        self._restart()

    def _restart(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.empty((0, len(self.models.langs) + 1))

    def texts(self, texts: pa.Array) -> np.ndarray:
        total = np.zeros((len(texts), len(self.models.langs) + 1))
        held: list[str] = []
        ends: list[tuple[int, int]] = []  # row, end of its words in held
        for i, text in enumerate(texts):
            for words in words_of(text.as_py() or ""):
                held += words
                ends.append((i, len(held)))
                if len(held) > 8 * STRETCH // self.share:
                    self._add(held, ends, total)
                    held, ends = [], []
        self._add(held, ends, total)
        return total

    def _add(self, held: list[str], ends: list[tuple[int, int]], total: np.ndarray) -> None:
        """Add the words of ``held`` to their rows; words that are new are scored together."""
        if not held:
            return
        if len(self.index) > CACHED // self.share:
            self._restart()
        coded = pa.array(held, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if new:
            self.scores = np.concatenate([self.scores, self.models.score_words(new)])
            self.index.update(zip(new, range(len(self.index), len(self.scores)), strict=True))
        scores = self.scores[[self.index[w] for w in distinct]][coded.indices.to_numpy()]
        rows, stops = np.array(ends).T
        np.add.at(total, rows, np.add.reduceat(scores, np.concatenate([[0], stops[:-1]]), axis=0))


def _confidence(curve: tuple[float, float, float], margin: np.ndarray, length: np.ndarray) -> np.ndarray:
    z = curve[0] + margin * (curve[1] + curve[2] * np.log1p(length))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of sums: the language (ties: the first), its cross-entropy, the margin to the second, the length."""
    length = sums[:, -1]
    entropy = -sums[:, :-1] / np.maximum(length, 1)[:, None]
    best = entropy.argmin(1)
    own = entropy[np.arange(len(best)), best]
    others = entropy.copy()
    others[np.arange(len(best)), best] = np.inf
    second = others.min(1)
    return best, own, np.where(np.isfinite(second), second - own, 1.0), length


_WORDS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_LEVELS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("none", T.DoubleType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "logp", "back")]])
_SCORED = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType(), False)]


def sampled_words(train: DataFrame) -> DataFrame:
    """``lang, word, n`` of the sample of ``doc_id, text, lang``; a task sends each of its words once or a few times."""
    totals = train.groupBy("lang").agg(F.sum(F.length("text")).alias("total"))
    langs = {r["lang"]: r["total"] for r in totals.collect()}  # a row a language
    most = min(SAMPLE, SAMPLES // max(1, len(langs)))
    rate = {k: min(1.0, most / max(1, v or 0)) for k, v in langs.items()}
    limit = F.lit(None).cast("double")
    for k, v in rate.items():
        limit = F.when(F.col("lang") == k, F.lit(v)).otherwise(limit)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = train.select("lang", "text", drawn.alias("drawn"), limit.alias("rate"), (F.length("text") > WHOLE).alias("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, Counter] = {}
        size = 0

        def sent() -> Iterator[dict]:
            for lang, own in held.items():
                yield {"lang": [lang] * len(own), "word": list(own), "n": list(own.values())}

        for batch in batches:
            for row in batch.to_pylist():
                own = held.setdefault(row["lang"], Counter())
                before = len(own)
                for j, words in enumerate(words_of(row["text"])):
                    if not row["long"] or (zlib.crc32(f"{row['drawn']!r}:{j}".encode()) + 0.5) / 2**32 < row["rate"]:
                        own.update(words)
                size += len(own) - before
                if size > 300_000:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    counted = map_batches(some.where("long or drawn < rate"), run, _WORDS)
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _levels(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of one language, whose sample is bounded."""
    rows = pa.Table.from_batches(batches).sort_by("word")
    levels, none = model_of(rows.column("word").to_pylist(), rows.column("n").to_numpy())
    columns = {"lang": [key[0].as_py()] * ORDER, "n": pa.array(range(ORDER), pa.int32()), "none": [none] * ORDER}
    yield pa.RecordBatch.from_pydict(columns | {c: pa.array([getattr(x, c).tobytes() for x in levels], pa.binary()) for c in ("keys", "logp", "back")})


def fit(docs: DataFrame, fold: Column | None = None) -> Models:
    """Models and calibration from ``doc_id, text, lang``; ``fold`` (a number for each row) is 3 for calibration.

    Rows whose text, language or id is null are left out.  Languages whose rows hold no letter have no
    model.  Without any rows there is no language.
    """
    source = needed(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    part = fold_of(F.col("doc_id")) if fold is None else fold
    rows = store(sampled_words(source.where(part != 3)).groupBy("lang").applyInArrow(_levels, _LEVELS), "langid-levels").orderBy("lang", "n").collect()  # bounded by the sample
    langs = sorted({r["lang"] for r in rows})
    levels = [Level(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["logp"], np.float32), np.frombuffer(r["back"], np.float32)) for r in rows]
    models = Models(langs, [levels[i : i + ORDER] for i in range(0, len(levels), ORDER)], [r["none"] for r in rows[::ORDER]])
    return calibrate(models, source.where(part == 3)) if len(langs) > 1 else models


def calibrate(models: Models, docs: DataFrame, most: int = CALIBRATION) -> Models:
    """``models`` with a confidence and bounds fitted to about ``most`` labelled rows a language."""
    spark = docs.sparkSession
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    rate = F.lit(0.0)
    for k in models.langs:
        rate = F.when(F.col("lang") == k, F.lit(min(1.0, most / counts.get(k, 1)))).otherwise(rate)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) / float(1 << 40) < rate)
    sent = spark.sparkContext.broadcast(models.plain())
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = _Scorer(Models.from_plain(sent.value))
        for batch in batches:
            yield {"lang": batch.column(1), "sums": scorer.texts(batch.column(0)).tolist()}

    rows = map_batches(drawn.select("text", "lang"), run, schema).collect()  # a few numbers a sampled row
    sent.destroy()
    rows = sorted((r["lang"], r["sums"]) for r in rows if r["sums"][-1] > 0)
    if not rows:
        return models
    best, own, margin, length = _best(np.array([s for _, s in rows]))
    right = np.array([models.langs[b] == k for b, (k, _) in zip(best, rows, strict=True)], np.float64)
    x = np.column_stack([np.ones(len(margin)), margin, margin * np.log1p(length)])
    w = np.array([0.0, 2.0, 0.0])
    for _ in range(25):  # Newton steps, held back a little so that right answers alone give finite weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (right - p) - 0.05 * w)
    if not np.isfinite(w).all() or w[1] < 0 or w[1] + w[2] * np.log1p(length.max()) < 0:
        w = np.array([0.0, 2.0, 0.0])  # confidence must not fall as the margin grows
    bounds = []
    for i in range(len(models.langs)):
        held = own[(best == i) & (right > 0)]
        bounds.append(float(np.quantile(held, 1 - REJECTED_SHARE)) if len(held) else math.inf)
    return Models(models.langs, models.levels, models.none, tuple(w.tolist()), tuple(bounds))


def identify(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score``, ``cross_entropy`` (nats a character) and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, no cross-entropy, and rejected; so are
    all where no language was learnt.  A text is rejected, too, whose cross-entropy lies over the bound of
    its language; the language is named all the same.  Equal cross-entropies go to the first name.
    """
    made = {f.name for f in _SCORED}
    keep = [c for c in docs.columns if c != text and c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    schema = T.StructType([*source.schema.fields[:-1], *_SCORED])
    sent = docs.sparkSession.sparkContext.broadcast(models.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Models.from_plain(sent.value)
        scorer = _Scorer(known)
        names = np.array([*known.langs, UNKNOWN], object)
        for batch in batches:
            sums = scorer.texts(batch.column(len(keep)))
            columns = {str(n): batch.column(n) for n in range(len(keep))}
            if not known.langs:
                n = batch.num_rows
                yield columns | {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "cross_entropy": [None] * n, "rejected": [True] * n}
                continue
            best, own, margin, length = _best(sums)
            empty = length == 0
            bound = np.array(known.bounds or [math.inf] * len(known.langs))[best]
            yield columns | {"lang_pred": names[np.where(empty, len(known.langs), best)].tolist(), "score": np.where(empty, 0.0, _confidence(known.curve, margin, length)), "cross_entropy": pa.array(own, mask=empty), "rejected": empty | (own > bound)}

    return map_batches(source, run, schema)


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learnt from rows whose remainder is not 2.

    Null, empty and blank texts, and those without a letter, are ``und``; rows without an id are predicted
    but never learnt from, and are not held out; repeated rows are predicted each and alike; texts of any length
    count whole.  Extra columns are left behind, an empty table gives no rows.
    """
    docs = needed(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    models = fit(docs.where(~held_out))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op11_langid": op11_langid}
SQL: dict[str, str] = {}
