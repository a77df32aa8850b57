"""Mining of collocations: phrases of two or three words that stand together more often than their parts let expect.

Words are counted by language, and those that can be in a frequent phrase are numbered: the dictionary is
the sorted array of their hashes, an id the place in it.  Texts are written once as streams of ids, broken
(-1) at the ends of pieces and at all other words.  The ids of an n-gram are packed into a binary key of
fixed width; a task sorts its keys and sends each once with its count, keys are dealt by range and sorted,
and runs of equal keys are counted.  Triples are packed only where both of their pairs are frequent.

The dictionary is broadcast, as are the frequent pairs, each only up to ``MOST`` entries of eight bytes.  A
larger dictionary is not broadcast: ids are then the hashes themselves, of eight bytes in place of four, and
only ends of pieces break; a larger table of pairs prunes nothing.  Results are the same either way.
That no two words share a hash is tested over all words, and another seed is taken if any do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import map_batches, needed, release, store, table

LEAST, REPORTED, MOST = 10, 2000, 1 << 24
HELD_WORDS, HELD_IDS = 400_000, 1 << 22
STREAM = 1 << 18  # ids of a row of the encoded table, more only where a piece is longer

_ENDS, _UPPER = b".,;:!?\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(_ENDS + _UPPER + b"\t", b"\n" * len(_ENDS) + _UPPER.lower() + b" ")

_COUNTS = T.StructType([T.StructField("h", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_STREAMS = T.StructType([T.StructField("ids", T.BinaryType())])
_KEYS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])


def _hash(lang_seed: int, word: bytes) -> int:
    """Signed, as Spark's long; chained over language and word."""
    x = xxhash.xxh64_intdigest(word, lang_seed)
    return x - (1 << 64) if x >> 63 else x


def _pieces(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split(b"\n")


def counted(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``h, lang, word, n`` of ``text, lang``: occurrences of every word, and under a null word those of all words of the language.

    ``h`` stands for the word in its language; ``clash`` tells whether several words share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, Counter] = {}
        size = 0

        def sent() -> Iterator[dict]:
            for lang, own in held.items():
                by = xxhash.xxh64_intdigest(lang.encode(), seed)
                yield {"h": [_hash(by, w) for w in own], "lang": [lang] * len(own), "word": pa.array([w.decode() for w in own], pa.string()), "n": list(own.values())}
                yield {"h": [_hash(by + 1, b"\n")], "lang": [lang], "word": pa.array([None], pa.string()), "n": [own.total()]}

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                own = held.setdefault(lang.as_py(), Counter())
                before = len(own)
                for piece in _pieces(text.as_py()):
                    own.update(piece.split())
                size += len(own) - before
                if size > HELD_WORDS:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    each = map_batches(docs.select("text", "lang"), run, _COUNTS)
    what = F.struct("lang", "word")
    by = each.groupBy("h").agg(F.sum("n").alias("n"), F.min(what).alias("what"), F.max(what).alias("last"))
    return by.select("h", "what.lang", "what.word", "n", (~F.col("what").eqNullSafe(F.col("last"))).alias("clash"))


def _array(df: DataFrame, column: str, most: int) -> np.ndarray | None:
    """The sorted values of a column of longs, if there are at most ``most``."""
    if df.count() > most:
        return None
    return np.sort(df.select(column).toArrow().column(0).to_numpy())


def encoded(docs: DataFrame, dictionary: np.ndarray | None, seed: int = 42) -> DataFrame:
    """Rows of ids of whole pieces, four bytes an id, or eight without a dictionary; -1 breaks, in a way that no hash takes part in."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary) if dictionary is not None else None
    width = np.int32 if sent else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = sent.value if sent else None
        seen: dict[str, dict[bytes, int]] = {}
        out: list[int] = []

        def number(lang: str, words: list[bytes]) -> dict[bytes, int]:
            """Ids of words not seen before."""
            by = xxhash.xxh64_intdigest(lang.encode(), seed)
            h = np.array([_hash(by, w) for w in words], np.int64)
            if known is None:
                h[h == -1] = -2  # see frequent()
                return dict(zip(words, h.tolist(), strict=True))
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            return dict(zip(words, np.where(known[at] == h, at, -1).tolist() if len(known) else [-1] * len(words), strict=True))

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang, split = lang.as_py(), [p.split() for p in _pieces(text.as_py())]
                ids = seen.setdefault(lang, {})
                if new := list({w: None for words in split for w in words if w not in ids}):
                    ids.update(number(lang, new))
                for words in split:
                    out += map(ids.__getitem__, words)
                    out.append(-1)
                    if len(out) >= STREAM:
                        yield {"ids": [np.array(out, width).tobytes()]}
                        out = []
                if sum(map(len, seen.values())) > HELD_WORDS:
                    seen = {}
        yield {"ids": [np.array(out, width).tobytes()]} if out else {"ids": pa.array([], pa.binary())}

    return map_batches(docs.select("text", "lang"), run, _STREAMS)


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of fixed width: ids with the highest byte first and the sign turned, so that bytes sort as numbers do."""
    x = np.stack(columns, axis=1)
    if x.dtype == np.int64:
        return (x.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(f"V{8 * len(columns)}").ravel()
    return x.astype(">u4").view(f"V{4 * len(columns)}").ravel()


def _unpacked(keys: pa.Array, n: int, four: bool) -> np.ndarray:
    """A row of ``n`` ids a key."""
    width = n * (4 if four else 8)
    raw = np.frombuffer(keys.buffers()[2], np.uint8)[keys.offset * width :][: len(keys) * width] if len(keys) else np.zeros(0, np.uint8)
    if four:
        return raw.view(">u4").astype(np.int64).reshape(-1, n)
    return (raw.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).astype(np.int64).reshape(-1, n)


def _run_lengths(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples in order with how often each stands."""
    if len(columns) == 2 and columns[0].dtype == np.int32:
        both = np.sort(columns[0].astype(np.int64) << 32 | columns[1].astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        return [(both[first] >> 32).astype(np.int32), both[first].astype(np.int32)], np.diff(np.append(first, len(both)))
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def grams(streams: DataFrame, n: int, four: bool, pairs: np.ndarray | None = None) -> DataFrame:
    """``key, n``: each n-gram of a task's streams once or a few times with its count; with ``pairs``, only those whose pairs are all in that sorted array of packed fours."""
    sent = streams.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[dict]:
            if size:
                columns, counts = _run_lengths([np.concatenate(c) for c in zip(*held, strict=True)])
                for at in range(0, len(counts), 1 << 19):
                    keys = _packed([c[at : at + (1 << 19)] for c in columns])
                    width = keys.dtype.itemsize
                    offsets = pa.py_buffer(np.arange(0, (len(keys) + 1) * width, width, dtype=np.int32))
                    yield {"key": pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(keys.tobytes())]), "n": counts[at : at + (1 << 19)]}

        for batch in batches:
            for row in batch.column(0):
                x = np.frombuffer(row.as_buffer(), np.int32 if four else np.int64)
                for start in range(0, max(0, len(x) - n + 1), HELD_IDS):
                    y = x[start : start + HELD_IDS + n - 1]
                    columns = [y[i : len(y) - n + 1 + i] for i in range(n)]
                    good = np.logical_and.reduce([c != -1 for c in columns])
                    if sent is not None and n > 2:
                        known = sent.value
                        both = y[:-1].astype(np.int64) << 32 | (y[1:].astype(np.int64) & 0xFFFFFFFF)
                        at = np.minimum(np.searchsorted(known, both), max(0, len(known) - 1))
                        there = known[at] == both if len(known) else np.zeros(len(both), bool)
                        good &= np.logical_and.reduce([there[i : len(there) - n + 2 + i] for i in range(n - 1)])
                    held.append([c[good] for c in columns])
                    size += int(good.sum())
                    if size >= HELD_IDS:
                        yield from out()
                        held, size = [], 0
        yield from out()

    return map_batches(streams, run, _KEYS)


def frequent(keys: DataFrame, n: int, dictionary: np.ndarray | None, least: int) -> DataFrame:
    """``h1, ..., hn, a``: hashes of the words of keys that stand at least ``least`` times, counted as runs of a range-partitioned sort."""
    sent = keys.sparkSession.sparkContext.broadcast(dictionary) if dictionary is not None else None
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*[T.StructField(f"h{i + 1}", T.LongType()) for i in range(n)], T.StructField("a", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def rows(ids: np.ndarray, counts: np.ndarray) -> dict:
            enough = counts >= least
            ids = ids[enough] if sent is None else sent.value[ids[enough]]
            return {**{f"h{i + 1}": ids[:, i] for i in range(n)}, "a": counts[enough]}

        last, total = None, 0  # the run that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = _unpacked(batch.column(0), n, sent is not None), batch.column(1).to_numpy()
            if last is not None:
                ids, counts = np.concatenate([last, ids]), np.concatenate([[total], counts])
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))
            sums = np.add.reduceat(counts, first)
            last, total = ids[first[-1:]], int(sums[-1])
            yield rows(ids[first[:-1]], sums[:-1])
        if last is not None:
            yield rows(last, np.array([total]))

    dealt = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return map_batches(dealt, run, schema)


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exactly."""
    wide = [x.cast("decimal(15,0)") for x in (a, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, (wide[1] * wide[2]).cast("decimal(31,0)"))


def mine(docs: DataFrame, least: int = LEAST, reported: int = REPORTED, most: int = MOST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of ``text, lang``: the best ``reported`` phrases of each language.

    Null texts are empty, null languages are ``und``.  Phrases are of two or three words of a piece and stand
    ``least`` times; of their cuts the one with the lowest score counts, the first among equals.  Pairs in a
    triple that stands at least half as often are left out.  Equal scores go by count, then by the bytes
    of the phrase.  Texts without words and languages without phrases give no rows.
    """
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    seed = 42
    while True:
        words = store(counted(docs, seed).where(F.col("word").isNull() | (F.col("n") >= least) | F.col("clash")), "phrase-words")
        reserved = F.col("h").isin(-1, -2) & (F.col("n") >= least)  # -1 breaks, and takes the place of -2
        if words.where(F.col("clash") | reserved).isEmpty():
            break
        release(words)
        seed += 1
    totals = words.where("word is null").groupBy("lang").agg(F.sum("n").alias("total"))
    known = words.where("word is not null").select("h", "lang", "word", "n")
    dictionary = _array(known, "h", most)
    four = dictionary is not None
    streams = store(encoded(docs, dictionary, seed), "phrase-ids")
    keys = store(grams(streams, 2, four), "phrase-pairs")
    pairs = store(frequent(keys, 2, dictionary, least), "phrase-frequent-pairs")
    release(keys)
    packed = None
    if four and pairs.count() <= most:
        h = pairs.select("h1", "h2").toArrow()
        at = [np.searchsorted(dictionary, h.column(i).to_numpy()) for i in range(2)]
        packed = np.sort(at[0] << 32 | at[1])
    keys = store(grams(streams, 3, four, packed), "phrase-triples")
    release(streams)
    triples = store(frequent(keys, 3, dictionary, least), "phrase-frequent-triples")
    release(keys)

    word = lambda i: known.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"))
    inside = triples.select("h1", "h2", F.col("a").alias("longer")).unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), F.col("a").alias("longer")))
    inside = inside.groupBy("h1", "h2").agg(F.max("longer").alias("longer"))
    first = known.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("n").alias("n1"))
    two = pairs.join(inside, ["h1", "h2"], "left").where("longer is null or 100 * longer < 50 * a").drop("longer").join(first, "h1").join(word(2), "h2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), _score(F.col("a"), F.col("n1"), F.col("n2")).alias("score"))
    head = pairs.select("h1", "h2", F.col("a").alias("head"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("tail"))
    three = triples.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).join(first, "h1").join(word(2).drop("n2"), "h2").join(word(3), "h3")
    cuts = [F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "n1", "tail"), (2, "head", "n3"))]
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(*cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = two.unionByName(three)

    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))  # the best of each share hold the best of all
    some = found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= reported)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents``; see :func:`mine`.

    Repeated rows count each, texts of any length count whole, ids do not matter; extra columns are left behind.
    """
    return mine(needed(table(spark, sf_dir, "documents"), "text", "lang"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = "(1000000::hugeint * a * a // ({l}::hugeint * {r}))::bigint"
SQL = {
    "op12_phrases": f"""with texts as (select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
pieces as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') w from texts),
each as (select lang, 1 size, unnest(list_transform(w, lambda x: [x])) p from pieces
  union all select lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: [x[1], x[2]])) from pieces where len(w) > 1
  union all select lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: [x[1], x[2], x[3]])) from pieces where len(w) > 2),
f as (select lang, size, p, count(*)::bigint a from each group by all),
totals as (select lang, sum(a)::bigint n from f where size = 1 group by 1),
c as (select * from f where size > 1 and a >= {LEAST}),
cuts as (select c.lang, c.size, c.p, c.a, k, x.a l, y.a r, {_CUT.format(l="x.a", r="y.a").replace("* a * a", "* c.a * c.a")} score
  from (select *, unnest(range(1, size)) k from c) c join f x on x.lang = c.lang and x.size = k and x.p = c.p[1:k] join f y on y.lang = c.lang and y.size = c.size - k and y.p = c.p[k + 1:c.size]),
least_cut as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_pairs as (select lang, p[1:2] p, a from c where size = 3 union all select lang, p[2:3], a from c where size = 3),
longer as (select lang, p, max(a) longer from inner_pairs group by all),
left_over as (select t.* from least_cut t left join longer o on o.lang = t.lang and o.p = t.p where o.longer is null or 100 * o.longer < 50 * t.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) rank from left_over)
select lang, rank, array_to_string(p, ' ') phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {REPORTED}"""
}
QUERIES = {"op12_phrases": op12_phrases}
