"""Benchmark decontamination by suffix arrays of the training words.

The words of the training texts are cut into shards of a bounded size.  A shard gets a suffix array
as deep as the longest benchmark item, and every suffix of every item is binary-searched in it, a
word at a time, for all suffixes at once.  The search gives the longest verbatim match of each
suffix and at each place, and all places where the first ``window`` words of a suffix stand.

A shard is a run of rows of one task.  A text longer than a shard is cut into pieces that overlap by
the depth, so no match is lost and no row needs more memory than a shard.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import free_name, map_batches, needed, store, table

WINDOW = 10
SHARD_WORDS = 1 << 20
SLICE_BYTES = 16 << 20
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose letters A-Z are lower-cased."""
    return text.encode().lower().translate(_TABLE).split() if text else []


def _bounds(x: np.ndarray, order: np.ndarray, at: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In each range ``lo:hi`` of ``order``, sorted by the word ``at`` places on, the range of ``want``."""
    last = len(x) - 1

    def first(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            mid = (a[live] + b[live]) >> 1
            less = x[np.minimum(order[mid] + at, last)] < least[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)

    left = first(lo, hi, want)
    return left, first(left, hi, want + 1)


def suffix_array(x: np.ndarray, depth: int, places: np.ndarray) -> np.ndarray:
    """``places`` of ``x`` in the order of the ``depth`` words from each; what lies beyond the end comes first.

    The first words of all places are packed into one sort key; only places that tie are sorted on.
    """
    n = len(x)
    bits = max(1, int(x.max(initial=0) + 2).bit_length())
    step = max(1, 63 // bits)
    padded = np.concatenate([x + 1, np.zeros(depth + step, x.dtype)]).astype(np.int64)

    def key(places: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for j in range(step):
            out = out << bits | padded[np.minimum(places + (at + j), n + depth)]
        return out

    k = key(places, 0)
    by = np.argsort(k)
    order, k = places[by], k[by]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    at = step
    while at < depth:
        tied = same.copy()
        tied[:-1] |= same[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        group = np.cumsum(~same[slots])
        k = key(order[slots], at)
        by = np.lexsort((k, group))
        order[slots] = order[slots][by]
        k, group = k[by], group[by]
        same[slots] = np.concatenate([[False], (k[1:] == k[:-1]) & (group[1:] == group[:-1])])
        at += step
    return order


class Benchmark:
    """The items of one slice of the benchmark, and the search of their suffixes in a shard."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        items = [(name, w) for name, w in items if w]
        self.names = [name for name, _ in items]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in items)))}
        size = np.array([len(w) for _, w in items], np.int64)
        self.flat = np.array([self.vocabulary[w] for _, ws in items for w in ws], np.int64)
        self.item = np.repeat(np.arange(len(items)), size)
        ends = np.cumsum(size)
        self.left = ends[self.item] - np.arange(len(self.flat)) if items else np.zeros(0, np.int64)  # words of the item from here
        self.depth = int(size.max(initial=1))
        # where a window starts: whole windows, or the start of an item that is shorter than a window
        offset = np.arange(len(self.flat)) - (ends - size)[self.item] if items else np.zeros(0, np.int64)
        short = size[self.item] < window if items else np.zeros(0, bool)
        self.window = np.where(short & (offset == 0), self.left, np.where(self.left >= window, window, 0))

    def search(self, x: np.ndarray, order: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every suffix: words of its longest match, one place of it, and the range of ``order`` where its window stands.

        ``reach`` is filled with the words of the longest match of any suffix at each place of ``order``.
        """
        n = len(self.flat)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
        longest, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n if len(order) else 0)
        at = 0
        while len(live):
            a, b = _bounds(x, order, at, lo[live], hi[live], self.flat[live + at])
            found = a < b
            live, a, b = live[found], a[found], b[found]
            lo[live], hi[live] = a, b
            at += 1
            longest[live], place[live] = at, order[a]
            if reach is not None:
                begins, own = np.unique(a, return_index=True)  # ranges of different words are disjoint
                sizes = b[own] - begins
                reach[np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)] = at
            whole = self.window[live] == at
            wlo[live[whole]], whi[live[whole]] = a[whole], b[whole]
            live = live[self.left[live] > at]
        return longest, place, wlo, whi


def _search_shard(bench: Benchmark, pieces: list[tuple[int, int, list[bytes]]], hits: dict[int, list], items: dict[int, set], longest: dict[int, tuple[int, int]]) -> None:
    """Search the shard of ``pieces`` (row, first word, words); adds intervals, items and longest matches (words, first of them) by row."""
    of = bench.vocabulary.get
    # a word of no item cuts matches as the end of a text does; both are the largest id
    cut = len(bench.vocabulary)
    sizes = [len(w) + 1 for _, _, w in pieces]
    x = np.fromiter(chain.from_iterable(chain((of(w, cut) for w in ws), (cut,)) for _, _, ws in pieces), np.int64, sum(sizes))
    begins = np.cumsum([0, *sizes])
    starts = np.flatnonzero(x != cut)  # no suffix of an item starts elsewhere
    if not len(starts):
        return
    order = suffix_array(x, bench.depth, starts)
    reach = np.zeros(len(order), np.int64)
    _, _, wlo, whi = bench.search(x, order, reach)
    length = np.zeros(len(x), np.int64)
    length[order] = reach
    best = np.maximum.reduceat(length, begins[:-1])
    ends = np.flatnonzero((length > 0) & (length == np.repeat(best, sizes)))
    at, own = np.unique(np.searchsorted(begins, ends, "right") - 1, return_index=True)
    for i, m, p in zip(at.tolist(), best[at].tolist(), (ends[own] - begins[at]).tolist(), strict=True):
        row, first, _ = pieces[i]
        longest[row] = max(longest.get(row, (0, 0)), (m, first + p), key=lambda x: (x[0], -x[1]))
    # suffixes of one window have one range of places, which is read once
    live = np.flatnonzero(whi > wlo)
    if not len(live):
        return
    ranges, own = np.unique(np.stack([wlo[live], whi[live], bench.window[live]], 1), axis=0, return_inverse=True)
    own = own.ravel()
    by = np.argsort(own, kind="stable")
    of_range = np.split(bench.item[live][by], np.searchsorted(own[by], np.arange(1, len(ranges))))
    n = ranges[:, 1] - ranges[:, 0]
    which = np.repeat(np.arange(len(n)), n)
    places = order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + ranges[which, 0]]
    at = np.searchsorted(begins, places, "right") - 1
    row = np.array([p[0] for p in pieces], np.int64)[at]
    start = places - begins[at] + np.array([p[1] for p in pieces], np.int64)[at]
    for r, k in np.unique(np.stack([row, which], 1), axis=0).tolist():
        items.setdefault(r, set()).update(of_range[k].tolist())
    # hits of a row that touch become one
    end = start + ranges[which, 2]
    span = int(end.max()) + 1
    a, b = row * span + start, row * span + end
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    opens = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    for first, last in zip(a[opens].tolist(), b[np.append(opens[1:], len(a)) - 1].tolist(), strict=True):
        r = first // span
        hits.setdefault(r, []).append((first - r * span, last - r * span))


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in slices of at most ``slice_bytes`` of text (or one item), read a slice at a time."""
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        n = len((row[1] or "").encode())
        if held and size + n > slice_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], words(row[1])))
        size += n
    yield held


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES, text: str = "text", out: str = "matches") -> DataFrame:
    """``docs`` with a struct column ``out`` in place of an older one of that name.

    Its fields: ``n_words``; ``hits``, the disjoint word ranges ``[from, to)`` inside occurrences of
    item windows, ascending; ``items``, the ``item_id`` of the items that occur, as distinct sorted
    strings; ``n_items``, how many they are, and rows of the benchmark without id besides; ``longest``, words of the longest
    passage of the text that stands in an item (0 without any), and ``longest_from``, the first word
    of the first such passage (null without any).

    A window is ``window`` words; an item of fewer words is one window, an item without words none.
    Null and empty texts have no words.  Repeated rows are found each; rows of the benchmark
    that share an id are one item, and a row without id is one of its own without a name in ``items``.  The benchmark is sent to executors in slices of
    ``slice_bytes``, one at a time, and the texts are searched for one slice after the other, however
    many.  Texts of any length are searched whole, and without rows there are none.
    """
    items = needed(benchmark, "item_id", "text")
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    spare = free_name([*keep, out], "searched_text")
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(spare))
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_items", T.LongType()), T.StructField("longest", T.LongType()), T.StructField("longest_from", T.LongType())])
    base = frame.withColumn(out, F.lit(None).cast(kind))
    schema, names = base.schema, base.columns
    found, sent, stored = base, None, None
    for one in _slices(items, slice_bytes):
        if sent is not None:  # the slice before is done with: its results are stored and it leaves the executors
            found = stored = store(found, "matches", instead_of=stored)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(one)
        found = map_batches(found, _find_fn(sent, window, shard_words, names, spare, out), schema)
    return found.drop(spare)


def _find_fn(sent, window: int, shard_words: int, names: list[str], spare: str, out: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bench = Benchmark(sent.value, window)
        held: list[pa.RecordBatch] = []
        pieces: list[tuple[int, int, list[bytes]]] = []
        counts: list[int] = []
        hits: dict[int, list] = {}
        items: dict[int, set] = {}
        longest: dict[int, tuple[int, int]] = {}
        n_held = n_bytes = 0
        overlap = bench.depth - 1
        step = max(shard_words, 2 * overlap + 1)

        def search() -> None:
            nonlocal n_held
            _search_shard(bench, pieces, hits, items, longest)
            pieces.clear()
            n_held = 0

        def result() -> Iterator[dict]:
            row = 0
            for batch in held:
                columns = {n: batch.column(i) for i, n in enumerate(names)}
                values = []
                for old in batch.column(names.index(out)).to_pylist():
                    names_found = [bench.names[i] for i in items.get(row, ())]
                    new = {"n_words": counts[row], "hits": _merged(hits.get(row, [])), "items": {str(x) for x in names_found if x is not None}, "n_items": names_found.count(None), "longest": longest.get(row, (0, None))[0], "longest_from": longest.get(row, (0, None))[1]}
                    if old:
                        new["hits"] = _merged([*new["hits"], *[(h["from"], h["to"]) for h in old["hits"]]])
                        new["items"] |= set(old["items"])
                        new["n_items"] += old["n_items"] - len(old["items"])
                        if old["longest"] and (-old["longest"], old["longest_from"]) < (-new["longest"], new["longest_from"] or 0):
                            new["longest"], new["longest_from"] = old["longest"], old["longest_from"]
                    new["n_items"] += len(new["items"])
                    new["items"] = sorted(new["items"])
                    new["hits"] = [{"from": a, "to": b} for a, b in new["hits"]]
                    values.append(new)
                    row += 1
                columns[out] = values
                yield columns
            held.clear()
            for x in (counts, hits, items, longest):
                x.clear()

        for batch in batches:
            held.append(batch)
            n_bytes += batch.nbytes
            for x in batch.column(names.index(spare)):
                ws = words(x.as_py())
                row = len(counts)
                counts.append(len(ws))
                for first in range(0, max(1, len(ws) - overlap), step - overlap):
                    piece = ws[first : first + step]
                    if piece:
                        pieces.append((row, first, piece))
                        n_held += len(piece) + 1
                    if n_held >= shard_words:
                        search()
            if n_bytes >= 48 << 20:
                search()
                yield from result()
                n_bytes = 0
        search()
        yield from result()

    return run


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; all columns and clean rows stay, null and empty texts too."""
    out = free_name(docs.columns, "matches")
    return find(docs, benchmark, window, out=out).where(F.size(F.col(out)["hits"]) == 0).drop(out)


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of ``documents`` that stand inside an occurrence of a window of ``benchmark``.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing.  Repeated rows and
    null ids stay as they are, each with its own hits; rows of the benchmark that share an id are
    one item, and one without id counts in ``n_items`` and not in ``items_sha256``.  Extra columns are left behind.
    """
    found = find(needed(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.col("matches.hits"), F.lit(0).cast("long"), lambda a, h: a + h["to"] - h["from"])
    return found.select(
        "doc_id",
        F.col("matches.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.col("matches.n_items").alias("n_items"),
        F.sha2(F.array_join("matches.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op5_suffix_arrays": op5_suffix_arrays}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op5_suffix_arrays": f"""
with d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
b as (select item_id, row_number() over () i, {_WORDS} w from benchmark),
windows as (select item_id, i, unnest(case when len(w) = 0 then [] when len(w) < 10 then [w] else [w[k:k+9] for k in range(1, len(w) - 8)] end) v from b),
sizes as (select distinct len(v) n from windows),
places as (select r, k, n, w[k:k+n-1] v from (select r, w, n, unnest(range(1, len(w) - n + 2)) k from d, sizes)),
found as (select r, k, n, item_id, i from places join windows using (v)),
hit as (select r, count(distinct p) n_hit from (select r, unnest(range(k, k + n)) p from found) group by r),
named as (select r, count(distinct item_id) + count(distinct i) filter (item_id is null) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) names from found group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (r) left join named using (r)"""
}
