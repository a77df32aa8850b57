"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is cut into tokens: words of up to ``TOKEN`` characters without white space, the two parts of a
word of up to twice as many, and the single characters of a longer run, so that a passage of a text
without white space has the same tokens wherever it stands.  A run of ``K`` tokens
is a closed syncmer if the least hash of its inner runs of ``S`` tokens is that of its first or last
one.  Whether a run is chosen depends on nothing outside it, so the same passage gives the same
anchors wherever it stands, and the half of a text that an edit leaves alone keeps its own.

The fingerprint holds every anchor of the text in its order: 30 bits of the hash of its run and, in two
more bits, the distance in tokens from the anchor before, which closed syncmers keep within ``K - S``.
Positions can so be read back from it.  Two fingerprints are compared by the distinct hashes of their
anchors, all of them; the likeness is their Jaccard similarity.  A text where no run is chosen, as one of
fewer than ``K`` tokens, has one anchor without a distance, the hash of all its tokens; a text without any
token has none, and is like another such text only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.llm.common import free_name, needed, table

TOKEN, K, S = 8, 5, 2
ROWS_PER_RANGE, MOST_RANGES, MOST_CUTS = 400, 1 << 18, 4096
# the start of a run of at most two tokens, its second token, a character of a longer run
_PATTERN = rf"(?<!\S)\S{{1,{TOKEN}}}(?=\S{{0,{TOKEN}}}(?!\S))|(?<=(?<!\S)\S{{{TOKEN}}})\S{{1,{TOKEN}}}(?!\S)|\S"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PATTERN), F.lit(0))


def _inner(t: Column) -> Column:
    """Hashes of the runs of two tokens; the last element is of no run."""
    return F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _chosen(m: Column, i: Column) -> tuple[Column, Column]:
    """Whether the run at ``i`` (from 0) is a closed syncmer, and its hash."""
    a = [F.get(m, i + j) for j in range(K - S + 1)]
    return F.least(a[0], a[-1]) <= F.least(*a[1:-1]), F.xxhash64(a[0], a[2], a[3])


def _code(h: Column, distance: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit((1 << 30) - 1).cast("bigint")).cast("int"), 2).bitwiseOR(distance)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out`` (array of int): the anchors of a text in order, ``hash << 2 | distance`` each."""
    t, m_ = free_name(df.columns, "tokens"), free_name(df.columns, "inner")
    df = df.withColumn(t, tokens(F.col(f"`{text}`"))).withColumn(m_, _inner(F.col(f"`{t}`")))
    m = F.col(f"`{m_}`")
    none = F.array().cast("array<int>")
    places = F.when(F.size(m) >= K, F.filter(F.sequence(F.lit(0), F.greatest(F.size(m) - K, F.lit(0))), lambda i: _chosen(m, i)[0])).otherwise(none)
    whole = F.array(_code(F.xxhash64(f"`{t}`"), F.lit(0)))

    def coded(at: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
        return F.zip_with(at, before, lambda i, j: _code(_chosen(m, i)[1], i - j))

    # an array of one, so that the places are computed once
    found = F.get(F.transform(F.array(places), lambda at: F.when(F.size(at) > 0, coded(at)).when(F.size(m) > 0, whole).otherwise(none)), F.lit(0))
    return df.withColumn(out, found).drop(t, m_)


def positions(anchors: Column) -> Column:
    """Array of ``position`` (in tokens, from 0) and ``hash`` of anchors; that of a whole text stands at 0."""
    start = F.struct(F.lit(-1).alias("position"), F.array().cast("array<struct<position:int,hash:int>>").alias("found"))

    def add(held: Column, x: Column) -> Column:
        at = held["position"] + x.bitwiseAND(F.lit(3))
        return F.struct(at.alias("position"), F.concat(held["found"], F.array(F.struct(F.greatest(at, F.lit(0)).alias("position"), F.shiftright(x, 2).alias("hash")))).alias("found"))

    return F.aggregate(anchors, start, add, lambda held: held["found"])


def passages(df: DataFrame, keys: list[str], a: str, b: str, least: int = 2) -> DataFrame:
    """Passages that the texts of two anchor columns share: ``keys, from_a, from_b, anchors, tokens``.

    Anchors that stand once in each text are matched by their hash; a passage is a run of at least
    ``least`` matches with one displacement, with no more than ``K`` tokens from one to the next.
    ``keys`` tell rows apart.
    """
    def once(column: str, place: str) -> DataFrame:
        each = df.select(*keys, F.explode(positions(F.col(column))).alias("_x")).select(*keys, "_x.hash", "_x.position")
        return each.groupBy(*keys, "hash").agg(F.min("position").alias(place), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")

    both = once(a, "_a").join(once(b, "_b"), [*keys, "hash"]).withColumn("_shift", F.col("_b") - F.col("_a"))
    own = Window.partitionBy(*keys, "_shift").orderBy("_a")
    opens = F.coalesce(F.col("_a") - F.lag("_a").over(own) > K, F.lit(True))
    runs = both.withColumn("_run", F.sum(opens.cast("int")).over(own)).groupBy(*keys, "_shift", "_run")
    found = runs.agg(F.min("_a").alias("from_a"), F.min("_b").alias("from_b"), F.count(F.lit(1)).alias("anchors"), (F.max("_a") - F.min("_a") + K).alias("tokens"))
    return found.where(F.col("anchors") >= least).drop("_shift", "_run")


def hashes(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda x: F.shiftright(x, 2)))


def as_text(anchors: Column) -> Column:
    """Eight hexadecimal digits an anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of distinct hashes; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    joint = F.size(a) + F.size(b) - common
    return F.when(joint == 0, F.lit(1.0)).otherwise(common / joint).cast("double")


def with_next(docs: DataFrame, columns: list[str], rows_per_range: int = ROWS_PER_RANGE, derive: Callable[[DataFrame], DataFrame] = lambda df: df, row: Column | None = None) -> DataFrame:
    """``derive`` of ``doc_id, text`` with ``next_<column>`` for ``columns``: those of the next document in descending ``doc_id``.

    The next of the last is the first.  Null ids come last; rows of one id have some order among them.
    ``doc_id`` is an integer.  Ids are cut into ranges of nearly equal counts; the next row lies in the
    same range, or is the first of the range below, which is joined to it.  An id that many rows share
    has a range of its own, which is dealt to several by salt, as null ids are.  There are
    ``MOST_RANGES`` ranges at most, so that their first rows can be broadcast.  ``derive`` adds columns
    after rows are dealt, and for those first rows anew.

    The table is read twice, and ``row`` is a number that a row has in both, whatever tasks read it; without
    it, rows are numbered by task, which takes a source that is split alike each time.
    """
    numbered = docs.select("doc_id", "text", (F.monotonically_increasing_id() if row is None else row).alias("_row"))
    docs = needed(docs, "doc_id", "text")
    n, low, top = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(MOST_RANGES, max(1, math.ceil(n / rows_per_range)))
    rough = min(MOST_CUTS, ranges)
    finer = math.ceil(ranges / rough)
    many = max(4 * rows_per_range, n // MOST_CUTS)
    hot = [(r["doc_id"], math.ceil(r["n"] / many)) for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).collect()]  # at most MOST_CUTS rows
    cuts = {c for i, _ in hot if i is not None for c in (i, i + 1) if low < c <= top}
    if top is not None and rough > 1:
        found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / rough) for i in range(1, rough)]), max(10_000, 16 * rough)))
        cuts |= set(found.first()[0])
    cuts = sorted(cuts)
    held = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # binary search of the id among the cuts, from the largest step down
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)]) if cuts else F.array().cast("array<int>")
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(held, p + s - 1) <= F.col("doc_id")), p + s).otherwise(p))
    ranged = numbered.withColumn("_cut", place)
    # equal shares of the way from cut to cut, which keep the order whatever ids there are
    least = F.coalesce(F.get(held, F.col("_cut") - 1), F.lit(low)).cast("double")
    most = F.coalesce(F.get(held, F.col("_cut")), F.lit(top)).cast("double")
    share = F.when(most > least, F.least(F.lit(finer - 1), F.floor((F.col("doc_id").cast("double") - least) * finer / (most - least)))).otherwise(0)
    ranged = ranged.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_cut").cast("bigint") * finer + share))
    salts = F.lit(1)
    if hot:
        given = docs.sparkSession.createDataFrame(hot, "_id bigint, _salts int")
        ranged = ranged.join(F.broadcast(given), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        salts = F.coalesce("_salts", F.lit(1))
    ranged = ranged.withColumn("_salt", F.pmod(F.xxhash64("_row"), salts)).drop("_cut", "_salts")
    key = ["_range", "_salt"]

    # a row a range: its first, then the texts of those rows
    first = ranged.groupBy(*key).agg(F.max(F.struct("doc_id", "_row")).alias("f")).select(*key, "f._row")
    below = Window.orderBy(*key)
    ends = first.agg(F.min(F.struct(*key)).alias("e")).first()["e"]
    last = F.struct(F.lit(ends["_range"] if ends else None).cast("bigint").alias("_range"), F.lit(ends["_salt"] if ends else None).cast("bigint").alias("_salt"))
    bounds = first.select(F.coalesce(F.lead(F.struct(*[F.col(k).cast("bigint").alias(k) for k in key])).over(below), last).alias("_for"), "_row")
    heads = numbered.join(F.broadcast(bounds), "_row").drop("_row")
    heads = derive(heads).select(F.col("_for._range").alias("_range"), F.col("_for._salt").alias("_salt"), *[F.col(c).alias(f"_head_{c}") for c in columns])

    window = Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last(), F.col("_row").desc())
    # dealt before columns are derived, so that texts alone are sent; window and join find their rows in place
    derived = derive(ranged.repartition(*key))
    led = derived.withColumn("_lead", F.lead(F.struct(*columns)).over(window))
    joined = led.join(heads, key, "left")
    nexts = [F.when(F.col("_lead").isNotNull(), F.col("_lead")[c]).otherwise(F.col(f"_head_{c}")).alias(f"next_{c}") for c in columns]
    return joined.select(*[F.col(c) for c in derived.columns if c not in ("_range", "_salt", "_row")], *nexts)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text.

    Null is the empty text; without tokens the fingerprint is empty, and texts of any length have all
    their anchors.  Rows repeated with their id, and rows without id, which come last, are next to each
    other in some order.  One row alone is its own next.  Extra columns are left behind; an empty table
    gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    file = docs.metadataColumn("_metadata")  # also where a column of the table has that name
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(file["file_path"], file["row_index"]).alias("place"))
    both = with_next(docs, ["text", "anchors"], derive=lambda df: with_anchors(df, "text", "anchors"), row=F.col("place"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    both = both.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_anchors(both, "edited", "edited_anchors")
    near = lambda other: F.get(F.transform(F.array(hashes(F.col("anchors"))), lambda own: likeness(own, hashes(F.col(other)))), F.lit(0))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        near("edited_anchors").alias("near_edited"),
        near("next_anchors").alias("near_next"),
    )


QUERIES = {"op4_syncmers": op4_syncmers}
SQL: dict[str, str] = {}
