"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A document is its set of distinct word shingles.  Its sketch has ``BINS`` coordinates.  In round
``i`` every shingle is hashed to a bin and a value; a coordinate keeps the least value of the first
round that reached its bin.  From round ``BINS`` on, every shingle goes to bin ``i - BINS``, so that
after at most ``2 * BINS`` rounds all coordinates are filled, whatever the size of the set, and few
rounds are needed as a rule.  Coordinates of two sets agree with a probability of their Jaccard
similarity, with the concentration of independent trials.

``BANDS`` bands of ``ROWS`` coordinates are the buckets.  At a similarity of 0.8 a pair shares no
bucket with a probability of (1 - 0.8 ** 6) ** 42, about 3 in a million, and less above.  No bucket
is capped and no pair of a bucket is left unexamined; what need not be compared is only what is
known to be in one group already, or cannot be linked:

1. Equal sets are one class.  All that follows is on classes.
2. Each class is compared with the least class of its buckets (its pivot), which joins most groups.
3. Pairs of a class and another pivot of it are compared if they are still in different groups.
4. In a bucket that still holds several groups, each class outside the pivot's group is compared
   with all classes of other groups, except where sizes or the triangle inequality of the Jaccard
   distance exclude a link, or where one-bit sketches of ``WIDE`` coordinates differ by more than
   ``APART`` bits.  A pair at 0.8 differs by a tenth of them; ``APART`` is 4.75 standard deviations
   above, which loses one such pair in a million.

Comparison is of whole shingle sets (64-bit hashes of shingles).  Groups are connected components,
found by label propagation with pointer jumping; each round is a few joins.

Rows that are equal in id and text are one row before anything is shuffled by them.  A class, bucket
or group that holds more rows than ``HOT_ROWS``, or a share of ``1 / HOT_KEYS`` of all, is dealt to
several tasks by salt; the pairs of a bucket are dealt as cells of ``CELL_ROWS`` by ``CELL_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import free_name, map_batches, needed, release, store, table

BINS, BANDS, ROWS = 256, 42, 6
PERCENT = 80
WIDE = 2048
_DIFFER = (1 - PERCENT / 100) / 2
APART = int(WIDE * _DIFFER + 4.75 * np.sqrt(WIDE * _DIFFER * (1 - _DIFFER)))

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _constants(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text.

    Letters A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``.  With fewer than ``k`` words the
    whole sequence is one shingle; without words there is none.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    last = len(h) - n + 1
    out = np.full(last, n * _STEP & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i, c in enumerate(_constants(n)):
        out += h[i : i + last] * c
    return np.unique(_mix(out))


def sketch(a: np.ndarray, n_bins: int = BINS) -> np.ndarray:
    """The ``n_bins`` (a power of two) coordinates of a set that is not empty."""
    wide = n_bins.bit_length() - 1
    shift, round_shift = np.uint64(64 - wide), np.uint64(64 - 2 * wide - 2)
    low = np.uint64(2 * wide + 2)  # bits of a key that are not of the value
    in_bin = np.uint64((n_bins - 1) << (64 - wide))
    # so many rounds in a pass that it fills nearly all sketches
    per = max(1, int(np.ceil(1.3 * n_bins * np.log(n_bins) / len(a))))
    out, open_, first = np.zeros(n_bins, np.uint64), np.ones(n_bins, bool), 0
    bins = np.arange(n_bins, dtype=np.uint64) << shift
    while open_.any():
        rounds = np.arange(first, min(first + per, 2 * n_bins), dtype=np.uint64)
        h = _mix(a[None, :] + (_mix((rounds + np.uint64(1)) * np.uint64(_STEP)))[:, None])
        bin_ = h & in_bin
        late = rounds >= n_bins
        if late.any():
            bin_[late] = ((rounds[late] - np.uint64(n_bins)) << shift)[:, None]
        key = (bin_ | rounds[:, None] << round_shift | (h << np.uint64(wide)) >> low).ravel()
        key.sort()
        at = np.minimum(np.searchsorted(key, bins), len(key) - 1)
        new = open_ & (key[at] & in_bin == bins)
        out[new] = key[at[new]] & ~in_bin
        open_ &= ~new
        first += per
    return out


def one_bits(a: np.ndarray) -> np.ndarray:
    """A bit of each of ``WIDE`` coordinates, packed in 64-bit numbers."""
    return np.packbits((_mix(sketch(a, WIDE)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


_BAND = _constants(ROWS + BANDS)


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band, different between bands."""
    rows = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mix((_mix(rows) * _BAND[:ROWS]).sum(1, dtype=np.uint64) + _BAND[ROWS:]).view(np.int64)


HOT_ROWS, HOT_KEYS, CELL_ROWS = 512, 4096, 512


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def _salts(keyed: DataFrame, key: str, n: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The few hot keys with their number of salts, and ``keyed`` (a row a key, ``n`` rows each) once a salt.

    At most ``HOT_KEYS`` keys are hot, whatever the size of the table, so the first frame can be broadcast.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = keyed.where(F.col(n) > least).select(key, F.ceil(F.col(n) / least).cast("int").alias("_salts"))
    some = F.when(F.col(n) > least, F.ceil(F.col(n) / least).cast("int")).otherwise(1)
    return F.broadcast(hot), keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), some - 1)))


def _salted(rows: DataFrame, hot: DataFrame, key: str, by: Column) -> DataFrame:
    """``rows`` with the salt of each, from a hash of ``by`` where its key is hot."""
    return rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")


def features(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row_key, n_shingles, set_key, bands`` of every row; without words ``set_key`` and ``bands`` are null.

    ``row_key`` is a hash of id and text: rows that share it are the same row again.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _row_key(doc_id, text).alias("row_key"), F.col(f"`{text}`").alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("row_key", long), T.StructField("n_shingles", long), T.StructField("set_key", long), T.StructField("bands", T.ArrayType(long, False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import xxhash

        for batch in batches:
            n, key, band = [], [], []
            for x in batch.column(2):
                a = shingles(x.as_py(), k)
                n.append(len(a))
                key.append(int(np.uint64(xxhash.xxh3_64_intdigest(a.tobytes())).view(np.int64)) if len(a) else None)
                band.append(bands(sketch(a)) if len(a) else None)
            yield {"doc_id": batch.column(0), "row_key": batch.column(1), "n_shingles": n, "set_key": key, "bands": band}

    return map_batches(source, run, schema)


def _sets(candidates: DataFrame, docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """``cid, pivot, shingles`` of the candidate classes, from the text of one row of each."""
    # one of the rows that repeat, before the shuffle
    source = docs.select(_row_key(doc_id, text).alias("row_key"), F.col(f"`{text}`").alias("text")).dropDuplicates(["row_key"])
    joined = source.join(candidates, "row_key").select("cid", "pivot", "text")
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("pivot", T.BooleanType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"cid": batch.column(0), "pivot": batch.column(1), "shingles": [shingles(x.as_py(), k).tobytes() for x in batch.column(2)]}

    return map_batches(joined, run, schema)


def _with_bits(sets: DataFrame) -> DataFrame:
    """``cid, bits, bands`` of classes."""
    numbers = T.ArrayType(T.LongType(), False)
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("bits", numbers), T.StructField("bands", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            yield {"cid": batch.column(0), "bits": [one_bits(a) for a in sets_], "bands": [bands(sketch(a)) for a in sets_]}

    return map_batches(sets.select("cid", "shingles"), run, schema)


def _verify(pairs: DataFrame, sets: DataFrame, of_pivots: bool) -> DataFrame:
    """``a, b, common, joint``: sizes of intersection and union of the sets of each pair."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = (sets.where("pivot") if of_pivots else sets).select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    long = T.LongType()
    schema = T.StructType([T.StructField(x, long) for x in ("a", "b", "common", "joint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            common, joint = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common.append(len(np.intersect1d(p, q, assume_unique=True)))
                joint.append(len(p) + len(q) - common[-1])
            yield {"a": batch.column(0), "b": batch.column(1), "common": common, "joint": joint}

    return map_batches(joined, run, schema)


ROWS_PER_FILE = 1_000_000


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``node, component`` (the least node of it) for all nodes of undirected links, as a stored table.

    Each round takes the least label of the neighbours and then the label of that label; the number
    of rounds grows with the logarithm of the longest path.  A round is written as files of about
    ``ROWS_PER_FILE`` rows, so that small graphs are not spread over as many files as tasks.
    """
    both = store(links.select(F.col(src).alias("x"), F.col(dst).alias("y")).unionByName(links.select(F.col(dst).alias("x"), F.col(src).alias("y"))), "links", light=True)
    files = -(-both.count() // ROWS_PER_FILE) or 1
    labels = stored = store(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")).coalesce(files), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = stepped.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        # the labels of a round replace those of the round before, also on disk
        stored = store(stepped.join(up, "component").select("node", "old", F.least("component", "higher").alias("component")).coalesce(files), "labels", instead_of=stored)
        labels = stored.select("node", "component")
        if stored.where("old <> component").isEmpty():
            release(both)
            labels._scratch_path = stored._scratch_path
            return labels


def _linked(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("common") * 100 >= F.col("joint") * PERCENT).select("a", "b")


def _sizes_allow(n: str, m: str) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def groups(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", apart: int = APART) -> DataFrame:
    """``doc_id, row_key, n_shingles, class, group, component_id`` of every row.

    ``class`` stands for rows with equal sets, ``group`` for those that links connect, and
    ``component_id`` is the least ``doc_id`` of the group.  Rows without words (null, empty or blank
    texts) have null ``class`` and ``group`` and their own ``doc_id``.  Rows with a null id take part
    in groups; a group of nothing but null ids has a null ``component_id``.  Repeated rows are in one
    class, however often they repeat.  Texts of any length count whole; without rows there are none.
    With ``apart=WIDE`` no pair of a bucket is left out by its one-bit sketches, only by sizes and distances,
    which exclude no link.
    """
    made: list[DataFrame] = []

    def put(df: DataFrame, what: str, light: bool = True) -> DataFrame:
        made.append(store(df, what, light=light))
        return made[-1]

    def linked(links: DataFrame) -> DataFrame:
        made.append(components(links))
        return made[-1]

    rows = store(features(docs, k, doc_id, text), "features")
    worded = rows.where("set_key is not null")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    # a class is one row here, combined before the shuffle, so that copies do not fill the buckets
    found = worded.groupBy(F.col("set_key").alias("cid")).agg(F.min("doc_id").alias("least_id"), F.min(row).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    found = put(found, "classes")
    classes = found.drop("bands")
    n_rows, n_classes = found.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()

    placed = found.select("cid", "n", F.explode("bands").alias("bucket"))
    heads = placed.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("low"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("size")).where("low.cid <> high")
    heads = put(heads.select("bucket", F.col("low.cid").alias("pivot"), F.col("low.n").alias("pivot_n"), "size"), "heads")
    hot, by_salt = _salts(heads, "bucket", "size", n_classes * BANDS)
    members = put(_salted(placed, hot, "bucket", F.col("cid")).join(by_salt, ["bucket", "_salt"]), "buckets", light=False)

    own = members.groupBy("cid").agg(F.first("n").alias("n"), F.min(F.struct("pivot", "pivot_n")).alias("low"), F.max((F.col("cid") == F.col("pivot")).cast("int")).alias("is_pivot"))
    own = put(own.select("cid", "n", F.col("low.pivot").alias("pivot"), F.col("low.pivot_n").alias("pivot_n"), (F.col("is_pivot") == 1).alias("is_pivot")), "candidates")
    candidates = own.select("cid", F.col("is_pivot").alias("pivot")).join(classes.select("cid", F.col("row.row_key").alias("row_key")), "cid")
    sets = put(_sets(candidates, docs, k, doc_id, text), "sets", light=False)

    first = own.where("cid <> pivot").where(_sizes_allow("n", "pivot_n")).select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    verified = put(_verify(first, sets, True), "verified")
    labels = linked(_linked(verified))

    def with_label(df: DataFrame, column: str, out: str) -> DataFrame:
        named = labels.select(F.col("node").alias(column), F.col("component").alias(out))
        return df.join(named, column, "left").withColumn(out, F.coalesce(out, column))

    def grouped() -> DataFrame:
        """Members with their group and that of their pivot, which is looked up once a bucket and not once a member."""
        of_pivot = with_label(by_salt, "pivot", "pivot_group").select("bucket", "_salt", "pivot_group")
        return with_label(members, "cid", "group").join(of_pivot, ["bucket", "_salt"])

    # other pivots of a class, where they are not in its group
    pairs = grouped().where("cid <> pivot and group <> pivot_group").where(_sizes_allow("n", "pivot_n")).select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = put(pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        second = put(_verify(pairs, sets, True), "verified")
        verified = verified.unionByName(second)
        if not _linked(second).isEmpty():
            labels = linked(_linked(verified))

    # what is left in buckets that hold several groups
    likeness = verified.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), (F.col("common") / F.col("joint")).alias("like"))
    left = grouped()
    mixed = left.where("group <> pivot_group").select("bucket").distinct().join(by_salt.select("bucket", "_salt"), "bucket")
    inside = left.join(mixed, ["bucket", "_salt"], "left_semi").where("cid <> pivot").join(likeness, ["cid", "pivot"], "left")
    inside = put(inside.select("bucket", "size", "cid", "n", "group", "pivot_group", "like"), "mixed")
    wide = put(_with_bits(sets.join(inside.select("cid").distinct(), "cid", "left_semi")), "bits")
    # a pair of rows meets in one cell: the block of the one by the block of the other
    blocks = F.ceil(F.col("size") / CELL_ROWS).cast("int")
    inside = inside.join(wide, "cid").withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    x = inside.where("group <> pivot_group").select("bucket", F.col("_block").alias("_i"), every.alias("_j"), F.col("bits").alias("bits_a"), F.col("bands").alias("bands_a"), F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("group").alias("group_a"), F.col("like").alias("like_a"))
    y = inside.select("bucket", F.col("_block").alias("_j"), every.alias("_i"), F.col("bits").alias("bits_b"), F.col("bands").alias("bands_b"), F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("group").alias("group_b"), F.col("like").alias("like_b"), (F.col("group") != F.col("pivot_group")).alias("out_b"))
    near = F.abs(F.col("like_a") - F.col("like_b")) <= (100 - PERCENT) / 100 + 1e-9
    differ = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(WIDE // 64)), F.lit(0))
    # a pair is taken in the first of the buckets that it shares
    shared = F.zip_with("bands_a", "bands_b", lambda p, q: p == q)
    first_shared = F.array_position(shared, True) == F.array_position("bands_a", F.col("bucket"))
    left = x.join(y, ["bucket", "_i", "_j"]).where("group_a <> group_b and (not out_b or a < b)").where(_sizes_allow("n_a", "n_b")).where(F.coalesce(near, F.lit(True))).where(differ <= apart).where(first_shared)
    left = put(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if not left.isEmpty():
        third = put(_verify(left, sets, False), "verified")
        if not _linked(third).isEmpty():
            labels = linked(_linked(verified.unionByName(third)))

    whole = classes.select("cid", "least_id", "rows").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("group", F.coalesce("component", "cid"))
    low = whole.groupBy("group").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    hot, spread = _salts(low, "group", "_n", n_classes)
    of_class = _salted(whole, hot, "group", F.col("cid")).join(spread, ["group", "_salt"]).select(F.col("cid").alias("class"), "group", "component_id", "rows")
    of_class = store(of_class, "groups", light=True)
    release(*made)
    hot, spread = _salts(of_class, "class", "rows", n_rows)
    light = rows.select("doc_id", "row_key", "n_shingles", F.col("set_key").alias("class"))
    named = _salted(light.where("class is not null"), hot, "class", F.monotonically_increasing_id()).join(spread, ["class", "_salt"])
    named = named.select("doc_id", "row_key", "n_shingles", "class", "group", "component_id")
    wordless = light.where("class is null").select("doc_id", "row_key", "n_shingles", "class", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return named.unionByName(wordless)


def remove(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the least ``doc_id`` (nulls last), all columns as they are.

    Rows without words are no copies of anything and stay.
    """
    names = docs.columns
    found = groups(docs, k, doc_id, text).where("group is not null")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best"))
    key = free_name(names, "kept_key")
    best = best.select(F.col("best.row_key").alias(key))
    worded = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # rows repeated with their id: one of them, before the shuffle
    kept = docs.where(worded).withColumn(key, _row_key(doc_id, text)).dropDuplicates([key]).join(best, key)
    return kept.select(*[F.col(f"`{c}`") for c in names]).unionByName(docs.where(~worded))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate ``documents``: 4-word shingles of whole texts, links from a Jaccard similarity of 0.8.

    Null, empty and blank texts have no shingles and are kept.  A row without id is kept only where
    no row of its group has an id; its ``component_id`` is the least id of the group, or null.  Repeated
    rows are all kept if one is.
    """
    found = groups(needed(table(spark, sf_dir, "documents"), "doc_id", "text"), 4)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


QUERIES = {"op6_minhash": op6_minhash}
SQL = {
    "op6_minhash": r"""
with recursive d as (select doc_id, row_number() over () r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct r, v from (select r, unnest(case when len(w) = 0 then [] when len(w) < 4 then [w] else [w[k:k+3] for k in range(1, len(w) - 2)] end) v from d)),
n as (select r, count(*) n from s group by r),
common as (select a.r a, b.r b, count(*) c from s a join s b on a.v = b.v and a.r < b.r group by all),
link as (select a, b from common join n x on x.r = a join n y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from link union select b, a from link),
reach as (select r a, r b from d union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
least as (select reach.a r, min(d.doc_id) component_id from reach join d on reach.b = d.r group by reach.a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, coalesce(d.doc_id = component_id, component_id is null) kept
from d join least using (r) left join n using (r)"""
}
