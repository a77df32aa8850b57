"""Sharding in Hilbert-curve order of several metadata dimensions.

Each dimension is cut into ``2 ** bits`` classes of nearly equal counts at quantiles of all rows,
approximate ones of numbers and exact ones of whole strings; the classes are the coordinates of a cell,
and the place of the cell on a Hilbert curve is its index.  Rows are put in the order of the index and cut into runs of equal counts.  Cells that
are near on the curve are near in every dimension, so that each shard covers a small range of each
and files can be skipped by their least and greatest values.

The place of a row in the whole order is found without a sort of all rows: rows are counted by cell
and salt (a hash of the row), the counts are summed along the curve, and a row is numbered within
its cell and salt.  The number of salts follows the number of rows, so a cell that holds a third of
all rows is numbered by many tasks.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import free_name, needed, store, table

BITS = 4
SHARDS = 24
ROWS_PER_SALT = 200
_CUT_ACCURACY = 10_000


def string_cuts(df: DataFrame, value: Column, bits: int) -> list[str]:
    """The least strings that at least ``i / 2 ** bits`` of all rows reach up to, for each ``i``, without repeats; nulls are left out.

    Distinct strings are counted, sorted by ranges, and their counts summed along the ranges.
    """
    counted = df.select(value.alias("s")).where("s is not null").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranged = store(counted.repartitionByRange("s").select("s", "n", F.spark_partition_id().alias("p")), "strings")
    sums = ranged.groupBy("p").agg(F.sum("n").alias("n"))  # a row a range
    along = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = sums.select("p", (along(Window.orderBy("p")) - F.col("n")).alias("before"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reached = ranged.join(F.broadcast(upto), "p").select("s", (F.col("before") + along(Window.partitionBy("p").orderBy("s"))).alias("upto"))
    found = reached.agg(*[F.min(F.when(F.col("upto") * (1 << bits) >= total * i, F.col("s"))).alias(f"c{i}") for i in range(1, 1 << bits)]).first()
    return sorted({c for c in found if c is not None})


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The place on a Hilbert curve (bigint) of a cell with coordinates 0 to ``2 ** bits - 1``.

    The steps are those of the transpose form of the curve: turn the axes from the highest bit down,
    take the Gray code across the axes, undo its carries, and interleave the bits.
    """
    n = len(coordinates)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    power = [F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)]

    def turn(a: Column, s: Column) -> Column:
        low = s["q"] - one
        own = F.get(a, s["i"])

        def turned(own: Column) -> Column:
            inverted = F.transform(a, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            swap = F.get(a, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
            swapped = F.transform(a, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
            return F.when(own.bitwiseAND(s["q"]) != 0, inverted).otherwise(swapped)

        return _let(own, turned)

    axes = F.array(*[c.cast("bigint") for c in coordinates])
    if bits > 1:
        axes = F.aggregate(F.array(*[F.struct(q.alias("q"), F.lit(i).alias("i")) for q in power for i in range(n)]), axes, turn)

    def gray(x: Column) -> Column:
        return F.aggregate(F.slice(x, 2, max(1, n - 1)), F.slice(x, 1, 1), lambda a, v: F.concat(a, F.array(v.bitwiseXOR(F.element_at(a, -1)))))

    def merged(x: Column) -> Column:
        carry = zero
        if bits > 1:
            carry = F.aggregate(F.array(*power), zero, lambda t, q: F.when(F.element_at(x, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - one)).otherwise(t))
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda p, c: F.call_function("shiftright", F.get(x, p["i"]).bitwiseXOR(c), p["b"]).bitwiseAND(one)
        return _let(carry, lambda c: F.aggregate(places, zero, lambda t, p: t * 2 + bit(p, c)))

    return _let(_let(axes, gray), merged)


def shard(df: DataFrame, dimensions: dict[str, Column], keys: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``hilbert`` (bigint), ``shard`` (int) and ``slot`` (bigint, from 0 in each shard).

    ``dimensions`` are numbers or strings; null is below all values.  ``keys`` tell rows apart and order
    those of a cell; rows equal in all keys lie in any order among themselves, and in one shard or in
    several, as counts want it.  Shards hold runs of the curve, and their counts differ by at most one;
    with fewer rows than shards, later shards are empty.  Older columns with the names of the results
    are replaced.
    """
    names = [c for c in df.columns if c.lower() not in ("hilbert", "shard", "slot")]
    taken = [*df.columns, "hilbert", "shard", "slot"]
    values = [free_name(taken, f"dimension_{i}") for i in range(len(dimensions))]
    rows_, start_, salts_, salt_, number_, rank_ = (free_name(taken, x) for x in ("rows", "start", "salts", "salt", "number", "rank"))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns], *[d.alias(v) for d, v in zip(dimensions.values(), values, strict=True)]).drop("hilbert", "shard", "slot")
    kinds = {v: df.schema[v].dataType for v in values}
    numeric = [v for v in values if kinds[v] != T.StringType()]
    at = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    # one row: the count and 2 ** bits - 1 cuts a dimension
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(v).cast("double"), at, _CUT_ACCURACY).alias(v) for v in numeric]).first()
    n = found["n"]
    cells = df
    for v in values:
        cuts = sorted(set(found[v] or [])) if v in numeric else string_cuts(df, F.col(v), bits)
        reached = [F.when((F.col(v).cast("double") if v in numeric else F.col(v)) >= F.lit(c), 1).otherwise(0) for c in cuts]
        cells = cells.withColumn(v, sum(reached, F.lit(0)))  # null reaches no cut
    # at most 2 ** (bits * dimensions) rows, whatever the size of df
    per_salt = max(ROWS_PER_SALT, int(n**0.5))
    counts = cells.groupBy(*values).agg(F.count(F.lit(1)).alias(rows_)).withColumn("hilbert", hilbert_index([F.col(v) for v in values], bits))
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    curve = counts.select(*values, "hilbert", F.coalesce(F.sum(rows_).over(before), F.lit(0)).alias(start_), F.ceil(F.col(rows_) / per_salt).alias(salts_))
    salted = cells.join(F.broadcast(curve), values).drop(*values).withColumn(salt_, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.col(salts_)))
    parts = salted.groupBy("hilbert", salt_).agg(F.count(F.lit(1)).alias(rows_), F.first(start_).alias(start_))
    earlier = Window.partitionBy("hilbert").orderBy(salt_).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("hilbert", salt_, (F.col(start_) + F.coalesce(F.sum(rows_).over(earlier), F.lit(0))).alias(start_))
    own = Window.partitionBy("hilbert", salt_).orderBy(*[F.col(f"`{k}`") for k in keys])
    placed = salted.drop(start_).withColumn(number_, F.row_number().over(own)).join(parts, ["hilbert", salt_])
    whole, more = divmod(n, shards)
    edge = more * (whole + 1)
    number = F.expr(f"if({rank_} < {edge}L, {rank_} div {whole + 1}L, {more}L + ({rank_} - {edge}L) div {max(1, whole)}L)")
    placed = placed.withColumn(rank_, F.col(start_) + F.col(number_) - 1).withColumn("shard", number.cast("int"))
    first = F.when(F.col("shard") < more, F.col("shard").cast("bigint") * (whole + 1)).otherwise(edge + (F.col("shard").cast("bigint") - more) * whole)
    return placed.withColumn("slot", F.col(rank_) - first).select(*[F.col(f"`{c}`") for c in names], "hilbert", "shard", "slot")


def statistics(placed: DataFrame, columns: list[str]) -> DataFrame:
    """``shard, n`` and ``least_<column>, greatest_<column>`` of each: what lets a reader skip shards; null where a shard has nulls alone."""
    ends = [e for c in columns for e in (F.min(f"`{c}`").alias(f"least_{c}"), F.max(f"`{c}`").alias(f"greatest_{c}"))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *ends)


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards along a Hilbert curve of source, language and size; law ``rows``.

    Null and empty texts have size 8 and checksum 0, and null sources, languages and ids lie below all
    others.  Equal texts, as all rows, are dealt by place on the curve, so a group of copies may span
    shards where the law ``rows`` wants it; repeated rows each get a slot.  Texts of any length count
    whole, extra columns are left behind, and an empty table gives no rows.
    """
    docs = needed(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data).cast("bigint") + 8).alias("size"), F.crc32(data).alias("text_crc32"), "source", "lang")
    rows = store(rows, "shard-rows")
    placed = shard(rows, {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size")}, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op3_hilbert": op3_hilbert}
SQL: dict[str, str] = {}
