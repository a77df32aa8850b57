"""HyperLogLog counters as sparse rows ``id, reg, rank``, and neighbourhood sizes by their union.

An absent register is rank 0.  The union of counters is a grouped maximum, which combines before the
shuffle; a counter never has more rows than registers.  Loops hold a counter as bits by rank, most of
whose upper ranks are empty and have no rows, and send of it what the round before added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.functions.hashing import with_jenkins64
from meshframe.plans.scratch import drop, keep

# Bias constants by the number of registers.
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}


@dataclass(frozen=True)
class Parameters:
    """Registers, scale and the small-range threshold for a relative standard deviation (P25, M7)."""

    rsd: float

    @property
    def log2_m(self) -> int:
        return math.ceil(math.log2((1.106 / self.rsd) ** 2))

    @property
    def m(self) -> int:
        return 1 << self.log2_m

    @property
    def alpha_mm(self) -> float:
        return ALPHA.get(self.m, 0.7213 / (1 + 1.079 / self.m)) * self.m * self.m

    @property
    def threshold(self) -> float:
        return self.alpha_mm / (5 * self.m / 2)


def with_parameters(df: DataFrame, rsd: str = "rsd") -> DataFrame:
    """``df`` with ``m, alpha_mm, threshold`` for a column of deviations, as :class:`Parameters` has them (P25)."""
    m = F.pow(F.lit(2), F.ceil(F.log2(F.pow(1.106 / F.col(rsd), F.lit(2))))).cast("int")
    alpha = 0.7213 / (1 + 1.079 / F.col("m"))
    for size, fixed in ALPHA.items():
        alpha = F.when(F.col("m") == size, F.lit(fixed)).otherwise(alpha)
    return df.withColumn("m", m).withColumn("alpha_mm", alpha * F.col("m") * F.col("m")).withColumn("threshold", F.col("alpha_mm") / (5 * F.col("m") / 2))


def register(h: Column, p: Parameters) -> Column:
    return h.bitwiseAND(F.lit(p.m - 1).cast("bigint")).cast("int")


def first_set(h: Column, p: Parameters) -> Column:
    """The place of the lowest set bit, from 1, in the low 32 bits of the hash above its register number; 0 without one."""
    low = F.shiftrightunsigned(h, p.log2_m).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.when(low == 0, 0).otherwise(F.bit_count(low.bitwiseXOR(low - 1))).cast("int")


def counters(vertices: DataFrame, p: Parameters) -> DataFrame:
    """``id, reg, rank``: the counter of each vertex that holds itself (A5, M5)."""
    hashed = with_jenkins64(vertices.select("id"), "id", "h")
    return hashed.select("id", register(F.col("h"), p).alias("reg"), first_set(F.col("h"), p).alias("rank"))


def union(*parts: DataFrame) -> DataFrame:
    """Counters united by register-wise maximum."""
    every = parts[0].select("id", "reg", "rank")
    for x in parts[1:]:
        every = every.unionByName(x.select("id", "reg", "rank"))
    return every.groupBy("id", "reg").agg(F.max("rank").alias("rank"))


def sent(edges: DataFrame, state: DataFrame) -> DataFrame:
    """The registers that sources send along their edges, one row a target and register."""
    return edges.join(state, edges["src"] == state["id"]).groupBy(F.col("dst").alias("id"), "reg").agg(F.max("rank").alias("rank"))


def _harmonic(total: Column, zeros: Column, p: Parameters) -> Column:
    """The harmonic estimate, or linear counting where zeros remain and the sum is above the threshold."""
    small = (zeros > 0) & (total > p.threshold)
    return F.when(small, p.m * F.log(p.m / F.when(small, zeros))).otherwise(p.alpha_mm / total)


def estimate(state: DataFrame, p: Parameters) -> DataFrame:
    """``id, estimate`` (A6) of counters in rows."""
    used = F.col("rank") > 0
    found = state.groupBy("id").agg(F.coalesce(F.sum(F.when(used, F.pow(F.lit(2.0), -F.col("rank")))), F.lit(0.0)).alias("s"), F.count_if(used).alias("used"))
    zeros = p.m - F.col("used")
    return found.select("id", _harmonic(F.col("s") + zeros, zeros, p).alias("estimate"))


PART = 16  # registers whose growth is counted as one
WORDS = 8  # of 64 bits in a row: few enough columns that aggregates over them are compiled
_W, _D = [f"w{i}" for i in range(WORDS)], [f"d{i}" for i in range(WORDS)]


def _any(columns: list[str]) -> Column:
    found = F.col(columns[0])
    for c in columns[1:]:
        found = found.bitwiseOR(F.col(c))
    return found != 0


def _a_level(p: Parameters) -> int:
    """Words that hold a bit of each register."""
    return max(1, p.m // 64)


def _lanes(p: Parameters, columns: list[str]) -> list[tuple[Column, list[Column]]]:
    """For each part of ``PART`` registers that a row has bits of, its number and these bits, a column a level."""
    a_level = _a_level(p)
    period = min(a_level, WORDS)  # words are numbered by level and register, so a row has whole levels or a share of one
    share = F.pmod(F.col("row"), F.lit(max(1, a_level // WORDS)))
    mask = F.lit((1 << PART) - 1).cast("bigint")
    out = []
    for k in range(period):
        for lane in range(max(1, min(64, p.m) // PART)):
            part = ((share * WORDS + k) * (64 // PART) + lane).cast("int")
            out.append((part, [F.shiftrightunsigned(c, PART * lane).bitwiseAND(mask) for c in columns[k::period]]))
    return out


def packed(vertices: DataFrame, p: Parameters) -> DataFrame:
    """``id, row, w0, w1, ...``: the counter of each vertex that holds itself, as bits in rows of ``WORDS`` words.

    A register of rank r has its bit set in the levels 1 to r, so a union is a bitwise or, and what it adds to
    a counter are the bits that it sets.  Rows of zeros are left out but for the first.
    """
    a_level = _a_level(p)
    at, bit = F.floor(F.col("reg") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("reg"), F.lit(64)))
    last = F.when(F.col("rank") > 0, F.floor(((F.col("rank") - 1) * a_level + at) / WORDS)).otherwise(0).cast("int")
    rows = counters(vertices, p).select("id", "rank", at.alias("at"), bit.alias("bit"), F.explode(F.sequence(F.lit(0), last)).alias("row"))
    word = [F.col("row") * WORDS + c for c in range(WORDS)]
    held = [F.when((F.pmod(x, F.lit(a_level)) == F.col("at")) & (F.floor(x / a_level) < F.col("rank")), F.col("bit")).otherwise(F.lit(0).cast("bigint")) for x in word]
    return rows.select("id", "row", *[x.alias(w) for w, x in zip(_W, held, strict=True)]).where((F.col("row") == 0) | _any(_W))


def packed_estimate(state: DataFrame, p: Parameters) -> DataFrame:
    """``id, estimate`` of counters in bits; the sums of powers of two are exact."""
    a_level = _a_level(p)
    level = [F.floor((F.col("row") * WORDS + c) / a_level) + 1 for c in range(WORDS)]
    less = sum((F.bit_count(w) * F.pow(F.lit(2.0), -at) for w, at in zip(_W, level, strict=True)), F.lit(0.0))
    used = sum((F.when(at == 1, F.bit_count(w)).otherwise(0) for w, at in zip(_W, level, strict=True)), F.lit(0))
    found = state.groupBy("id").agg(F.sum(less).alias("less"), F.sum(used).alias("used"))
    return found.select("id", _harmonic(p.m - F.col("less"), p.m - F.col("used"), p).alias("estimate"))


def parted(state: DataFrame, p: Parameters) -> DataFrame:
    """``id, part, r0, r1, ...``: counters in bits as ranks, in rows of ``PART`` registers."""
    each = [F.struct(part.alias("part"), F.array(*bits).alias("bits")) for part, bits in _lanes(p, _W)]
    rows = state.select("id", F.explode(F.array(*each)).alias("e")).select("id", "e.part", F.explode("e.bits").alias("bits"))
    ranks = [F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1).cast("bigint"))).cast("tinyint").alias(f"r{i}") for i in range(min(PART, p.m))]
    return rows.groupBy("id", "part").agg(*ranks)


@dataclass
class Balls:
    """Counters of what reaches each vertex, in bits, and of each round how many parts of counters grew before it and how many copies of them went along edges."""

    packed: DataFrame
    p: Parameters
    rounds: list[tuple[int, int]] = field(default_factory=list)

    @property
    def state(self) -> DataFrame:
        """The counters as ranks, in parts."""
        return parted(self.packed, self.p)


def _united(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("id", "row").agg(*[F.bit_or(c).alias(c) for c in (*_W, *more)])


def spread(state: DataFrame, edges: DataFrame, last: bool = False) -> DataFrame:
    """Counters in bits after a round in which only bits that the last one set are sent (J1, A3, A4, P6), and in ``d0, d1, ...`` those that this one set.

    All a vertex sends along an edge is one row or a few.  ``last`` leaves out what the next round would need.
    """
    sent = edges.join(state.where(_any(_D)), edges["src"] == state["id"]).select(F.col("dst").alias("id"), "row", *[F.col(d).alias(w) for w, d in zip(_W, _D, strict=True)])
    own = state.select("id", "row", *_W)
    if last:
        return _united(own.unionByName(sent))
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = own.select("*", *[F.col(w).alias(d) for w, d in zip(_W, _D, strict=True)]).unionByName(_united(sent).select("*", *[F.lit(0).cast("bigint").alias(d) for d in _D]))
    new = _united(both.repartition(n, "id"), *_D)
    return new.select("id", "row", *_W, *[F.col(w).bitwiseAND(F.bitwise_not(d)).alias(d) for w, d in zip(_W, _D, strict=True)])


def _grown(state: DataFrame, out_degree: DataFrame, p: Parameters) -> tuple[int, int]:
    """How many parts with edges to go along grew, and how often they go."""
    kind = [F.struct(part.alias("part"), (sum((F.when(b != 0, 1).otherwise(0) for b in bits), F.lit(0)) > 0).alias("grew")) for part, bits in _lanes(p, _D)]
    parts = state.where(_any(_D)).select("id", F.explode(F.array(*kind)).alias("e")).where("e.grew").select("id", "e.part").distinct()
    each = parts.groupBy("id").agg(F.count(F.lit(1)).alias("parts"))
    row = each.join(out_degree, each["id"] == out_degree["src"]).agg(F.sum("parts"), F.sum(F.col("parts") * F.col("out"))).first()
    return row[0] or 0, row[1] or 0


def balls(vertices: DataFrame, edges: DataFrame, p: Parameters, most_rounds: int | None = None, each_round: Callable[[int, DataFrame], None] | None = None) -> Balls:
    """Rounds of :func:`spread` until no counter grows, or ``most_rounds``; ``each_round`` gets the state of every round in bits, the first too."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    simple = edges.select("src", "dst").repartition(n, "src").distinct()  # the union is idempotent: repeated edges add nothing
    edges = keep(simple, "src", "ball-edges")
    out_degree = keep(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src", "ball-degrees")
    dealt = vertices.select("id").repartition(n, "id")  # hashing costs more than reading: it is not left to the few tasks of a small file
    found = Balls(keep(packed(dealt, p).select("*", *[F.col(w).alias(d) for w, d in zip(_W, _D, strict=True)]), "id", "balls"), p)
    if each_round:
        each_round(0, found.packed)
    while (most_rounds is None or len(found.rounds) < most_rounds) and (now := _grown(found.packed, out_degree, p))[0]:
        found.rounds.append(now)
        if len(found.rounds) == most_rounds and each_round is None:
            found.packed = spread(found.packed, edges, last=True)  # the last of a given number is not written
            return found
        found.packed = keep(spread(found.packed, edges), "id", "balls", instead_of=found.packed)
        if each_round:
            each_round(len(found.rounds), found.packed)
    drop(edges, out_degree)
    return found


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, changed``: whether any register of a counter grew (A4)."""
    before = old.select("id", "reg", F.col("rank").alias("_old"))
    return new.join(before, ["id", "reg"], "left").groupBy("id").agg(F.bool_or(F.col("rank") > F.coalesce("_old", F.lit(0))).alias("changed"))


def hyperanf(vertices: DataFrame, edges: DataFrame, rounds: int | None, rsd: float = 0.1) -> DataFrame:
    """``id, estimate`` of how many vertices reach each in at most ``rounds`` steps, itself included (I2, P6); without a number, in any.

    A round sends only what grew in the last one, and the loop ends when nothing did.
    """
    p = Parameters(rsd)
    return packed_estimate(balls(vertices, edges, p, rounds).packed, p)


def neighbourhood_function(vertices: DataFrame, edges: DataFrame, rounds: int, rsd: float = 0.1) -> DataFrame:
    """``t, pairs``: the estimated number of pairs within ``t`` steps, for ``t`` from 0 to ``rounds``; estimates count to four digits.

    Rounds after the last in which a counter grew repeat its number.
    """
    p = Parameters(rsd)
    pairs: list[float | None] = []

    def add(t: int, state: DataFrame) -> None:
        pairs.append(packed_estimate(state, p).agg(F.sum(F.round("estimate", 4))).first()[0])

    balls(vertices, edges, p, rounds, add)
    pairs += pairs[-1:] * (rounds + 1 - len(pairs))
    return vertices.sparkSession.createDataFrame(list(enumerate(pairs)), "t int, pairs double")
