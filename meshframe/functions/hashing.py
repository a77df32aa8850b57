"""A 64-bit integer mix as column expressions, with arithmetic modulo 2 ** 64 on signed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seed, golden-ratio word, and the shifts of the twelve rounds (right for the even ones of a triple pattern R, L, R).
SEED, GOLDEN = 0xDEADBEEF, 0x9E3779B97F4A7C13
SHIFTS = [43, 9, 8, 38, 23, 5, 35, 49, 11, 12, 18, 22]


def signed(x: int) -> int:
    """The signed 64-bit number with the bits of ``x``."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def wrapping_subtract(a: Column, b: Column) -> Column:
    """``a - b`` modulo 2 ** 64; plain subtraction raises on overflow under ANSI rules.

    The halves of 32 bits are subtracted apart, the borrow is carried, and the upper half is cut.
    """
    low = F.lit(0xFFFFFFFF).cast("bigint")
    d = a.bitwiseAND(low) - b.bitwiseAND(low)
    high = F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32) + F.shiftright(d, 32)
    return F.shiftleft(high, 32).bitwiseOR(d.bitwiseAND(low))


def jenkins64(x: Column, seed: int = SEED) -> Column:
    """The mix of a bigint column, as a signed number (P20).

    Three words take turns: one loses the two others and is combined with a shift of the last one, and
    becomes the last itself.  The rounds are a fold over the shifts, so the expression stays small
    wherever the optimizer moves it; written out, it would double with every round.
    """
    rounds = F.array(*[F.struct(F.lit(n % 3 == 1).alias("left"), F.lit(by).alias("by")) for n, by in enumerate(SHIFTS)])

    def word(c: Column, name: str) -> Column:
        return c.cast("bigint").alias(name)

    start = F.struct(word(wrapping_subtract(x, F.lit(signed(-seed))), "own"), word(F.lit(signed(seed)), "first"), word(F.lit(signed(GOLDEN)), "last"))

    def turn(w: Column, r: Column) -> Column:
        rest = wrapping_subtract(wrapping_subtract(w["own"], w["first"]), w["last"])
        moved = F.when(r["left"], F.call_function("shiftleft", w["last"], r["by"])).otherwise(F.call_function("shiftrightunsigned", w["last"], r["by"]))
        return F.struct(word(w["first"], "own"), word(w["last"], "first"), word(rest.bitwiseXOR(moved), "last"))

    return F.aggregate(rounds, start, turn)["last"]


def with_jenkins64(df: DataFrame, column: str, out: str, seed: int = SEED) -> DataFrame:
    """``df`` with :func:`jenkins64` of a column."""
    return df.withColumn(out, jenkins64(F.col(column), seed))
