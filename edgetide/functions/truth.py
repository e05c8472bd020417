"""Local logic functions as truth tables: bit i of a BIGINT is the value at input assignment i (input p is bit p)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inputs that fit one BIGINT.
MAX_INPUTS = 6
# Where input p is 1 among the 64 assignments of six inputs, as signed longs.
INPUT_MASK = (-6148914691236517206, -3689348814741910324, -1085102592571150096, -71777214294589696, -281470681808896, -4294967296)


def _long(x) -> Column:
    return F.lit(x).cast("long")


def cofactor(tt: Column, pin: int, value: Column) -> Column:
    """The table with input ``pin`` held at ``value`` (0 or 1), spread so that it no longer depends on that input."""
    mask, width = _long(INPUT_MASK[pin]), 1 << pin
    high = tt.bitwiseAND(mask)
    low = tt.bitwiseAND(F.bitwise_not(mask))
    return F.when(value == 1, high.bitwiseOR(F.shiftrightunsigned(high, width))).otherwise(low.bitwiseOR(F.shiftleft(low, width)))


def cofactor_at(tt: Column, pin: Column, value: Column) -> Column:
    """cofactor for a pin that is itself a column."""
    out = F.lit(None).cast("long")
    for p in range(MAX_INPUTS):
        out = F.when(pin == p, cofactor(tt, p, value)).otherwise(out)
    return out


def value_at(tt: Column, assignment: Column) -> Column:
    return F.call_function("shiftrightunsigned", tt, assignment.cast("int")).bitwiseAND(_long(1)).cast("int")


def cube_bits(bits: str) -> int:
    """Assignments that a cover row's input part (0, 1, - by input) holds, as a signed long."""
    k = len(bits)
    if k > MAX_INPUTS:
        raise ValueError(f"a cover of {k} inputs does not fit one word")
    held = [i for i in range(1 << k) if all(b == "-" or int(b) == i >> p & 1 for p, b in enumerate(bits))]
    word = reduce(lambda x, i: x | 1 << i, held, 0)
    return word - (1 << 64) if word >> 63 else word


def cover_table(rows: list[tuple[str, str]]) -> int:
    """Truth table of a cover. The first row says whether rows list where the function is 1 or where it is 0."""
    if not rows:
        return 0
    k = len(rows[0][0])
    every = (1 << (1 << k)) - 1
    on = reduce(lambda x, r: x | cube_bits(r[0]), rows, 0) & ((1 << 64) - 1)
    word = on if rows[0][1] == "1" else every & ~on
    return word - (1 << 64) if word >> 63 else word


def gray(i: Column) -> Column:
    return i.bitwiseXOR(F.shiftright(i, 1))


def transition(before: Column, after: Column) -> Column:
    """R, F, H or L for two logic values; X if either is unknown."""
    pair = F.concat(before.cast("string"), after.cast("string"))
    return F.when(pair == "01", "R").when(pair == "10", "F").when(pair == "11", "H").when(pair == "00", "L").when(pair.contains("x"), "X")


def final_class(trans: Column) -> Column:
    return F.when(trans.isin("R", "H"), "high").when(trans.isin("F", "L"), "low")


def rank(trans: Column) -> Column:
    """The order R, F, H, L."""
    return F.when(trans == "R", 0).when(trans == "F", 1).when(trans == "H", 2).when(trans == "L", 3).otherwise(4)
