"""Bit interleaving as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shifts and masks that spread 32 bits over the even bits of 64; fixed values.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
SIGN = -(1 << 63)


def spread(x: Column) -> Column:
    for by, mask in SPREAD:
        x = (x.bitwiseOR(F.shiftleft(x, by))).bitwiseAND(F.lit(mask))
    return x


def zorder(a: Column, b: Column) -> Column:
    """Morton key of two unsigned 32-bit numbers (as longs): a on even bits, b on odd ones."""
    return spread(a).bitwiseOR(F.shiftleft(spread(b), 1))


def sortable(key: Column) -> Column:
    """An unsigned 64-bit key as a long that sorts the same way."""
    return key.bitwiseXOR(F.lit(SIGN))


def normalised(value: Column, low: int, high: int) -> Column:
    """A number of [low, high] as an unsigned 32-bit number."""
    scale = 4294967295.0 / (high - low) if high > low else 0.0
    return F.least(F.floor((value - F.lit(low)).cast("double") * F.lit(scale)), F.lit(4294967295)).cast("long")
