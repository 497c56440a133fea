"""Aggregate functions and their compatible forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = ("SUM", "COUNT", "MIN", "MAX", "AVG")
_WORD = "18446744073709551616"


def aggregate(name: str, column: str | None) -> Column:
    """SUM, COUNT, MIN, MAX or AVG of a column; only COUNT takes all rows (``None``)."""
    name = name.upper()
    if name not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {name}")
    if column is None:
        if name != "COUNT":
            raise ValueError(f"{name}(*) has no meaning; only COUNT(*) has")
        return F.count(F.lit(1))
    return {"SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "AVG": F.avg}[name](column)


def stats(column: str) -> list[Column]:
    """Sum, count, least, most and mean of a column, named ``<column>_sum`` and so on."""
    return [aggregate(f, column).alias(f"{column}_{f.lower()}") for f in FUNCTIONS]


def wrapping_sum(column: Column) -> Column:
    """Sum of 64-bit integers that wraps around instead of failing."""
    whole = F.sum(column.cast("decimal(38,0)"))
    shift = F.lit(1).cast("decimal(38,0)") * F.expr("CAST(9223372036854775808 AS DECIMAL(38,0))")
    return (F.pmod(whole + shift, F.expr(f"CAST({_WORD} AS DECIMAL(38,0))")) - shift).cast("long")


def exact_avg(column: Column) -> Column:
    """Mean of integers whose sum passes 2**53: the sum is exact before the one division."""
    return F.sum(column.cast("decimal(38,0)")).cast("double") / F.count(column)
