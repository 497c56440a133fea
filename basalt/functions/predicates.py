"""Comparison predicates: their columns, and the zone-map test of what they rule out."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = (">", ">=", "<", "<=", "=")


@dataclass(frozen=True)
class Predicate:
    """``column op literal``."""

    column: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown comparison {self.op!r}; one of {', '.join(OPS)}")


def literal(value: Any) -> Column:
    if isinstance(value, bool) or not isinstance(value, (int, float, str, decimal.Decimal, datetime.date)):
        raise TypeError(f"no literal of type {type(value).__name__}")
    return F.lit(value)


def compare(column: Column, op: str, value: Any, floating: bool | None = None) -> Column:
    """A comparison as SQL has it, but a float NaN matches nothing.

    floating: whether the column holds floats; if that isn't known, the literal tells.
    """
    made = {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value, "=": column == value}[op]
    return made & ~F.isnan(column) if (isinstance(value, float) if floating is None else floating) else made


def condition(predicate: Predicate, schema: T.StructType | None = None) -> Column:
    """The comparison over a table of this schema; its types decide where a NaN can be."""
    known = {f.name: isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in schema.fields} if schema else {}
    return compare(F.col(f"`{predicate.column}`"), predicate.op, predicate.value, known.get(predicate.column))


def conjunction(predicates: list[Predicate], schema: T.StructType | None = None) -> Column:
    whole = F.lit(True)
    for p in predicates:
        whole = whole & condition(p, schema)
    return whole


def approx_eq(column: Column, value: float, within: float = 1e-10) -> Column:
    """Equality of floats up to ``within``; NaN equals nothing."""
    return F.abs(column - F.lit(float(value))) < within


def date_from_days(days: int) -> Column:
    """The date so many days after 1970-01-01."""
    return F.date_from_unix_date(F.lit(days))


def prunes(op: str, value: Any, low: Any, high: Any) -> bool:
    """Whether no value in [low, high] can satisfy the comparison. Unknown bounds prune nothing."""
    if low is None or high is None:
        return False
    return {">": high <= value, ">=": high < value, "<": low >= value, "<=": low > value, "=": value < low or value > high}[op]


def prunes_column(op: str, value: Any, low: Column, high: Column) -> Column:
    """``prunes`` over columns of bounds."""
    v = literal(value)
    made = {">": high <= v, ">=": high < v, "<": low >= v, "<=": low > v, "=": (v < low) | (v > high)}[op]
    return F.coalesce(made, F.lit(False))
