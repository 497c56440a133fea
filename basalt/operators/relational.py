"""Filter, project, aggregate, join, sort and top-n over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.aggregates import aggregate
from basalt.functions.predicates import Predicate, conjunction
from basalt.plans.cost import HASH_BYTES, JoinChoice


def filter_rows(df: DataFrame, *predicates: Predicate) -> DataFrame:
    return df.filter(conjunction(list(predicates), df.schema)) if predicates else df


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*dict.fromkeys(columns))


def aggregate_rows(df: DataFrame, keys: list[str], aggs: list[tuple[str, str | None, str]], compat_empty: bool = False) -> DataFrame:
    """Groups by ``keys``; ``aggs`` are (function, column, name).

    compat_empty: a global aggregate over no rows gives no row instead of one.
    """
    made = [aggregate(f, c).alias(n) for f, c, n in aggs]
    if keys or not compat_empty:
        return df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
    return df.agg(*made, F.count(F.lit(1)).alias("__rows")).filter("__rows > 0").drop("__rows")


def join_rows(left: DataFrame, right: DataFrame, on: Column | list[str], choice: JoinChoice | None = None, how: str = "inner") -> DataFrame:
    """An equi-join. With a choice, its build side is broadcast, or both sides are hashed with the build side named.

    The hints are only given for a side that the cost model holds under its bounds: a hashed
    partition can't spill, so a build side of more than ``HASH_BYTES`` for each partition is
    left to Spark, which sorts, spills and splits skewed keys.
    """
    if choice is not None and how == "inner" and (choice.strategy == "broadcast" or choice.build_bytes <= HASH_BYTES * choice.partitions):
        hint = "broadcast" if choice.strategy == "broadcast" else "shuffle_hash"
        left, right = (left.hint(hint), right) if choice.build == "left" else (left, right.hint(hint))
    return left.join(right, on, how)


def top_n(df: DataFrame, key: str, n: int | None, descending: bool = False) -> DataFrame:
    """Ordered by ``key``, then by all other columns, so that a limit has one answer."""
    order = [F.col(f"`{key}`").desc() if descending else F.col(f"`{key}`").asc(), *(F.col(f"`{c}`").asc() for c in df.columns if c != key)]
    sortable = [o for o, c in zip(order, [key, *(c for c in df.columns if c != key)], strict=True) if df.schema[c].dataType.typeName() not in ("map", "variant")]
    out = df.orderBy(*sortable)
    return out if n is None else out.limit(n)
