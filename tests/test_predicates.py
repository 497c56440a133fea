"""Predicates, zone-map tests, bit interleaving, estimates, sizing and work units."""

import datetime
import decimal
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.functions.aggregates import aggregate, exact_avg, wrapping_sum
from basalt.functions.predicates import OPS, Predicate, approx_eq, compare, prunes, prunes_column
from basalt.functions.zorder import normalised, sortable, zorder
from basalt.operators.cluster import WorkloadStats
from basalt.plans.cost import choose_join, estimate_rows, selectivity
from basalt.streaming.epochs import Sizer, WorkUnit, plan_work

PYTHON = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}


@given(st.sampled_from(OPS), st.integers(-8, 8), st.integers(-8, 8), st.integers(0, 8))
def test_prunes_only_what_cannot_match(op, value, low, width):
    can = any(PYTHON[op](v, value) for v in range(low, low + width + 1))
    assert prunes(op, value, low, low + width) == (not can)


@pytest.mark.parametrize("op", OPS)
def test_prunes_column_is_prunes(spark, op):
    cases = [(low, high) for low in range(-2, 3) for high in range(low, 3)] + [(None, None)]
    df = spark.createDataFrame(cases, "low long, high long")
    got = {(r.low, r.high): r.p for r in df.withColumn("p", prunes_column(op, 0, F.col("low"), F.col("high"))).collect()}
    assert got == {c: prunes(op, 0, *c) for c in cases}


def test_nan_matches_nothing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (0.05,)], "x double")
    for op in OPS:
        assert df.filter(compare(F.col("x"), op, 0.05)).filter(F.isnan("x")).count() == 0
    assert df.filter(approx_eq(F.col("x"), 0.05 + 1e-12)).count() == 1


def test_unknown_comparison():
    with pytest.raises(ValueError):
        Predicate("a", "!=", 1)
    with pytest.raises(ValueError):
        aggregate("SUM", None)


def test_zorder_is_bit_exact(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (2**32 - 1, 0), (0, 2**32 - 1), (2**32 - 1, 2**32 - 1), (123456789, 987654321)]

    def morton(a, b):
        z = sum(((a >> i) & 1) << (2 * i) | ((b >> i) & 1) << (2 * i + 1) for i in range(32))
        return z - (1 << 64) if z >= 1 << 63 else z

    rows = spark.createDataFrame(pairs, "a long, b long").withColumn("z", zorder(F.col("a"), F.col("b"))).withColumn("s", sortable(F.col("z"))).collect()
    assert all(r.z == morton(r.a, r.b) for r in rows)
    unsigned = sorted(rows, key=lambda r: r.z % (1 << 64))
    assert [r.s for r in unsigned] == sorted(r.s for r in rows)


def test_normalised(spark):
    rows = spark.createDataFrame([(5,), (10,), (15,)], "v long")
    got = [r[0] for r in rows.select(normalised(F.col("v"), 5, 15)).collect()]
    assert got == [0, math.floor(5 * (4294967295.0 / 10)), 4294967295]
    assert rows.select(normalised(F.col("v"), 7, 7)).distinct().count() == 1


def test_wrapping_sum_and_exact_avg(spark):
    df = spark.createDataFrame([(2**63 - 1,), (1,), (5,)], "v long")
    assert df.agg(wrapping_sum(F.col("v"))).first()[0] == -(2**63) + 5
    assert df.agg(exact_avg(F.col("v"))).first()[0] == (2**63 + 5) / 3
    assert df.filter("false").agg(wrapping_sum(F.col("v"))).first()[0] is None


def test_choose_keys():
    stats = WorkloadStats()
    for c, n in (("c3", 12), ("c0", 40), ("c1", 12)):
        stats.record(c, n)
    assert stats.choose_keys(["c0", "c1", "c2", "c3"]) == ["c0", "c1"]


def test_cost_of_the_broadcast_join():
    p = Predicate("ts", ">", 33_000_000)
    rows = estimate_rows(1_000_000, [p], {"ts": (30_000_000, 40_000_000)})
    assert rows == 700_000
    choice = choose_join(rows, 200)
    assert (choice.build, choice.strategy) == ("right", "broadcast")


def test_cost_of_the_shuffle_join():
    rows = estimate_rows(4_000_000, [Predicate("amount", ">", 900)], {"amount": (1, 1000)})
    assert rows == pytest.approx(400_400, abs=5)
    choice = choose_join(rows, 1_000_000)
    assert (choice.build, choice.strategy, choice.partitions) == ("left", "shuffle", 16)
    assert choose_join(5, 5).build == "left"


def test_selectivity():
    assert selectivity(Predicate("s", ">", "x"), 1, 2) == 0.1
    assert selectivity(Predicate("a", "=", 5), 1, 10) == pytest.approx(0.1)
    assert selectivity(Predicate("a", "=", 5), 1, 10**6) == pytest.approx(0.001)
    assert selectivity(Predicate("a", "<", 0), 1, 10) == 0
    assert estimate_rows(10, [Predicate("a", "<", 0)], {"a": (1, 10)}) == 1


def test_sizer():
    s = Sizer(100, 8, 1, 50)
    assert [s.workers(n) for n in (0, 50, 250, 10000)] == [0, 1, 3, 8]
    assert Sizer() == Sizer(10_000, 64, 1, 4096)


@given(st.dictionaries(st.integers(0, 5), st.integers(0, 300), max_size=4), st.integers(1, 70))
def test_work_units_cover_the_lag_once(high, most):
    committed = {p: n // 3 for p, n in high.items()}
    units = plan_work(committed, high, most)
    assert all(0 < u.end - u.start <= most for u in units)
    for p in high:
        assert [o for u in units if u.partition == p for o in range(u.start, u.end)] == list(range(committed[p], high[p]))
    assert plan_work({}, {0: 3}, 2) == [WorkUnit(0, 0, 2), WorkUnit(0, 2, 3)]


def test_compare_types(spark):
    df = spark.createDataFrame([(1, 1.5, datetime.date(1996, 6, 1), decimal.Decimal("10.50"), "N")], "l long, d double, t date, e decimal(18,2), s string")
    for column, value in (("l", 1), ("d", 1.5), ("t", datetime.date(1996, 6, 1)), ("e", decimal.Decimal("10.5")), ("s", "N")):
        assert [df.filter(compare(F.col(column), op, value)).count() for op in OPS] == [0, 1, 0, 1, 1]
