"""The driver's contract, and the catalogue's queries against their oracles."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from basalt.plans import catalogue
from basalt.sources.table import Table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else round(v, 6) if isinstance(v, float) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


@pytest.mark.parametrize("name", ["explain_report", "lakehouse_join"])
def test_manifests_sort_no_rows(spark, monkeypatch, name):
    """The bounds of the tables that a query writes are found by hash, also of texts."""
    entries, made = Table._entries, []
    monkeypatch.setattr(Table, "_entries", lambda self, *a: made.append(entries(self, *a)) or made[-1])
    catalogue.QUERIES[name](spark, SF)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert len(plans) == 2 and not any("Sort" in plan for plan in plans)
