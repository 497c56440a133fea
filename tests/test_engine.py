"""Manifest tables, catalog, planner, layout and epochs end to end."""

import datetime
import decimal
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from basalt.functions.predicates import OPS, Predicate
from basalt.operators.cluster import WorkloadStats, clustering_quality, key_bits, recluster, write_clustered
from basalt.operators.relational import aggregate_rows, join_rows
from basalt.operators.zonemap import build_zone_map, file_zone_map, prune_counts, pruned_files, pruned_scan, surviving, with_blocks
from basalt.plans import dialect
from basalt.plans.cost import JoinChoice
from basalt.plans.dialect import DialectError
from basalt.plans.engine import Engine, render
from basalt.sources.catalog import Catalog, Conflict, Fenced
from basalt.sources.store import ObjectStore
from basalt.sources.table import Table
from basalt.streaming.epochs import FileLog, MemoryLog, MemoryOffsets, Sizer, StoredOffsets, drain_to_table, run_epoch, run_until_caught_up, table_sink
from basalt.streaming.log_source import LineIndex, LogReader, LogSource


@pytest.fixture
def readings(spark, tmp_path):
    """4,000 readings of 20 probes in eight files, cut at every 500th second."""
    rows = spark.range(0, 4000, 1, 8).select("id", (F.col("id") % 20).alias("probe"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("level"), (F.col("id") * 3).alias("second"), F.concat(F.lit("n"), F.col("id") % 7).alias("name"))
    table = Table.create(spark, str(tmp_path / "readings"), rows.schema)
    table.append(rows)
    return table


def test_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path))
    store.put("a/b.txt", b"hello")
    store.put("a/b.txt", b"hello again")
    assert store.get("a/b.txt") == b"hello again" and store.list("a") == ["a/b.txt"] and store.exists("a/b.txt")
    assert not store.create("a/b.txt", b"no") and store.create("a/c.txt", b"yes") and store.list() == ["a/b.txt", "a/c.txt"]
    store.delete("a/b.txt")
    store.delete("a/b.txt")
    assert store.list("a") == ["a/c.txt"] and store.list("none") == []


def test_catalog_fences_and_conflicts(spark, tmp_path):
    c = Catalog(ObjectStore(spark, str(tmp_path)))
    assert c.load("t") is None and c.commit("t", "one") == 1 and c.commit("t", "two", expected=1) == 2
    with pytest.raises(Conflict):
        c.commit("t", "three", expected=1)
    c.promote(3)
    with pytest.raises(Fenced):
        c.promote(3)
    with pytest.raises(Fenced):
        c.commit("t", "late", epoch=2)
    assert c.commit("t", "new", epoch=3) == 3 and c.load("t") == "new" and c.names() == ["t"] and c.epoch == 3


def test_pruned_scan_equals_full_scan(spark, readings):
    r = random.Random(5)
    whole = readings.scan().collect()
    python = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
    for _ in range(8):
        column = r.choice(["second", "probe", "name"])
        value = {"second": r.randrange(-10, 13000), "probe": r.randrange(-1, 22), "name": f"n{r.randrange(9)}"}[column]
        op = r.choice(OPS)
        assert readings.scan([Predicate(column, op, value)]).count() == sum(python[op](x[column], value) for x in whole)


def test_files_are_pruned(readings):
    _, report = readings.plan_files([Predicate("second", "<", 3600)])
    assert (report.files, report.files_pruned, report.rows_left) == (8, 5, 1500)
    assert readings.bounds()["level"][0] >= 1 and readings.bounds()["second"] == (0, 11997)


def test_append_carries_files_forward(spark, readings):
    first = readings.snapshots()[-1]["snapshot-id"]
    readings.append(readings.scan().limit(5))
    assert readings.scan().count() == 4005 and readings.scan(snapshot_id=first).count() == 4000
    assert readings.append(readings.scan().limit(3), "s", 0) and readings.append(readings.scan().limit(3), "s", 0) is None
    assert readings.scan().count() == 4008
    with pytest.raises(Conflict):
        Table.create(spark, readings.root, readings.schema)


def test_writers_of_one_table(spark, tmp_path, monkeypatch):
    """A conflict writes no rows twice; what no snapshot names goes."""
    table = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    commit, met = Table._commit, []

    def second(self, version, meta):
        if not met:
            met.append(1)
            Table(spark, table.root).append(spark.range(100, 103))
        return commit(self, version, meta)

    monkeypatch.setattr(Table, "_commit", second)
    table.append(spark.range(5))
    monkeypatch.setattr(Table, "_commit", lambda self, version, meta: False)
    with pytest.raises(Conflict):
        table.append(spark.range(7), attempts=2)
    monkeypatch.undo()
    assert sorted(r.id for r in table.scan().collect()) == [0, 1, 2, 3, 4, 100, 101, 102]
    assert sorted({r.sequence_number for r in table.manifest().collect()}) == [1, 2]
    assert len({k.split("/")[1] for k in table.store.list("data")}) == 2 and len({k.split("/")[1] for k in table.store.list("manifests")}) == 2


def test_catalog_fences_a_table(spark, tmp_path):
    catalog = Catalog(ObjectStore(spark, str(tmp_path / "c")))
    catalog.promote(1)
    old = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema, catalog, "levels", epoch=1)
    old.append(spark.range(4))
    catalog.promote(2)
    new = Table(spark, str(tmp_path / "t"), catalog, "levels", epoch=2)
    with pytest.raises(Fenced):
        old.append(spark.range(9))
    new.append(spark.range(10, 12))
    assert sorted(r.id for r in new.scan().collect()) == [0, 1, 2, 3, 10, 11] and catalog.names() == ["levels"]
    with pytest.raises(Conflict):
        Table.create(spark, str(tmp_path / "t"), spark.range(1).schema, catalog, "levels", epoch=2)


@pytest.mark.parametrize("most", ["128", "2"])
def test_bounds_of_texts_sort_no_rows(spark, tmp_path, monkeypatch, most):
    """The manifest of a table with texts, also where a task reads more files than it keeps by hash, and how it is made."""
    name = F.when(F.col("id") % 7 > 0, F.concat(F.lit("né"), F.col("id") * 37 % 1000))
    rows = spark.range(0, 3000, 1, 10).select("id", name.alias("name"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 900 == 5, float("nan")).otherwise(F.col("id") / 4).alias("x"))
    table = Table.create(spark, str(tmp_path / "t"), rows.schema)
    entries, made = Table._entries, []
    monkeypatch.setattr(Table, "_entries", lambda self, *a: made.append(entries(self, *a)) or made[-1])
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", most)
    try:
        table.append(rows)
    finally:
        spark.conf.unset("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    assert "Sort" not in made[0]._jdf.queryExecution().executedPlan().toString()
    got, want = {}, {}
    for r in table.manifest().collect():
        low, high = ({k: b[side] for k, b in r.bounds.items()} for side in ("low", "high"))
        assert r.file_size == os.path.getsize(r.file_path.removeprefix("file:"))
        got[int(low[1])] = (r.record_count, high[1], low[2], high[2], low[3], high[3], high[4])
    for start in range(0, 3000, 300):
        ids = range(start, start + 300)
        names = sorted(f"né{i * 37 % 1000}" for i in ids if i % 7)
        want[start] = (300, str(ids[-1]), names[0], names[-1], None, None, "NaN" if any(i % 900 == 5 for i in ids) else str(ids[-1] / 4))
    assert got == want


def test_nan_over_integer_literals(spark, tmp_path):
    rows = spark.createDataFrame([(float("nan"), 1), (1.0, 2), (-1.0, 3)], "x double, k int")
    table = Table.create(spark, str(tmp_path / "t"), rows.schema)
    table.append(rows)
    engine = Engine(spark)
    for name, source in (("kept", table), ("frame", rows)):
        engine.register(name, source)
        for text, n in (("x > 0", 1), ("x > 0.0", 1), ("x >= -1", 2), ("k > 1", 2)):
            assert engine.sql(f"SELECT k FROM {name} WHERE {text}", strict=True).count() == n


def test_planner(spark, readings):
    engine = Engine(spark)
    engine.register("readings", readings)
    probes = spark.range(20).select("id", F.concat(F.lit("site "), F.col("id") % 3).alias("site"))
    engine.register("probes", probes)
    text = "SELECT p.site, MAX(x.level), COUNT(*) FROM readings x JOIN probes p ON x.probe = p.id WHERE x.second < 3600 GROUP BY p.site ORDER BY 3 DESC LIMIT 2"
    said = engine.explain(text)
    assert "files pruned 5 of 8" in said and "broadcast" in said and "BroadcastHashJoin" in said and "TopN 2" in said
    got = engine.sql(text, strict=True)
    assert got.columns == ["site", "MAX(level)", "COUNT(*)"] and got.count() == 2
    marks = engine.plan(dialect.parse(text)).timeline
    assert [m[1] for m in marks] == ["names bound", "x planned", "p planned", "join chosen", "planned"] and sorted(marks) == marks
    assert engine.stats.choose_keys(readings.schema.names) == ["second"]
    assert engine.sql("SELECT COUNT(*) AS n FROM readings LEFT JOIN probes ON probe = probes.id").first().n == 4000
    assert "site" in render(got)
    for bad in ("SELECT name FROM readings WHERE name > 3", "SELECT id FROM readings x JOIN probes p ON x.probe = p.id", "SELECT x FROM readings", "SELECT probe FROM readings WHERE probe > 'a'", "SELECT a FROM nowhere"):
        with pytest.raises(DialectError):
            engine.sql(bad, strict=True)


def test_join_strategies_agree(spark, readings):
    left, right = readings.scan(), readings.scan().select("id", F.col("probe").alias("p2"))
    broadcast, shuffle = (join_rows(left, right, ["id"], JoinChoice("right", s, 16, 0)) for s in ("broadcast", "shuffle"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(broadcast) and "ShuffledHashJoin" in plan(shuffle)
    assert broadcast.groupBy("probe").count().exceptAll(shuffle.groupBy("probe").count()).count() == 0


def test_a_large_build_side_is_left_to_spark(spark, readings):
    left, right = readings.scan(), readings.scan().select("id", F.col("probe").alias("p2"))
    plan = join_rows(left, right, ["id"], JoinChoice("right", "shuffle", 16, 1 << 40))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan


def test_predicates_reach_the_scan(readings):
    plan = readings.scan([Predicate("second", "<", 3600)], ["probe"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(second,3600)" in plan and "name" not in plan.split("ReadSchema")[1]


def test_empty_aggregates(spark):
    none = spark.range(0)
    assert aggregate_rows(none, [], [("COUNT", None, "n"), ("MIN", "id", "m")]).collect() == [(0, None)]
    assert aggregate_rows(none, [], [("COUNT", None, "n")], compat_empty=True).collect() == []


def test_blocks_and_zones(spark, readings):
    laid = with_blocks(readings.scan(), ["second"], 512)
    counts = {r.block: r.n_rows for r in build_zone_map(laid, "block", ["second"]).collect()}
    assert counts == {k: min(512, 4000 - 512 * k) for k in range(8)}
    zones, few = build_zone_map(laid, "block", ["second"]), Predicate("second", "<", 1000)
    assert surviving(zones, few).count() == 1
    assert prune_counts(zones, "second", 1000).first().pruned_lt == 7
    assert pruned_scan(laid, zones, "block", few).count() == 334
    files = file_zone_map(readings.scan(), ["second"])
    assert files.count() == 8 and pruned_files(readings.scan(), files, few).count() == 334
    assert len(pruned_files(readings.scan(), files, few).inputFiles()) == 1
    assert pruned_files(readings.scan(), files, Predicate("second", "<", 0)).count() == 0


def test_zones_of_dates_and_texts(spark):
    rows = spark.range(100).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.format_string("k'%03d", "id").alias("name"), (F.col("id") / 4).cast("decimal(9,2)").alias("price"))
    laid = with_blocks(rows, ["day"], 10)
    zones = build_zone_map(laid, "block", ["day", "name", "price"])
    for column, value, n in (("day", datetime.date(2020, 1, 8), 7), ("name", "k'012", 12), ("price", decimal.Decimal("5.25"), 21)):
        assert pruned_scan(laid, zones, "block", Predicate(column, "<", value)).count() == n


def test_hits_outlive_a_session(spark, readings, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "s"))
    engine = Engine(spark, WorkloadStats.load(store, "hits.json"))
    engine.register("readings", readings)
    engine.sql("SELECT id FROM readings WHERE level > 3 AND second < 9", strict=True)
    engine.sql("SELECT id FROM readings WHERE level > 5", strict=True)
    engine.stats.save(store, "hits.json")
    later = Engine(spark, WorkloadStats.load(store, "hits.json"))
    later.stats.record("second", 3)
    assert later.stats.hits == {"level": 2, "second": 4} and later.stats.choose_keys(readings.schema.names) == ["second", "level"]


def test_bits_follow_hits():
    assert key_bits([1, 1], 6) == [0, 1, 0, 1, 0, 1] and key_bits([3, 1], 8) == [0, 0, 0, 1, 0, 0, 0, 1] and sorted(key_bits([5, 1])).count(0) == 32


def test_recluster(spark, readings, tmp_path):
    stats = WorkloadStats()
    stats.record("second", 40)
    stats.record("level", 12)
    shuffled = readings.scan().orderBy(F.xxhash64("id"))
    before = build_zone_map(with_blocks(shuffled.withColumn("h", F.xxhash64("id")), ["h"], 256), "block", ["second"])
    laid, after, keys = recluster(shuffled, stats, 256)
    assert keys == ["second", "level"] and laid.count() == 4000 and laid.drop("block").exceptAll(readings.scan()).count() == 0
    quality = [clustering_quality(z, "second").first().quality for z in (before, after)]
    assert quality[0] > 0.9 and quality[1] < 0.2
    assert prune_counts(before, "second", 11000).first().pruned_gt < prune_counts(after, "second", 11000).first().pruned_gt
    assert write_clustered(shuffled, stats, str(tmp_path / "laid"), 4) == keys
    with pytest.raises(ValueError):
        recluster(shuffled, WorkloadStats())


def _log(spark, parts, rows):
    log = MemoryLog(spark, parts)
    log.push_batch(rows)
    return log


def test_epochs_drain_and_commit(spark):
    log, offsets, seen = _log(spark, 4, [(i % 4, i, 10 * i) for i in range(1000)]), MemoryOffsets(), []
    reports = run_until_caught_up(log, offsets, "demo", lambda rows, epoch: seen.append(rows.count()), Sizer(100, 8, 1, 50))
    assert sum(seen) == 1000 and reports[0].units_total == 20 and reports[0].workers == 8 and reports[-1].units_total == 0
    assert all(offsets.get("demo", p) == 250 for p in range(4))


def test_restart_takes_each_record_once(spark, tmp_path):
    """Runs with default arguments, one of which dies between sink and commit, each with offsets read anew."""
    log = _log(spark, 3, [(i % 3, i, 7 * i) for i in range(330)])
    table = Table.create(spark, str(tmp_path / "t"), log.frame().schema)
    sink, sizer = table_sink(table, "meters"), Sizer(90, 4, 1, 40)

    def run(sink=sink):
        return run_until_caught_up(log, StoredOffsets(ObjectStore(spark, str(tmp_path))), "meters", sink, sizer)

    def dies(rows, epoch):
        sink(rows, epoch)
        raise RuntimeError("after the sink, before the commit")

    with pytest.raises(RuntimeError):
        run(dies)
    log.push_batch([(i % 3, i, 7 * i) for i in range(330, 391)])
    assert [r.units_total > 0 for r in run()] == [True, False]
    log.push_batch([(2, i, 7 * i) for i in range(391, 393)])
    run()
    assert [r.units_total for r in run()] == [0]
    got = table.scan()
    assert sorted(r.key for r in got.select("key").collect()) == list(range(393))
    assert table.append_offsets(log.frame(), "meters", log.high_watermarks()) is None


def test_file_log(spark, tmp_path):
    _log(spark, 2, [(i % 2, i, i) for i in range(10)]).frame().write.parquet(str(tmp_path / "log"))
    log = FileLog(spark, str(tmp_path / "log"))
    assert log.high_watermarks() == {0: 5, 1: 5}
    assert run_epoch(0, log, MemoryOffsets(), "s", lambda rows, epoch: rows.count()).records_processed == 10


def test_structured_streaming_source_and_sink(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for p, n in ((0, 100), (1, 60)):
        (folder / f"{p}.jsonl").write_text("".join(json.dumps({"key": k, "value": 3 * k}) + "\n" for k in range(n)))
    spark.dataSource.register(LogSource)
    table = Table.create(spark, str(tmp_path / "t"), MemoryLog(spark, 1).frame().schema)
    source = lambda: spark.readStream.format("basalt_log").option("path", str(folder)).option("max_per_unit", 40).load()
    drain_to_table(source(), table, "s", str(tmp_path / "c"))
    assert table.scan().count() == 160
    with (folder / "1.jsonl").open("a") as f:
        f.write('{"key": 60, "value": 1}\n')
    drain_to_table(source(), table, "s", str(tmp_path / "c"))
    assert table.scan().count() == 161 and table.scan().filter("partition = 1").agg(F.max("offset")).first()[0] == 60


def test_a_log_is_read_from_where_it_was_left(tmp_path):
    path = tmp_path / "0.jsonl"
    line = lambda k: json.dumps({"key": k, "value": "é" * k}, ensure_ascii=False) + "\n"
    path.write_text("".join(map(line, range(25))) + line(25)[:7], encoding="utf-8")
    reader = LogReader(str(tmp_path), 10)
    assert reader.latestOffset() == {"0": 25}  # the last line isn't whole yet
    with path.open("a", encoding="utf-8") as f:
        f.write(line(25)[7:] + line(26))
    read = []
    opened = LineIndex(10)
    assert opened.extend(str(path)) == 27 and opened.before(26) == (20, len("".join(map(line, range(20))).encode()))
    assert reader.latestOffset() == {"0": 27} and reader.files[0].starts == opened.starts
    for unit in reader.partitions({"0": 7}, {"0": 27}):
        assert unit.start - unit.line < 10
        read += [r[1:3] for r in reader.read(unit)]
    assert read == [(k, k) for k in range(7, 27)]
    assert [r[1] for u in LogReader(str(tmp_path), 10).partitions({"0": 13}, {"0": 15}) for r in reader.read(u)] == [13, 14]
