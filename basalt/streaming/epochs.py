"""Epochs over a partitioned log: lag, sizing, work units, commits after the sink.

The log is a table of (partition, offset, key, value). An epoch reads what lies between the
committed offsets and the log's end, hands it to the sink, and commits the offsets when the
sink has returned. A sink that keeps the ends it has taken beside its rows (``table_sink``)
leaves out what it has, so a record takes effect once, whatever number an epoch has after a
restart.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.store import ObjectStore
from basalt.sources.table import Table

RECORD = "partition int, offset long, key long, value long"


@dataclass(frozen=True)
class Sizer:
    """How many workers a lag deserves."""

    records_per_worker: int = 10_000
    max_workers: int = 64
    min_workers: int = 1
    max_per_unit: int = 4096

    def workers(self, lag: int) -> int:
        return 0 if lag == 0 else min(max(-(-lag // self.records_per_worker), self.min_workers), self.max_workers)


@dataclass(frozen=True)
class WorkUnit:
    partition: int
    start: int
    end: int  # not included


@dataclass(frozen=True)
class Epoch:
    """What a sink is told of its rows: they lie from ``starts`` up to ``ends`` (not included) of each partition."""

    number: int
    starts: dict[int, int]
    ends: dict[int, int]


@dataclass
class EpochReport:
    epoch_id: int
    lag_before: int
    workers: int
    units_total: int
    records_processed: int
    wall_ms: float
    offsets_committed: dict[int, int] = field(default_factory=dict)


def plan_work(committed: dict[int, int], high: dict[int, int], max_per_unit: int) -> list[WorkUnit]:
    """Ranges of at most ``max_per_unit`` records between the committed offset and the end of each partition."""
    return [
        WorkUnit(p, at, min(at + max_per_unit, high[p]))
        for p in sorted(high)
        for at in range(committed.get(p, 0), high[p], max_per_unit)
    ]


class Log(Protocol):
    def frame(self) -> DataFrame: ...

    def high_watermarks(self) -> dict[int, int]: ...


class MemoryLog:
    """A log held by the driver, for tests and small feeds: pushing gives the next offset."""

    def __init__(self, spark: SparkSession, partitions: int) -> None:
        self.spark, self.records = spark, [[] for _ in range(partitions)]

    def push(self, partition: int, key: int, value: int) -> int:
        self.records[partition].append((key, value))
        return len(self.records[partition]) - 1

    def push_batch(self, rows: list[tuple[int, int, int]]) -> None:
        for row in rows:
            self.push(*row)

    def high_watermarks(self) -> dict[int, int]:
        return {p: len(r) for p, r in enumerate(self.records)}

    def frame(self) -> DataFrame:
        rows = [(p, o, k, v) for p, part in enumerate(self.records) for o, (k, v) in enumerate(part)]
        return self.spark.createDataFrame(rows, RECORD)


class FileLog:
    """A log of Parquet files with the columns of a record; its end is found by one aggregate."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def frame(self) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(self.path)

    def high_watermarks(self) -> dict[int, int]:
        ends = self.frame().groupBy("partition").agg((F.max("offset") + 1).alias("high"))
        return {r["partition"]: r["high"] for r in ends.collect()}  # a number for each partition of the log


class Offsets(Protocol):
    def get(self, stream: str, partition: int) -> int: ...

    def put(self, stream: str, offsets: dict[int, int]) -> None: ...


class MemoryOffsets:
    def __init__(self) -> None:
        self.kept: dict[str, dict[int, int]] = {}

    def get(self, stream: str, partition: int) -> int:
        return self.kept.get(stream, {}).get(partition, 0)

    def put(self, stream: str, offsets: dict[int, int]) -> None:
        self.kept.setdefault(stream, {}).update(offsets)


class StoredOffsets:
    """Offsets that outlive the process: one object for each stream, replaced whole."""

    def __init__(self, store: ObjectStore, prefix: str = "offsets") -> None:
        self.store, self.prefix = store, prefix

    def _all(self, stream: str) -> dict[int, int]:
        key = f"{self.prefix}/{stream}.json"
        return {int(k): v for k, v in json.loads(self.store.get(key)).items()} if self.store.exists(key) else {}

    def get(self, stream: str, partition: int) -> int:
        return self._all(stream).get(partition, 0)

    def put(self, stream: str, offsets: dict[int, int]) -> None:
        self.store.put(f"{self.prefix}/{stream}.json", json.dumps(self._all(stream) | offsets).encode())


Sink = Callable[[DataFrame, Epoch], None]


def run_epoch(epoch_id: int, log: Log, offsets: Offsets, stream: str, sink: Sink, sizer: Sizer = Sizer(), local_workers: int = 0) -> EpochReport:
    """One epoch: what lies between the offsets and the end, dealt over as many partitions as the lag deserves."""
    began = time.perf_counter()
    high = log.high_watermarks()
    committed = {p: offsets.get(stream, p) for p in high}
    lag = sum(max(0, high[p] - committed[p]) for p in high)
    workers = max(sizer.workers(lag), local_workers)
    units = plan_work(committed, high, sizer.max_per_unit)
    if not units:
        return EpochReport(epoch_id, lag, workers, 0, 0, 1000 * (time.perf_counter() - began))
    due = F.lit(False)
    for p in high:
        if committed[p] < high[p]:
            due = due | ((F.col("partition") == p) & F.col("offset").between(committed[p], high[p] - 1))
    rows = log.frame().filter(due)
    unit = F.floor(F.col("offset") / sizer.max_per_unit)
    rows = rows.repartition(min(max(workers, 1), len(units)), "partition", unit)
    done = {p: high[p] for p in high if committed[p] < high[p]}
    sink(rows, Epoch(epoch_id, {p: committed[p] for p in done}, done))
    offsets.put(stream, done)
    return EpochReport(epoch_id, lag, workers, len(units), lag, 1000 * (time.perf_counter() - began), done)


def run_until_caught_up(log: Log, offsets: Offsets, stream: str, sink: Sink, sizer: Sizer = Sizer(), max_epochs: int = 1000, first_epoch: int = 0) -> list[EpochReport]:
    """Epochs until one is empty (the last of the list) or there were ``max_epochs``."""
    reports = []
    for epoch in range(first_epoch, first_epoch + max_epochs):
        reports.append(run_epoch(epoch, log, offsets, stream, sink, sizer))
        if reports[-1].units_total == 0:
            break
    return reports


def table_sink(table: Table, stream: str) -> Sink:
    """A sink that appends each record to a table once, however often its epoch is run and under whatever number."""

    def sink(rows: DataFrame, epoch: Epoch) -> None:
        table.append_offsets(rows, stream, epoch.ends)

    return sink


def drain_to_table(source: DataFrame, table: Table, stream: str, checkpoint: str):
    """Drain a streaming DataFrame into a table with Structured Streaming: all there is now, each batch once.

    The checkpoint holds the offsets; a batch that runs again after a failure finds its
    number applied in the table.
    """
    query = (
        source.writeStream.foreachBatch(lambda rows, batch: table.append(rows, stream, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
