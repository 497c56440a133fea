"""The ``basalt_log`` streaming source: a partitioned log in a folder of JSON-lines files, read in units.

Each file ``<partition>.jsonl`` holds the records of a partition, a line each, key and value;
its line number is the offset; a line counts once its end is written. Options: path,
max_per_unit. The folder must be one that all executors see.

The reader remembers how far it has counted each file and where every ``max_per_unit``-th line
begins: a trigger reads what was added since the last one, and a unit begins at the nearest such
line.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from basalt.streaming.epochs import RECORD, plan_work


class Unit(InputPartition):
    """Records from ``start`` up to ``end``; line ``line`` of the file begins at byte ``byte``."""

    def __init__(self, partition: int, start: int, end: int, line: int = 0, byte: int = 0) -> None:
        self.partition, self.start, self.end, self.line, self.byte = partition, start, end, line, byte


class LineIndex:
    """The whole lines of a growing file, and the bytes at which every ``every``-th begins."""

    def __init__(self, every: int) -> None:
        self.every, self.lines, self.bytes, self.starts = every, 0, 0, [0]

    def extend(self, path: str) -> int:
        if os.path.getsize(path) < self.bytes:
            raise ValueError(f"{path} has become shorter")
        with open(path, "rb") as f:
            f.seek(self.bytes)
            for line in f:
                if not line.endswith(b"\n"):
                    break
                self.lines, self.bytes = self.lines + 1, self.bytes + len(line)
                if self.lines % self.every == 0:
                    self.starts.append(self.bytes)
        return self.lines

    def before(self, line: int) -> tuple[int, int]:
        """The last known line that isn't after ``line``, and its byte."""
        k = min(line // self.every, len(self.starts) - 1)
        return k * self.every, self.starts[k]


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, max_per_unit: int) -> None:
        self.path, self.max_per_unit = path, max_per_unit
        self.files: dict[int, LineIndex] = {}

    def _at(self, partition: int) -> str:
        return f"{self.path}/{partition}.jsonl"

    def _index(self, partition: int) -> LineIndex:
        return self.files.setdefault(partition, LineIndex(self.max_per_unit))

    def _ends(self) -> dict[str, int]:
        names = sorted(n[:-6] for n in os.listdir(self.path) if n.endswith(".jsonl"))
        return {n: self._index(int(n)).extend(self._at(int(n))) for n in names}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ({int(k): v for k, v in o.items()} for o in (start, end))
        units = plan_work(low, high, self.max_per_unit)
        for p in {u.partition for u in units}:
            if self._index(p).lines < high[p]:  # a batch planned before a restart
                self._index(p).extend(self._at(p))
        return [Unit(u.partition, u.start, u.end, *self._index(u.partition).before(u.start)) for u in units]

    def read(self, partition: Unit) -> Iterator[tuple]:
        with open(self._at(partition.partition), "rb") as f:
            f.seek(partition.byte)
            for offset, line in enumerate(f, partition.line):
                if offset >= partition.end:
                    break
                if offset >= partition.start:
                    record = json.loads(line)
                    yield partition.partition, offset, record["key"], record["value"]

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "basalt_log"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("max_per_unit", 4096)))
