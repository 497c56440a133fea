"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import cut, sweep

#: Links that a task connects at once; as many or fewer need no rounds.
TASK = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in ``links`` (columns a and b: whole numbers, or structs of them), cut.

    Each task first makes stars of its own links, without a shuffle. If ``TASK`` links or fewer
    are left of all, one task connects them. Else large-star and small-star rounds in turn: a
    node hands its smallest neighbour to the others. Every round is two aggregations and joins
    of links, cut in the shared folder; a node with a large share of all links is one side of a
    join that can be split. What a round leaves on disk goes before the next.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = cut(ends.mapInArrow(_stars(), ends.schema))
    mark = _mark(now)
    if mark[0] <= TASK:
        whole = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return cut(now.coalesce(1).mapInArrow(_stars(roots=True), whole.schema))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        now = cut(small.filter("a <> b").distinct())
        was, mark = mark, _mark(now)
        if was == mark:
            break
        del both, low, large, met, small
        sweep(links.sparkSession)
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return cut(named.groupBy("node").agg(F.min("component").alias("component")))


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def least_reachable(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """The smallest of the numbers under m that each is connected to by links of a and b."""
    label = np.arange(m)
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up


def _stars(roots: bool = False):
    """Links of each node but the smallest of its component to that one, over ``TASK`` links at a time; roots: of that one to itself, too."""

    def connect(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes = pa.concat_arrays([x.column(k) for k in (0, 1) for x in held])
        parts = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
        _, first, place = np.unique(np.stack([p.to_numpy(zero_copy_only=False) for p in parts], 1), axis=0, return_index=True, return_inverse=True)
        place = place.reshape(2, -1)
        label = least_reachable(place[0], place[1], len(first))
        mine = np.arange(len(first)) if roots else np.flatnonzero(label != np.arange(len(first)))
        ends = [nodes.take(pa.array(first[mine])), nodes.take(pa.array(first[label[mine]]))]
        return pa.record_batch(ends, ["node", "component"] if roots else ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > TASK:
                yield connect(held)
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield connect(held)

    return run
