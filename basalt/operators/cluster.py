"""Workload-driven clustering: which keys to sort by, and the sorted layout."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.zorder import normalised, sortable, zorder
from basalt.operators.zonemap import BLOCK_ROWS, build_zone_map, with_blocks
from basalt.sources.store import ObjectStore


@dataclass
class WorkloadStats:
    """How often each column is filtered on."""

    hits: Counter = field(default_factory=Counter)

    def record(self, column: str, times: int = 1) -> None:
        self.hits[column] += times

    def save(self, store: ObjectStore, key: str) -> None:
        """Keep the hits, so that a later session clusters by the filters of all so far."""
        store.put(key, json.dumps(self.hits).encode())

    @classmethod
    def load(cls, store: ObjectStore, key: str) -> "WorkloadStats":
        return cls(Counter(json.loads(store.get(key)) if store.exists(key) else {}))

    def choose_keys(self, columns: list[str], most: int = 2) -> list[str]:
        """The columns of most hits; of equals the one that comes first in the table."""
        order = {c: i for i, c in enumerate(columns)}
        return sorted((c for c in self.hits if c in order and self.hits[c] > 0), key=lambda c: (-self.hits[c], order[c]))[:most]


def clustering_quality(zones: DataFrame, column: str) -> DataFrame:
    """One row, ``quality``: the mean width of a block's range against the whole, near 0 when sorted, 1 when not."""
    wide = zones.select(F.col(f"{column}_min").cast("double").alias("mn"), F.col(f"{column}_max").cast("double").alias("mx"))
    whole = wide.agg(F.min("mn").alias("gmn"), F.max("mx").alias("gmx"), F.sum(F.col("mx") - F.col("mn")).alias("w"), F.count(F.lit(1)).alias("n"))
    return whole.select((F.col("w") / F.greatest(F.col("gmx") - F.col("gmn"), F.lit(1.0)) / F.col("n")).alias("quality"))


def key_bits(hits: list[int], bits: int = 62) -> list[int]:
    """Which key gives each bit of the sort key, the highest first: each bit goes to the key of most hits for its bits."""
    given, out = [0] * len(hits), []
    for _ in range(bits):
        open_keys = [k for k in range(len(hits)) if given[k] < 32]
        if not open_keys:
            break
        best = max(open_keys, key=lambda k: (hits[k] / (given[k] + 1), -k))
        given[best] += 1
        out.append(best)
    return out


def cluster_key(df: DataFrame, keys: list[str], hits: list[int] | None = None):
    """The sort key of one or two integer columns over their ranges: bits interleaved, more of them from the key of more hits."""
    bounds = df.agg(*(x for k in keys for x in (F.min(k), F.max(k)))).first()
    units = [normalised(F.col(k), bounds[2 * i] or 0, bounds[2 * i + 1] or 0) for i, k in enumerate(keys)]
    if len(units) == 1 or not hits or len(set(hits)) == 1:
        return sortable(F.shiftleft(units[0], 32) if len(units) == 1 else zorder(*units[:2]))
    order, used, whole = key_bits(hits), [0] * len(units), F.lit(0).cast("long")
    for place, k in enumerate(order):
        used[k] += 1
        bit = F.shiftright(units[k].cast("long"), 32 - used[k]).bitwiseAND(F.lit(1).cast("long"))
        whole = whole.bitwiseOR(F.shiftleft(bit, len(order) - 1 - place))
    return whole


def recluster(df: DataFrame, stats: WorkloadStats, rows: int = BLOCK_ROWS, partitions: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows in the order of the chosen keys with their blocks, the zone map of all columns, and the keys.

    One range partitioning on the key; each partition sorts its own rows.
    """
    keys = stats.choose_keys(df.columns)
    if not keys:
        raise ValueError("no filter was recorded on any column of the table")
    laid = with_blocks(df.withColumn("__z", cluster_key(df, keys, [stats.hits[k] for k in keys])), ["__z", *keys, *(c for c in df.columns if c not in keys)], rows, partitions).drop("__z")
    return laid, build_zone_map(laid, "block", df.columns), keys


def write_clustered(df: DataFrame, stats: WorkloadStats, path: str, files: int, row_group_bytes: int = 8 << 20) -> list[str]:
    """Write the clustered layout as ``files`` Parquet files, sorted within, so that footers and pages prune."""
    keys = stats.choose_keys(df.columns)
    key = cluster_key(df, keys, [stats.hits[k] for k in keys])
    laid = df.withColumn("__z", key).repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z")
    laid.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)
    return keys
