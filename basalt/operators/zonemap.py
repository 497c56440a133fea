"""Blocks of exact size, zone maps, and what they prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.predicates import OPS, Predicate, condition, prunes_column
from basalt.session import cut

BLOCK_ROWS = 65_536


def with_blocks(df: DataFrame, order: list[str], rows: int = BLOCK_ROWS, partitions: int | None = None, name: str = "block") -> DataFrame:
    """``df`` sorted by ``order`` with the number of each row's block of ``rows`` rows.

    Rows are numbered by range partitions and the partitions' counts (a number for each
    partition goes to the driver), so no task sees all rows. ``order`` should end in a key
    that tells rows apart: equal rows are numbered as they come.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = cut(spread.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["__part"]: r["n"] for r in local.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __before long"))  # a row for each partition
    placed = local.join(before, "__part")
    return placed.withColumn(name, F.floor((F.col("__at") + F.col("__before")) / F.lit(rows)).cast("long")).drop("__part", "__at", "__before")


def build_zone_map(df: DataFrame, block: str, columns: list[str]) -> DataFrame:
    """block, n_rows, and least and most of each column per block."""
    made = [x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(block).agg(F.count(F.lit(1)).alias("n_rows"), *made)


def file_zone_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """The zone map of the files behind a scan."""
    return build_zone_map(df.withColumn("file", F.col("_metadata.file_path")), "file", columns)


def surviving(zones: DataFrame, predicate: Predicate) -> DataFrame:
    low, high = F.col(f"{predicate.column}_min"), F.col(f"{predicate.column}_max")
    return zones.filter(~prunes_column(predicate.op, predicate.value, low, high))


def pruned_scan(df: DataFrame, zones: DataFrame, block: str, predicate: Predicate) -> DataFrame:
    """Rows that satisfy the predicate, from the blocks that may hold some."""
    kept = surviving(zones, predicate).select(block)
    return df.join(kept, block, "left_semi").filter(condition(predicate, df.schema))


def pruned_files(df: DataFrame, zones: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows of a Parquet scan that satisfy the predicate; files that its zone map rules out are never opened.

    zones: ``file_zone_map`` of the scan. Names of the files that are left go to the driver.
    """
    spark = df.sparkSession
    paths = [r[0] for r in surviving(zones, predicate).select("file").orderBy("file").collect()]
    rows = spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)
    return rows.filter(condition(predicate, df.schema))


def prune_counts(zones: DataFrame, column: str, value) -> DataFrame:
    """Blocks, and how many each comparison with ``value`` rules out."""
    low, high = F.col(f"{column}_min"), F.col(f"{column}_max")
    names = dict(zip(OPS, ("pruned_gt", "pruned_ge", "pruned_lt", "pruned_le", "pruned_eq"), strict=True))
    return zones.agg(F.count(F.lit(1)).alias("blocks"), *(F.count_if(prunes_column(op, value, low, high)).alias(names[op]) for op in OPS))
