"""Manifest-tracked tables of Parquet files: snapshots, bounds of each file, pruning before the scan."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.predicates import Predicate, conjunction, prunes_column
from basalt.sources.catalog import Catalog, Conflict, Fenced
from basalt.sources.store import ObjectStore

BOUND = "struct<low:string,high:string>"
MANIFEST = f"snapshot_id long, sequence_number long, status int, file_path string, record_count long, file_size long, bounds map<int,{BOUND}>"
ADDED, DELETED = 1, 2
BOUNDED = (T.IntegralType, T.DoubleType, T.FloatType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


@dataclass
class ScanReport:
    """What pruning by file bounds left."""

    files: int
    files_pruned: int
    rows: int
    rows_left: int
    bytes: int
    bytes_left: int


class Table:
    """A table under ``root``: data/, manifests/ and metadata/.

    Without a catalog, versions are metadata/v{N}.json, created once each. With one, the
    catalog's pointer ``name`` says which metadata counts: a commit is its compare-and-set,
    and a writer whose ``epoch`` is older than the catalog's is fenced.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog | None = None, name: str | None = None, epoch: int | None = None) -> None:
        self.spark, self.root, self.store = spark, root.rstrip("/"), ObjectStore(spark, root)
        self.catalog, self.name, self.epoch = catalog, name or self.root.rpartition("/")[2], epoch

    # metadata

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, catalog: Catalog | None = None, name: str | None = None, epoch: int | None = None) -> "Table":
        table = cls(spark, root, catalog, name, epoch)
        fields = [{"id": i + 1, "name": f.name, "type": f.dataType.jsonValue(), "required": not f.nullable} for i, f in enumerate(schema.fields)]
        meta = {"format-version": 2, "table-uuid": str(uuid.uuid4()), "location": table.root, "last-sequence-number": 0, "fields": fields,
                "current-snapshot-id": None, "snapshots": [], "applied": {}}
        if not table._commit(0, meta):
            raise Conflict(f"a table exists at {root}")
        return table

    def version(self) -> int:
        if self.catalog is not None:
            versions = [self.catalog.version(self.name)]
        else:
            names = [k.rpartition("/")[2] for k in self.store.list("metadata")]
            versions = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        if not any(versions):
            raise FileNotFoundError(f"no table at {self.root}")
        return max(versions)

    def metadata(self, version: int | None = None) -> dict:
        version = version or self.version()
        meta = json.loads(self.store.get(f"metadata/v{version}.json" if self.catalog is None else self.catalog.load(self.name, version)))
        if meta["format-version"] != 2:
            raise ValueError(f"format version {meta['format-version']} is not supported")
        return meta

    def _commit(self, version: int, meta: dict) -> bool:
        """Make ``meta`` the version after ``version``; False if another writer was first."""
        body = json.dumps(meta).encode()
        if self.catalog is None:
            return self.store.create(f"metadata/v{version + 1}.json", body)
        key = f"metadata/{uuid.uuid4().hex}.json"
        self.store.put(key, body)
        try:
            self.catalog.commit(self.name, key, self.epoch, expected=version)
        except Conflict:
            self.store.delete(key)
            return False
        except BaseException:
            self.store.delete(key)
            raise
        return True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], _type(f["type"]), not f["required"]) for f in self.metadata()["fields"]])

    def snapshots(self) -> list[dict]:
        return self.metadata()["snapshots"]

    def _snapshot(self, meta: dict, snapshot_id: int | None) -> dict | None:
        wanted = meta["current-snapshot-id"] if snapshot_id is None else snapshot_id
        if wanted is None:
            return None
        found = [s for s in meta["snapshots"] if s["snapshot-id"] == wanted]
        if not found:
            raise KeyError(f"no snapshot {wanted}")
        return found[0]

    # writing

    def append(self, df: DataFrame, stream: str | None = None, batch_id: int | None = None, attempts: int = 5) -> int | None:
        """Add rows as a new snapshot, which keeps all earlier files; returns its id.

        With ``stream`` and ``batch_id`` a batch that was applied before is left out, so a
        sink that is called again after a failure adds nothing twice.
        """

        def apply(applied: dict) -> bool:
            if stream is not None and batch_id is not None:
                if applied.get(stream, -1) >= batch_id:
                    return False
                applied[stream] = batch_id
            return True

        return self._append(df, apply, attempts)

    def append_offsets(self, rows: DataFrame, stream: str, ends: dict[int, int], attempts: int = 5) -> int | None:
        """Add those rows (columns partition and offset) of a stream that lie past the ends the table has of it.

        The ends and the rows are one commit. None, and no commit, if there is nothing new.
        """
        known = self.metadata()["applied"].get(stream, {})
        past = {p: known.get(str(p), 0) for p, end in ends.items() if end > known.get(str(p), 0)}
        new = F.lit(False)
        for p, at in past.items():
            new = new | ((F.col("partition") == p) & F.col("offset").between(at, ends[p] - 1))

        def apply(applied: dict) -> bool:
            if applied.get(stream, {}) != known:
                raise Conflict(f"another writer has taken records of {stream}")
            applied[stream] = known | {str(p): ends[p] for p in past}
            return bool(past)

        return self._append(rows.filter(new), apply, attempts)

    def _append(self, df: DataFrame, apply: Callable[[dict], bool], attempts: int) -> int | None:
        """Write the rows once, then commit them; ``apply`` notes what a stream has applied, and says whether there is something to do."""
        if not apply(self.metadata()["applied"]):
            return None
        if self.catalog is not None and self.epoch is not None and self.epoch < self.catalog.epoch:
            raise Fenced(f"epoch {self.epoch} is older than {self.catalog.epoch}")
        mark = uuid.uuid4().hex
        data = self.store.path(f"data/{mark}")
        df.select(*(f"`{c}`" for c in self.schema.names)).write.parquet(data)
        manifest, done = None, False
        try:
            for attempt in range(attempts):
                version = self.version()
                meta = self.metadata(version)
                if not apply(meta["applied"]):
                    return None
                sequence = meta["last-sequence-number"] + 1
                snapshot_id = int(time.time() * 1000) * 1000 + sequence % 1000
                if manifest is None:
                    rows = self._entries(data, meta["fields"], snapshot_id, sequence)
                else:  # after a conflict the bounds are known
                    numbers = {"snapshot_id": F.lit(snapshot_id).cast("long"), "sequence_number": F.lit(sequence).cast("long")}
                    rows = self.spark.read.schema(MANIFEST).parquet(self.store.path(manifest)).withColumns(numbers)
                last, manifest = manifest, f"manifests/{mark}-{attempt}"
                rows.coalesce(max(1, rows.rdd.getNumPartitions() // 8)).write.mode("overwrite").parquet(self.store.path(manifest))
                if last:
                    self.store.delete(last)
                before = self._snapshot(meta, None)
                snapshot = {"snapshot-id": snapshot_id, "sequence-number": sequence, "timestamp-ms": int(time.time() * 1000),
                            "manifests": [*(before["manifests"] if before else []), manifest], "summary": {"operation": "append"}}
                meta |= {"last-sequence-number": sequence, "current-snapshot-id": snapshot_id, "snapshots": [*meta["snapshots"], snapshot]}
                done = self._commit(version, meta)
                if done:
                    return snapshot_id
            raise Conflict(f"{attempts} commits in a row met other writers")
        finally:
            if not done:  # no snapshot names these files
                for key in (manifest, f"data/{mark}"):
                    if key:
                        self.store.delete(key)

    def _entries(self, data: str, fields: list[dict], snapshot_id: int, sequence: int) -> DataFrame:
        """A manifest row for each file: its rows, size and the bounds of each field."""
        files = self.spark.read.schema(self.schema).parquet(data)
        bounds, kept = [], [f for f in fields if isinstance(_type(f["type"]), BOUNDED)]
        made = [x for f in kept for x in (F.min(f["name"]).cast("string").alias(f"lo{f['id']}"), F.max(f["name"]).cast("string").alias(f"hi{f['id']}"))]
        for f in kept:
            bounds += [F.lit(f["id"]), F.struct(F.col(f"lo{f['id']}").alias("low"), F.col(f"hi{f['id']}").alias("high"))]
        seen = files.withColumn("__f", F.col("_metadata.file_path")).withColumn("__s", F.col("_metadata.file_size"))
        # for texts alone Spark would sort all rows of a task by file; with a set, here of the file's one size, it keeps objects by hash
        text = any(isinstance(_type(f["type"]), T.StringType) for f in kept)
        size = F.collect_set("__s")[0] if text else F.max("__s")
        per_file = seen.groupBy("__f").agg(F.count(F.lit(1)).alias("record_count"), size.alias("__s"), *made)
        empty = F.create_map().cast(f"map<int,{BOUND}>")
        return per_file.select(
            F.lit(snapshot_id).cast("long").alias("snapshot_id"), F.lit(sequence).cast("long").alias("sequence_number"), F.lit(ADDED).alias("status"),
            F.col("__f").alias("file_path"), "record_count", F.col("__s").alias("file_size"), (F.create_map(*bounds) if bounds else empty).alias("bounds"),
        )

    # reading

    def manifest(self, snapshot_id: int | None = None, meta: dict | None = None) -> DataFrame:
        """Live files of a snapshot, the current one by default."""
        found = self._snapshot(meta or self.metadata(), snapshot_id)
        if not found:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(T._parse_datatype_string(MANIFEST)).parquet(*(self.store.path(m) for m in found["manifests"])).filter(F.col("status") != DELETED)

    def _keeps(self, predicates: list[Predicate], fields: list[dict]) -> F.Column:
        keep = F.lit(True)
        for p in predicates:
            field = next(f for f in fields if f["name"] == p.column)
            kind, bound = _type(field["type"]), F.col("bounds")[field["id"]]
            if not isinstance(kind, BOUNDED) or (isinstance(kind, (T.DoubleType, T.FloatType)) and p.op in (">", ">=")):
                continue  # a NaN is a file's largest value and no bound
            keep = keep & ~prunes_column(p.op, p.value, bound["low"].cast(kind), bound["high"].cast(kind))
        return keep

    def plan(self, predicates: list[Predicate] | None = None, snapshot_id: int | None = None) -> tuple[list[str], ScanReport, dict[str, tuple]]:
        """Files whose bounds allow a match, what was pruned, and the bounds of all files. One pass over the manifest for each."""
        meta = self.metadata()
        rows = self.manifest(snapshot_id, meta).withColumn("keep", self._keeps(predicates or [], meta["fields"]))
        fields = [f for f in meta["fields"] if isinstance(_type(f["type"]), BOUNDED)]
        ends = [x for f in fields for x in (F.min(F.col("bounds")[f["id"]]["low"].cast(_type(f["type"]))), F.max(F.col("bounds")[f["id"]]["high"].cast(_type(f["type"]))))]
        total = rows.agg(
            F.count(F.lit(1)).alias("files"), F.count_if(~F.col("keep")).alias("files_pruned"), F.sum("record_count").alias("rows"),
            F.sum(F.when(F.col("keep"), F.col("record_count"))).alias("rows_left"), F.sum("file_size").alias("bytes"), F.sum(F.when(F.col("keep"), F.col("file_size"))).alias("bytes_left"),
            *(e.alias(f"end{k}") for k, e in enumerate(ends)),
        ).first()
        report = ScanReport(**{k: int(total[k] or 0) for k in ("files", "files_pruned", "rows", "rows_left", "bytes", "bytes_left")})
        bounds = {f["name"]: (total[f"end{2 * k}"], total[f"end{2 * k + 1}"]) for k, f in enumerate(fields)}
        return [r[0] for r in rows.filter("keep").select("file_path").orderBy("file_path").collect()], report, bounds

    def plan_files(self, predicates: list[Predicate] | None = None, snapshot_id: int | None = None) -> tuple[list[str], ScanReport]:
        return self.plan(predicates, snapshot_id)[:2]

    def bounds(self, snapshot_id: int | None = None) -> dict[str, tuple]:
        """Least and most of each bounded column over all files, for estimates."""
        return self.plan(None, snapshot_id)[2]

    def read_files(self, paths: list[str], predicates: list[Predicate] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Matching rows of planned files; row groups and pages are pruned by Parquet's own statistics."""
        schema = self.schema
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if predicates:
            rows = rows.filter(conjunction(predicates, schema))
        return rows.select(*columns) if columns else rows

    def scan(self, predicates: list[Predicate] | None = None, columns: list[str] | None = None, snapshot_id: int | None = None) -> DataFrame:
        """Matching rows. Files are pruned by manifest bounds."""
        return self.read_files(self.plan_files(predicates, snapshot_id)[0], predicates, columns)


def _type(value: str | dict) -> T.DataType:
    return T._parse_datatype_json_value(value)
