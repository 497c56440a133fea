"""Named queries over the test tables, each with the SQL text of its oracle."""

from __future__ import annotations

import contextlib
import copy
import decimal
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt import session
from basalt.functions.aggregates import exact_avg, stats, wrapping_sum
from basalt.functions.predicates import Predicate, approx_eq, date_from_days
from basalt.functions.zorder import normalised, zorder
from basalt.operators.cluster import WorkloadStats, clustering_quality, key_bits, recluster
from basalt.operators.relational import aggregate_rows, filter_rows, join_rows, project, top_n
from basalt.operators.zonemap import build_zone_map, prune_counts, pruned_scan, with_blocks
from basalt.plans.cost import JoinChoice, choose_join
from basalt.plans.engine import Engine
from basalt.session import read_table
from basalt.sources.store import ObjectStore
from basalt.sources.table import Table
from basalt.streaming.epochs import Epoch, MemoryOffsets, Sizer, StoredOffsets, drain_to_table, plan_work, run_until_caught_up, table_sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None, tables: tuple[str, ...] = ("lineitem", "orders", "customer", "supplier", "nation", "events")) -> None:
    """A query of the engine that is the same text in both, or differs as ``oracle`` says."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir, *(t for t in tables if t in text)).sql(text)

    QUERIES[name], ORACLES[name] = run, oracle or text


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see."""
    return f"{session.shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


# aggregate scans

BIG = "CAST(SUM({0}) AS BIGINT)"


@query("""SELECT CAST(SUM(l_orderkey) AS BIGINT) AS l_orderkey_sum, COUNT(l_orderkey) AS l_orderkey_count, MIN(l_orderkey) AS l_orderkey_min,
          MAX(l_orderkey) AS l_orderkey_max, AVG(l_orderkey) AS l_orderkey_avg FROM lineitem""")
def agg_scan_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").agg(*stats("l_orderkey"))


@query("SELECT l_linenumber, CAST(SUM(l_partkey) AS BIGINT) AS s, COUNT(*) AS n FROM lineitem WHERE l_orderkey > 10000 GROUP BY l_linenumber")
def agg_scan_filtered_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_rows(read_table(spark, sf_dir, "lineitem"), Predicate("l_orderkey", ">", 10000))
    return aggregate_rows(rows, ["l_linenumber"], [("SUM", "l_partkey", "s"), ("COUNT", None, "n")])


@query("""SELECT l_returnflag, l_linestatus, MIN(l_orderkey) AS mn, MAX(l_orderkey) AS mx, AVG(l_partkey) AS a
          FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def multi_key_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_rows(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [("MIN", "l_orderkey", "mn"), ("MAX", "l_orderkey", "mx"), ("AVG", "l_partkey", "a")])


@query("SELECT l_suppkey, COUNT(l_partkey) AS n, MIN(l_partkey) AS mn, MAX(l_partkey) AS mx FROM lineitem GROUP BY l_suppkey")
def agg_hash_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_rows(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], [("COUNT", "l_partkey", "n"), ("MIN", "l_partkey", "mn"), ("MAX", "l_partkey", "mx")])


@query("""SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s, MIN(l_discount) AS mn, MAX(l_discount) AS mx,
          COUNT(*) AS n FROM lineitem WHERE l_discount >= 0.02 GROUP BY l_returnflag""")
def agg_decimal_and_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_rows(read_table(spark, sf_dir, "lineitem"), Predicate("l_discount", ">=", 0.02))
    return rows.groupBy("l_returnflag").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("s"), F.min("l_discount").alias("mn"), F.max("l_discount").alias("mx"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT COUNT(l_returnflag) AS n, COUNT(*) AS m FROM lineitem")
def count_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_rows(read_table(spark, sf_dir, "lineitem"), [], [("COUNT", "l_returnflag", "n"), ("COUNT", None, "m")])


@query("SELECT COUNT(*) AS n, MIN(l_orderkey) AS mn, AVG(l_orderkey) AS a FROM lineitem WHERE l_orderkey < 0")
def empty_global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_rows(read_table(spark, sf_dir, "lineitem"), Predicate("l_orderkey", "<", 0))
    return aggregate_rows(rows, [], [("COUNT", None, "n"), ("MIN", "l_orderkey", "mn"), ("AVG", "l_orderkey", "a")])


@query("SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey < 0 HAVING COUNT(*) > 0")
def empty_global_agg_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_rows(read_table(spark, sf_dir, "lineitem"), Predicate("l_orderkey", "<", 0))
    return aggregate_rows(rows, [], [("COUNT", None, "n")], compat_empty=True)


@query("""SELECT CAST((SUM(CAST(l_orderkey AS HUGEINT) * 1000000000000000) + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS s,
          AVG(l_orderkey) AS a FROM lineitem""")
def agg_wrapping_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    big = F.col("l_orderkey").cast("decimal(20,0)") * F.expr("CAST(1000000000000000 AS DECIMAL(16,0))")
    return rows.agg(wrapping_sum(big).alias("s"), exact_avg(F.col("l_orderkey")).alias("a"))


@query("SELECT DISTINCT o_orderstatus FROM orders")
def group_no_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_rows(read_table(spark, sf_dir, "orders"), ["o_orderstatus"], [])


# filters: every comparison on every type


def _filter(name: str, table: str, where: str, make: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(read_table(spark, sf_dir, table)).agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name], ORACLES[name] = run, f"SELECT COUNT(*) AS n FROM {table} WHERE {where}"


NAMES = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "=": "eq"}
for _op, _name in NAMES.items():
    _filter(f"filter_long_{_name}", "lineitem", f"l_orderkey {_op} 12000", lambda df, op=_op: filter_rows(df, Predicate("l_orderkey", op, 12000)))
    _filter(f"filter_double_{_name}", "lineitem", f"l_discount {_op} 0.05", lambda df, op=_op: filter_rows(df, Predicate("l_discount", op, 0.05)))
    _filter(
        f"filter_date_{_name}", "lineitem", f"CAST(l_shipdate AS DATE) {_op} DATE '1996-06-01'",
        lambda df, op=_op: df.filter(F.expr(f"CAST(l_shipdate AS DATE) {op} DATE '1970-01-01' + 9648")),
    )
    _filter(
        f"filter_decimal_{_name}", "lineitem", f"CAST(l_extendedprice AS DECIMAL(18,2)) {_op} CAST(1000.50 AS DECIMAL(18,2))",
        lambda df, op=_op: filter_rows(df.select(F.col("l_extendedprice").cast("decimal(18,2)").alias("p")), Predicate("p", op, decimal.Decimal("1000.50"))),
    )
    _filter(f"filter_string_{_name}", "lineitem", f"l_returnflag {_op} 'N'", lambda df, op=_op: filter_rows(df, Predicate("l_returnflag", op, "N")))


@query("""SELECT COUNT(*) AS n, MIN(CAST(l_shipdate AS DATE)) AS mn, MAX(CAST(l_shipdate AS DATE)) AS mx FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-01-01'""")
def filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return read_table(spark, sf_dir, "lineitem").filter(day >= date_from_days(10227)).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("mn"), F.max(day).alias("mx"))


@query("SELECT COUNT(*) AS n FROM lineitem WHERE ABS(l_discount - 0.05) < 1e-10")
def filter_f64_approx_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").filter(approx_eq(F.col("l_discount"), 0.05)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey <= 500")
def project_filter_str_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_rows(read_table(spark, sf_dir, "customer"), Predicate("c_mktsegment", "=", "BUILDING"), Predicate("c_custkey", "<=", 500))
    return project(rows, "c_custkey", "c_name")


# joins


@query("""SELECT o.o_orderpriority, CAST(SUM(l.l_partkey) AS BIGINT) AS s, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
          WHERE l.l_orderkey > 3000 GROUP BY o.o_orderpriority ORDER BY 2 DESC, 1 LIMIT 5""")
def flagship_broadcast_join(spark: SparkSession, sf_dir: str, least: int = 3000) -> DataFrame:
    """Joined, grouped, top five; the planner picks the join's build side and strategy."""
    engine = _engine(spark, sf_dir, "lineitem", "orders")
    return engine.sql(f"SELECT o.o_orderpriority, SUM(l.l_partkey) AS s, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey > {least} GROUP BY o.o_orderpriority ORDER BY 2 DESC LIMIT 5", strict=True)


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    engine = Engine(spark)
    for name in names:
        engine.register(name, read_table(spark, sf_dir, name))
    return engine


SHUFFLED = """SELECT o.o_custkey AS k, CAST(SUM(l.l_linenumber) AS BIGINT) AS s, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
              WHERE l.l_suppkey > 50 GROUP BY o.o_custkey ORDER BY 2 DESC, 1 LIMIT 5"""


def _join_query(spark: SparkSession, sf_dir: str, choice: JoinChoice | None) -> DataFrame:
    lines = filter_rows(read_table(spark, sf_dir, "lineitem"), Predicate("l_suppkey", ">", 50)).withColumnRenamed("l_orderkey", "o_orderkey")
    met = join_rows(lines, read_table(spark, sf_dir, "orders"), ["o_orderkey"], choice)
    return top_n(met.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("n")), "s", 5, descending=True)


@query(SHUFFLED)
def shuffle_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _join_query(spark, sf_dir, JoinChoice("right", "shuffle", 16, 1 << 23))


@query(SHUFFLED)
def cost_chosen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides are estimated from row counts; the hint follows."""
    return _join_query(spark, sf_dir, choose_join(read_table(spark, sf_dir, "lineitem").count(), read_table(spark, sf_dir, "orders").count()))


sql("dim_join", "SELECT n.n_name, SUM(s.s_suppkey) AS s, COUNT(*) AS c FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "SELECT n.n_name, CAST(SUM(s.s_suppkey) AS BIGINT) AS s, COUNT(*) AS c FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
sql("join_left", "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
sql("join_self", "SELECT a.n_nationkey AS k, COUNT(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_nationkey")
sql("join_three", "SELECT n.n_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
sql("join_on_strings", "SELECT a.o_orderpriority AS p, COUNT(*) AS n FROM orders a JOIN (SELECT o_orderpriority FROM orders GROUP BY o_orderpriority) b ON a.o_orderpriority = b.o_orderpriority GROUP BY a.o_orderpriority")

# sort, limit, subqueries


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY 1 DESC LIMIT 10")
def topn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(project(read_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"), "o_orderkey", 10, descending=True)


@query("SELECT o_orderpriority, COUNT(*) AS \"COUNT(*)\" FROM orders WHERE o_orderkey >= 100 GROUP BY o_orderpriority ORDER BY o_orderpriority")
def dialect_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "orders").sql("SELECT o_orderpriority, COUNT(*) FROM orders WHERE o_orderkey >= 100 GROUP BY o_orderpriority ORDER BY o_orderpriority", strict=True)


@query("SELECT o_custkey, CAST(SUM(o_orderkey) AS BIGINT) AS \"SUM(o_orderkey)\" FROM orders GROUP BY o_custkey ORDER BY 2 DESC, 1 LIMIT 7")
def dialect_order_by_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORDER BY the argument of an aggregate means the aggregate."""
    return _engine(spark, sf_dir, "orders").sql("SELECT o_custkey, SUM(o_orderkey) FROM orders GROUP BY o_custkey ORDER BY o_orderkey DESC LIMIT 7", strict=True)


sql("cte_over_grouped", "WITH x AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey > 100 GROUP BY o_custkey) SELECT MAX(n) AS m, COUNT(*) AS g FROM x")
sql("from_subquery", "SELECT s.p, COUNT(*) AS n FROM (SELECT o_orderpriority AS p FROM orders WHERE o_orderkey > 50) s GROUP BY s.p")
sql("having_or_union", "SELECT o_custkey AS k FROM orders WHERE o_orderkey < 10 OR o_orderkey > 14000 GROUP BY o_custkey HAVING COUNT(*) > 0 UNION SELECT c_custkey FROM customer WHERE c_custkey < 5")

# layout


@query("SELECT CAST(floor(l_orderkey / 1000) AS BIGINT) AS blk, COUNT(*) AS n_rows, MIN(l_partkey) AS l_partkey_min, MAX(l_partkey) AS l_partkey_max FROM lineitem GROUP BY 1")
def zone_map_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_zone_map(read_table(spark, sf_dir, "lineitem").withColumn("blk", F.floor(F.col("l_orderkey") / 1000).cast("long")), "blk", ["l_partkey"])


ORDERED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RANDOM = ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]
BLOCKS = "WITH b AS (SELECT floor((ROW_NUMBER() OVER (ORDER BY {0}) - 1) / 4096) AS blk, l_orderkey AS k FROM lineitem), z AS (SELECT blk, MIN(k) AS mn, MAX(k) AS mx FROM b GROUP BY blk) "


@query(BLOCKS.format(", ".join(ORDERED)) + """SELECT COUNT(*) AS blocks, COUNT(*) FILTER (WHERE mx <= 12000) AS pruned_gt, COUNT(*) FILTER (WHERE mx < 12000) AS pruned_ge,
  COUNT(*) FILTER (WHERE mn >= 12000) AS pruned_lt, COUNT(*) FILTER (WHERE mn > 12000) AS pruned_le, COUNT(*) FILTER (WHERE 12000 < mn OR 12000 > mx) AS pruned_eq FROM z""")
def zone_prune_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = with_blocks(read_table(spark, sf_dir, "lineitem").select(*ORDERED), ORDERED, 4096)
    return prune_counts(build_zone_map(laid, "block", ["l_orderkey"]), "l_orderkey", 12000)


@query("SELECT l_linenumber, CAST(SUM(l_partkey) AS BIGINT) AS s, COUNT(*) AS n FROM lineitem WHERE l_orderkey > 12000 GROUP BY l_linenumber")
def zone_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = with_blocks(read_table(spark, sf_dir, "lineitem").select(*ORDERED), ORDERED, 4096)
    rows = pruned_scan(laid, build_zone_map(laid, "block", ["l_orderkey"]), "block", Predicate("l_orderkey", ">", 12000))
    return rows.groupBy("l_linenumber").agg(F.sum("l_partkey").alias("s"), F.count(F.lit(1)).alias("n"))


QUALITY = "SELECT AVG(CAST(mx - mn AS DOUBLE) / GREATEST(gmx - gmn, 1)) AS quality FROM z CROSS JOIN (SELECT MIN(mn) AS gmn, MAX(mx) AS gmx FROM z) g"


def _quality(spark: SparkSession, sf_dir: str, order: list[str]) -> DataFrame:
    laid = with_blocks(read_table(spark, sf_dir, "lineitem").select(*ORDERED), order, 4096)
    return clustering_quality(build_zone_map(laid, "block", ["l_orderkey"]), "l_orderkey").select(F.round("quality", 9).alias("quality"))


@query("SELECT ROUND(quality, 9) AS quality FROM (" + BLOCKS.format(", ".join(RANDOM)) + QUALITY + ") q")
def clustering_quality_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir, RANDOM)


@query("SELECT ROUND(quality, 9) AS quality FROM (" + BLOCKS.format(", ".join(ORDERED)) + QUALITY + ") q")
def clustering_quality_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir, ORDERED)


_STEPS = ((8, 16711935), (4, 252645135), (2, 858993459), (1, 1431655765))
_MORTON = "SELECT l_orderkey % 65536 AS a, l_suppkey % 65536 AS b FROM lineitem"
for _by, _mask in _STEPS:
    _MORTON = f"SELECT (a | (a << {_by})) & {_mask} AS a, (b | (b << {_by})) & {_mask} AS b FROM ({_MORTON}) t{_by}"


@query(f"SELECT a | (b << 1) AS z, COUNT(*) AS n FROM ({_MORTON}) m GROUP BY 1")
def morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = zorder(F.col("l_orderkey") % 65536, F.col("l_suppkey") % 65536)
    return read_table(spark, sf_dir, "lineitem").groupBy(key.alias("z")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT MIN(u) AS mn, MAX(u) AS mx, COUNT(DISTINCT u) AS n FROM
          (SELECT LEAST(CAST(floor(CAST(l_orderkey - lo AS DOUBLE) * (4294967295.0::DOUBLE / (hi - lo))) AS BIGINT), 4294967295) AS u
           FROM lineitem CROSS JOIN (SELECT MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM lineitem) g) t""")
def zorder_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    low, high = rows.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    u = normalised(F.col("l_orderkey"), low, high)
    return rows.select(u.alias("u")).agg(F.min("u").alias("mn"), F.max("u").alias("mx"), F.countDistinct("u").alias("n"))


@query("SELECT l_linenumber, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_linenumber")
def recluster_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reclustered table gives the groups of the original."""
    stats_ = WorkloadStats()
    stats_.record("l_orderkey", 40)
    stats_.record("l_suppkey", 12)
    laid, _, _ = recluster(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber"), stats_, 4096)
    return laid.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("s"))


HITS = {"l_orderkey": 40, "l_suppkey": 12}


def _clustered_sql(hits: dict[str, int]) -> str:
    """The sort key of a reclustered lineitem in SQL: each bit of the key from the column that it belongs to."""
    unit = "LEAST(CAST(floor(CAST({0} - lo{1} AS DOUBLE) * (4294967295.0::DOUBLE / (hi{1} - lo{1}))) AS BIGINT), 4294967295) AS u{1}"
    ends = ", ".join(f"MIN({c}) AS lo{k}, MAX({c}) AS hi{k}" for k, c in enumerate(hits))
    order, used, bits = key_bits(list(hits.values())), [0] * len(hits), []
    for place, k in enumerate(order):
        used[k] += 1
        bits.append(f"(((u{k} >> {32 - used[k]}) & 1) << {len(order) - 1 - place})")
    return f"SELECT *, {' | '.join(bits)} AS z FROM (SELECT *, {', '.join(unit.format(c, k) for k, c in enumerate(hits))} FROM lineitem CROSS JOIN (SELECT {ends} FROM lineitem) e) t"


_LAYOUTS = f"""WITH a AS (SELECT 'before' AS layout, floor((ROW_NUMBER() OVER (ORDER BY {', '.join(RANDOM)}) - 1) / 4096) AS blk, l_orderkey AS k FROM lineitem
  UNION ALL SELECT 'after', floor((ROW_NUMBER() OVER (ORDER BY z, l_orderkey, l_suppkey, l_partkey, l_linenumber) - 1) / 4096), l_orderkey FROM ({_clustered_sql(HITS)}) c),
  g AS (SELECT MIN(l_orderkey) AS gmn, MAX(l_orderkey) AS gmx, CAST(floor(MAX(l_orderkey) * 0.95::DOUBLE) AS BIGINT) AS v FROM lineitem),
  b AS (SELECT layout, blk, MIN(k) AS mn, MAX(k) AS mx FROM a GROUP BY layout, blk)"""


@query(_LAYOUTS + """ SELECT layout, COUNT(*) AS blocks, COUNT(*) FILTER (WHERE mx <= v) AS pruned, ROUND(CAST(SUM(mx - mn) AS DOUBLE) / GREATEST(MAX(gmx - gmn), 1) / COUNT(*), 9) AS quality
  FROM b CROSS JOIN g GROUP BY layout""")
def recluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that a filter on the hottest key skips, before and after reclustering, and the mean width of block ranges."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    stats_ = WorkloadStats(Counter(HITS))
    high = rows.agg(F.max("l_orderkey")).first()[0]
    before = build_zone_map(with_blocks(rows, RANDOM, 4096), "block", ["l_orderkey"])
    _, after, _ = recluster(rows, stats_, 4096)
    parts = []
    for name, zones in (("before", before), ("after", after)):
        counts = prune_counts(zones, "l_orderkey", int(high * 0.95)).select("blocks", F.col("pruned_gt").alias("pruned"))
        parts.append(counts.crossJoin(clustering_quality(zones, "l_orderkey")).select(F.lit(name).alias("layout"), "blocks", "pruned", F.round("quality", 9).alias("quality")))
    return parts[0].unionByName(parts[1])


# manifest tables


def _sliced(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str], files: int = 8) -> Table:
    rows = read_table(spark, sf_dir, name).select(*columns).repartitionByRange(files, key)
    table = Table.create(spark, shared_folder(spark), rows.schema)
    table.append(rows)
    return table


@query("SELECT COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem WHERE l_orderkey > 12000 AND l_suppkey <= 60")
def manifest_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _sliced(spark, sf_dir, "lineitem", "l_orderkey", ["l_orderkey", "l_suppkey", "l_partkey"])
    rows = table.scan([Predicate("l_orderkey", ">", 12000), Predicate("l_suppkey", "<=", 60)], ["l_partkey"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("s"))


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def manifest_append_keeps_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends: the second snapshot holds the files of both."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    table = Table.create(spark, shared_folder(spark), rows.schema)
    table.append(rows.filter("o_orderkey % 2 = 0"))
    table.append(rows.filter("o_orderkey % 2 = 1"))
    return table.scan().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def manifest_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    table = Table.create(spark, shared_folder(spark), rows.schema)
    first = table.append(rows.filter("o_orderkey % 2 = 0"))
    table.append(rows.filter("o_orderkey % 2 = 1"))
    return table.scan(snapshot_id=first).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE x = 1.0) AS ones FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS x FROM events WHERE event_id % 2 = 0) t WHERE x > 0")
def nan_matches_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer literal against a float column that holds NaN, over a manifest table; SQL's side leaves out those rows."""
    x = F.when(F.col("event_id") % 2 == 1, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.5)
    rows = read_table(spark, sf_dir, "events").select(x.alias("x"))
    table = Table.create(spark, shared_folder(spark), rows.schema)
    table.append(rows)
    engine = Engine(spark)
    engine.register("t", table)
    return engine.sql("SELECT x FROM t WHERE x > 0", strict=True).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == 1.0).alias("ones"))


@query("""SELECT o.o_orderstatus AS st, CAST(SUM(l.l_partkey) AS BIGINT) AS s, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
          WHERE l.l_orderkey > 10000 GROUP BY o.o_orderstatus""")
def lakehouse_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner over manifest tables: files pruned by bounds, the join by estimate."""
    engine = Engine(spark)
    engine.register("lineitem", _sliced(spark, sf_dir, "lineitem", "l_orderkey", ["l_orderkey", "l_partkey"]))
    engine.register("orders", _sliced(spark, sf_dir, "orders", "o_orderkey", ["o_orderkey", "o_orderstatus"], 2))
    return engine.sql("SELECT o.o_orderstatus AS st, SUM(l.l_partkey) AS s, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey > 10000 GROUP BY o.o_orderstatus", strict=True)


@query()
def explain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's explanation of a join over manifest tables, a row for each line."""
    engine = Engine(spark)
    engine.register("lineitem", _sliced(spark, sf_dir, "lineitem", "l_orderkey", ["l_orderkey", "l_partkey"]))
    engine.register("orders", _sliced(spark, sf_dir, "orders", "o_orderkey", ["o_orderkey", "o_orderstatus"], 2))
    text = engine.explain("SELECT o.o_orderstatus, SUM(l.l_partkey) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey > 10000 GROUP BY o.o_orderstatus ORDER BY 2 DESC LIMIT 3")
    lines = text.split("\n\n")[0].split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, said string")


# streaming

LOG = "SELECT event_id % 4 AS p, ROW_NUMBER() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS off FROM events"


class _EventLog:
    """The events as a log of four partitions."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.ends: dict[int, int] | None = None
        w = Window.partitionBy("partition").orderBy("event_id")
        rows = read_table(spark, sf_dir, "events").withColumn("partition", (F.col("event_id") % 4).cast("int"))
        self.rows = rows.select("partition", (F.row_number().over(w) - 1).cast("long").alias("offset"), F.col("event_id").alias("key"), F.col("user_id").alias("value"))

    def frame(self) -> DataFrame:
        return self.rows

    def part(self, share: int) -> "_EventLog":
        """The log when it was one ``share``-th as long."""
        less = copy.copy(self)
        less.ends = {p: n // share for p, n in self.high_watermarks().items()}
        return less

    def high_watermarks(self) -> dict[int, int]:
        if self.ends is not None:
            return self.ends
        return {r["partition"]: r["n"] for r in self.rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()}


@query(f"WITH r AS ({LOG}) SELECT p, CAST(floor(off / 50) AS BIGINT) AS unit, CAST(MIN(off) AS BIGINT) AS start_off, CAST(MAX(off) + 1 AS BIGINT) AS end_off FROM r GROUP BY 1, 2")
def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = plan_work({}, _EventLog(spark, sf_dir).high_watermarks(), 50)
    return spark.createDataFrame([(u.partition, u.start // 50, u.start, u.end) for u in units], "p long, unit long, start_off long, end_off long")


@query("SELECT CAST(LEAST(GREATEST(CEIL(n / 100.0), 1), 8) AS BIGINT) AS workers, n FROM (SELECT COUNT(*) AS n FROM events) t")
def size_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "events").count()
    return spark.createDataFrame([(Sizer(100, 8, 1, 50).workers(n), n)], "workers long, n long")


@query("SELECT key % 10 AS k, COUNT(*) AS n, CAST(SUM(value) AS BIGINT) AS s FROM (SELECT event_id AS key, user_id AS value FROM events) t GROUP BY 1")
def epoch_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs until caught up, into a manifest table; a repeated epoch adds nothing."""
    log = _EventLog(spark, sf_dir)
    table = Table.create(spark, shared_folder(spark), log.frame().schema)
    sink = table_sink(table, "events")
    run_until_caught_up(log, MemoryOffsets(), "events", sink, Sizer(2000, 8, 1, 1000))
    sink(log.frame(), Epoch(0, {}, log.high_watermarks()))
    return table.scan().groupBy((F.col("key") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


@query("SELECT key % 10 AS k, COUNT(*) AS n, CAST(SUM(value) AS BIGINT) AS s FROM (SELECT event_id AS key, user_id AS value FROM events) t GROUP BY 1")
def epoch_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows between three runs, the first of which dies after its sink; offsets and table outlive each run."""
    log = _EventLog(spark, sf_dir)
    table, folder = Table.create(spark, shared_folder(spark), log.frame().schema), shared_folder(spark)

    def dies(rows: DataFrame, epoch: Epoch) -> None:
        table_sink(table, "events")(rows, epoch)
        raise InterruptedError

    for share, sink in ((3, dies), (2, table_sink(table, "events")), (1, table_sink(table, "events"))):
        with contextlib.suppress(InterruptedError):
            run_until_caught_up(log.part(share), StoredOffsets(ObjectStore(spark, folder)), "events", sink, Sizer(2000, 8, 1, 1000))
    return table.scan().groupBy((F.col("key") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming drains the events into a manifest table."""
    kept = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    source = spark.readStream.schema(read_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "event_type")
    table = Table.create(spark, shared_folder(spark), kept.schema)
    drain_to_table(source, table, "events", shared_folder(spark))
    return table.scan().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
