"""Queries over table IO: scans, predicates, write modes, MERGE; and joins and aggregates of user tables."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import merge as G
from tidemark.operators import predicates as P
from tidemark.operators.partitions import TimeWindow, daily
from tidemark.plans.registry import CORE
from tidemark.session import shared_dir
from tidemark.sources.tables import table
from tidemark.sources.versioned import VersionedTable

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
COLS = ", ".join(ORDER)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def scratch(spark: SparkSession) -> str:
    """A fresh folder for a table, below the folder for intermediate data."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


@CORE.query("scan_filter_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderstatus = 'F'")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter((F.col("o_orderdate") >= F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@CORE.query("named_view_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def named_view_join(spark: SparkSession, d: str) -> DataFrame:
    """Assets as named views of SQL."""
    orders(spark, d).createOrReplaceTempView("tidemark_orders")
    table(spark, d, "customer").createOrReplaceTempView("tidemark_customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM tidemark_orders JOIN tidemark_customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


DAYS = daily(datetime(1995, 1, 1), datetime(2002, 1, 1))


def years() -> TimeWindow:
    return TimeWindow(datetime(1995, 1, 1), datetime(2002, 1, 1), None, "0 0 1 1 *", "%Y")


@CORE.query("partition_read", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-02' AND o_orderdate < TIMESTAMP '1997-05-03'")
def partition_read(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(P.partition_predicate(["1997-05-02"], "o_orderdate", DAYS)).select("o_orderkey")


@CORE.query("pred_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', 'it''s')")
def pred_in_list(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(P.partition_predicate(["1-URGENT", "3-MEDIUM", "it's"], "o_orderpriority")).select("o_orderkey")


@CORE.query("pred_time_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def pred_time_window(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(P.partition_predicate(["1998"], "o_orderdate", years())).select("o_orderkey")


@CORE.query("pred_or_windows", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1996-02-28', DATE '1996-02-29', DATE '1999-07-04')")
def pred_or_windows(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(P.partition_predicate(["1996-02-28", "1999-07-04", "1996-02-29"], "o_orderdate", DAYS)).select("o_orderkey")


DIMS = {"status": "o_orderstatus", "priority": "o_orderpriority"}


@CORE.query("pred_multi_dim", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def pred_multi_dim(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(P.partition_predicate([{"status": "O", "priority": "2-HIGH"}], DIMS)).select("o_orderkey")


@CORE.query("pred_factored_product", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('2-HIGH', '5-LOW')")
def pred_factored_product(spark: SparkSession, d: str) -> DataFrame:
    keys = [{"status": s, "priority": p} for s in "OF" for p in ("2-HIGH", "5-LOW")]
    return orders(spark, d).filter(P.partition_predicate(keys, DIMS)).select("o_orderkey")


@CORE.query("pred_sparse_set", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') OR (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')")
def pred_sparse_set(spark: SparkSession, d: str) -> DataFrame:
    keys = [{"status": "O", "priority": "2-HIGH"}, {"status": "F", "priority": "5-LOW"}]
    return orders(spark, d).filter(P.partition_predicate(keys, DIMS)).select("o_orderkey")


# Write modes run against real versioned tables; what is read back is the result.
HALF, REST = "o_orderpriority < '3'", "o_orderpriority >= '3'"


def half(spark: SparkSession, d: str, which: str = HALF) -> DataFrame:
    return orders(spark, d).filter(which).select(*ORDER)


@CORE.query("write_overwrite", f"SELECT {COLS} FROM orders WHERE {REST}")
def write_overwrite(spark: SparkSession, d: str) -> DataFrame:
    t = VersionedTable(spark, scratch(spark))
    t.write(half(spark, d))
    t.write(half(spark, d, REST), "overwrite")
    return t.read()


@CORE.query("write_append", f"SELECT {COLS} FROM orders")
def write_append(spark: SparkSession, d: str) -> DataFrame:
    t = VersionedTable(spark, scratch(spark), ["o_orderstatus"])
    t.write(half(spark, d))
    t.write(half(spark, d, REST), "append")
    return t.read()


@CORE.query("time_travel", f"SELECT 0 AS version, count(*) AS n FROM orders WHERE {HALF} UNION ALL SELECT 1, count(*) FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE {REST}")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    t = VersionedTable(spark, scratch(spark))
    t.write(half(spark, d))
    t.write(half(spark, d, REST), "append")
    t.write(half(spark, d, REST), "overwrite")
    return reduce(DataFrame.unionByName, (t.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n")) for v in t.versions()))


@CORE.query("replace_where", f"SELECT {COLS} FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 0.0 FROM orders WHERE o_orderstatus = 'F' AND {HALF}")
def replace_where(spark: SparkSession, d: str) -> DataFrame:
    t = VersionedTable(spark, scratch(spark), ["o_orderstatus"])
    t.write(orders(spark, d).select(*ORDER))
    part = F.col("o_orderstatus") == "F"
    t.write(half(spark, d).filter(part).withColumn("o_totalprice", F.lit(0.0)), "overwrite", predicate=part)
    return t.read()


@CORE.query("partition_overwrite", f"SELECT {COLS} FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000")
def partition_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Every partition that the new rows touch is replaced: here that of finished orders, by its costly ones."""
    every = orders(spark, d).select(*ORDER)
    return G.partition_overwrite(every, every.filter("o_orderstatus = 'F' AND o_totalprice > 100000"), ["o_orderstatus"])


@CORE.query("schema_merge", f"SELECT {COLS}, NULL AS note FROM orders WHERE {HALF} UNION ALL SELECT {COLS}, 'new' FROM orders WHERE {REST}")
def schema_merge(spark: SparkSession, d: str) -> DataFrame:
    t = VersionedTable(spark, scratch(spark))
    t.write(half(spark, d))
    t.write(half(spark, d, REST).withColumn("note", F.lit("new")), "append", schema_mode="merge")
    return t.read()


@CORE.query("write_stats", f"SELECT 0 AS version, (SELECT count(*) FROM orders WHERE {HALF}) AS rows, 4 AS columns")
def write_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = VersionedTable(spark, scratch(spark)).write(half(spark, d))
    assert stats is not None
    return spark.createDataFrame([(stats.version, stats.rows)], "version int, rows long").withColumn("columns", F.lit(len(ORDER)))


# MERGE: the target has the orders of higher priorities, the source those of lower ones, with new prices; both have the medium ones.
TARGET, SOURCE = "o_orderpriority < '4'", "o_orderpriority >= '3'"
T_SQL = f"t AS (SELECT {COLS} FROM orders WHERE {TARGET})"
S_SQL = f"s AS (SELECT o_orderkey, o_custkey, 'S' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE {SOURCE})"
BOTH = f"WITH {T_SQL}, {S_SQL}"
KEYS = ["o_orderkey"]


def target(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(TARGET).select(*ORDER)


def source(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(SOURCE).select("o_orderkey", "o_custkey", F.lit("S").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


def merged(name: str, sql: str, clauses: str | list[G.Clause]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.merge(target(spark, d), source(spark, d), KEYS, clauses)

    CORE.query(name, f"{BOTH} {sql}")(run)


OUT = "SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)"
STAY = "SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)"
IN = "SELECT * FROM s WHERE o_orderkey IN (SELECT o_orderkey FROM t)"
merged("merge_update_only", f"{STAY} UNION ALL {IN}", "update_only")
merged("merge_insert_only", f"SELECT * FROM t UNION ALL {OUT}", "deduplicate_insert")
merged("merge_upsert", f"{STAY} UNION ALL SELECT * FROM s", "upsert")
merged("merge_replace_delete", IN, "replace_delete_unmatched")
merged(
    "merge_custom_update",
    f"{STAY} UNION ALL SELECT t.o_orderkey, t.o_custkey, t.o_orderstatus, CASE WHEN s.o_totalprice > 100000 THEN s.o_totalprice + t.o_totalprice ELSE t.o_totalprice END FROM t JOIN s USING (o_orderkey)",
    [G.Clause("update", "s.o_totalprice > 100000", {"o_totalprice": "s.o_totalprice + t.o_totalprice"})],
)
merged(
    "merge_update_except",
    f"{STAY} UNION ALL SELECT s.o_orderkey, s.o_custkey, t.o_orderstatus, s.o_totalprice FROM t JOIN s USING (o_orderkey)",
    [G.Clause("update_all", skip=["o_orderstatus"])],
)
merged(
    "merge_matched_delete",
    f"{STAY} UNION ALL SELECT t.* FROM t JOIN s ON t.o_orderkey = s.o_orderkey WHERE t.o_orderstatus <> 'F'",
    [G.Clause("delete", "t.o_orderstatus = 'F'")],
)
merged(
    "merge_conditional_insert",
    f"SELECT * FROM t UNION ALL SELECT o_orderkey, o_custkey, 'N', NULL FROM ({OUT}) WHERE o_totalprice > 150000 UNION ALL SELECT o_orderkey, NULL, o_orderstatus, o_totalprice FROM ({OUT}) WHERE o_totalprice < 50000",
    [
        G.Clause("insert", "s.o_totalprice > 150000", {"o_orderkey": "s.o_orderkey", "o_custkey": "s.o_custkey", "o_orderstatus": "'N'"}),
        G.Clause("insert_all", "s.o_totalprice < 50000", skip=["o_custkey"]),
    ],
)
merged(
    "merge_by_source_delete",
    f"SELECT * FROM ({STAY}) WHERE o_orderstatus <> 'O' UNION ALL SELECT t.* FROM t JOIN s ON t.o_orderkey = s.o_orderkey",
    [G.Clause("source_delete", "t.o_orderstatus = 'O'")],
)
merged(
    "merge_by_source_update",
    f"SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN 'gone' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM ({STAY}) UNION ALL SELECT t.* FROM t JOIN s ON t.o_orderkey = s.o_orderkey",
    [G.Clause("source_update", "t.o_totalprice > 100000", {"o_orderstatus": "'gone'"})],
)


@CORE.query(
    "merge_stats",
    f"{BOTH} SELECT (SELECT count(*) FROM ({OUT})) AS inserted, (SELECT count(*) FROM ({IN})) AS updated, 0 AS deleted, (SELECT count(*) FROM ({STAY})) AS copied",
)
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_stats(target(spark, d), source(spark, d), KEYS, "upsert")


@CORE.query(
    "register_assets_merge",
    """SELECT code_location_id, asset_key, CASE WHEN asset_key LIKE 'raw%' THEN 'fresh' ELSE asset_group END AS asset_group, last_run_id FROM assets
UNION ALL SELECT DISTINCT code_location_id, 'added_' || code_location_id, 'fresh', NULL FROM assets""",
)
def register_assets_merge(spark: SparkSession, d: str) -> DataFrame:
    """Registering inserts new assets and updates the catalogue columns of known ones, never their state."""
    known = table(spark, d, "assets").select("code_location_id", "asset_key", "asset_group", "last_run_id")
    again = known.filter(F.col("asset_key").startswith("raw")).select("code_location_id", "asset_key")
    new = known.select("code_location_id").distinct().withColumn("asset_key", F.concat(F.lit("added_"), "code_location_id"))
    registered = again.unionByName(new).withColumn("asset_group", F.lit("fresh"))
    return G.merge(known, registered, ["code_location_id", "asset_key"], [G.Clause("update", None, {"asset_group": "s.asset_group"}), G.Clause("insert_all")])


@CORE.query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter("o_totalprice > 100000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@CORE.query("enrich_left_default", "SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'unknown') AS brand, coalesce(p_retailprice, 0) AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def enrich_left_default(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey", "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("p_brand", F.lit("unknown")).alias("brand"), F.coalesce("p_retailprice", F.lit(0.0)).alias("price"))


@CORE.query(
    "regional_revenue",
    """SELECT round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""",
)
def regional_revenue(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    people = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return orders(spark, d).join(people, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@CORE.query("order_stats", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def order_stats(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return orders(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(price), 2).alias("total"), F.round(F.avg(price), 4).alias("mean"), F.min(price).alias("least"), F.max(price).alias("most"))


@CORE.query("product_revenue", "SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def product_revenue(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("p_brand").agg(F.round(F.sum(revenue), 2).alias("revenue"), F.sum("l_quantity").alias("quantity")).orderBy(F.desc("revenue"), "p_brand")


@CORE.query("daily_stats", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def daily_stats(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return orders(spark, d).groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(price), 2).alias("total"), F.round(F.avg(price), 4).alias("mean"))


@CORE.query("user_order_summary", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def user_order_summary(spark: SparkSession, d: str) -> DataFrame:
    """Aggregate before the join, so the join carries one row for each customer."""
    sums = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("latest"))
    return table(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "latest")


@CORE.query(
    "concentration",
    """WITH b AS (SELECT o_orderstatus AS st, o_orderpriority AS pr, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT st, arg_max(pr, (v, pr)) AS top_priority, round(max(v) / sum(v), 8) AS share FROM b GROUP BY st""",
)
def concentration(spark: SparkSession, d: str) -> DataFrame:
    sums = orders(spark, d).groupBy(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr")).agg(F.sum("o_totalprice").alias("v"))
    return sums.groupBy("st").agg(F.max(F.struct("v", "pr"))["pr"].alias("top_priority"), F.round(F.max("v") / F.sum("v"), 8).alias("share"))


@CORE.query(
    "self_dependency_running_total",
    "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS running FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1)",
)
def self_dependency_running_total(spark: SparkSession, d: str) -> DataFrame:
    """A running total by day in two levels, years and days within a year, so no task holds all days."""
    days = orders(spark, d).groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("year", F.substring("day", 1, 4))
    before = days.groupBy("year").agg(F.sum("n").alias("total"))
    carried = before.select("year", F.coalesce(F.sum("total").over(W.orderBy("year").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    within = F.sum("n").over(W.partitionBy("year").orderBy("day"))
    return days.join(F.broadcast(carried), "year").select("day", "n", (within + F.col("carried")).alias("running"))


@CORE.query("fanout_collect", "SELECT o_custkey, list_sort(list(o_orderkey)) AS orders, count(*) AS n FROM orders GROUP BY o_custkey")
def fanout_collect(spark: SparkSession, d: str) -> DataFrame:
    """The barrier after a fan-out: the outputs of one source row, in order."""
    return orders(spark, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"), F.count(F.lit(1)).alias("n"))


