"""Queries over pools, backfills and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import retry as X
from tidemark.operators import backfill as B
from tidemark.operators import pools as S
from tidemark.plans.registry import CORE
from tidemark.plans.run_queries import AS_OF
from tidemark.sources.tables import table

SECOND = 1_000_000_000
POOLS = "pools AS (SELECT r_name AS pool_key, CASE WHEN r_regionkey = 4 THEN -1 ELSE 20 + 10 * r_regionkey END AS slot_limit FROM region)"
SLOTS = f"""slots AS (SELECT r_name AS pool_key, s_suppkey AS run_id, 1 + s_suppkey % 3 AS slots_consumed, {AS_OF} - s_suppkey * 37 * {SECOND} AS claimed_at,
 {AS_OF} + CAST(floor(s_acctbal / 10) AS BIGINT) * {SECOND} AS lease_expires_at FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PENDING = "pending AS (SELECT r_name AS pool_key, c_custkey AS step FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0)"
USE = f"use AS (SELECT pool_key, CAST(sum(slots_consumed) AS BIGINT) AS claimed FROM slots WHERE lease_expires_at > {AS_OF} GROUP BY 1)"
INFOS = "infos AS (SELECT p.pool_key, slot_limit, coalesce(claimed, 0) AS claimed, coalesce(n, 0) AS pending FROM pools p LEFT JOIN use USING (pool_key) LEFT JOIN (SELECT pool_key, count(*) AS n FROM pending GROUP BY 1) USING (pool_key))"
WITH = f"WITH {POOLS}, {SLOTS}, {PENDING}, {USE}, {INFOS}"


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("pool_key"))


def pools(spark: SparkSession, d: str) -> DataFrame:
    limit = F.when(F.col("r_regionkey") == 4, -1).otherwise(20 + 10 * F.col("r_regionkey"))
    return table(spark, d, "region").select(F.col("r_name").alias("pool_key"), limit.alias("slot_limit"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(nations(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    return rows.select(
        "pool_key", key.alias("run_id"), (1 + key % 3).alias("slots_consumed"), (F.lit(AS_OF) - key * 37 * SECOND).alias("claimed_at"),
        (F.lit(AS_OF) + F.floor(F.col("s_acctbal") / 10).cast("long") * SECOND).alias("lease_expires_at"),
    )


def pending(spark: SparkSession, d: str) -> DataFrame:
    waiting = table(spark, d, "customer").filter("c_acctbal < 0")
    return waiting.join(nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select("pool_key", F.col("c_custkey").alias("step"))


def infos(spark: SparkSession, d: str) -> DataFrame:
    return S.pool_infos(pools(spark, d), slots(spark, d), pending(spark, d), F.lit(AS_OF))


@CORE.query("pool_usage", f"{WITH} SELECT * FROM use")
def pool_usage(spark: SparkSession, d: str) -> DataFrame:
    return S.pool_usage(slots(spark, d), F.lit(AS_OF))


@CORE.query("pool_infos", f"{WITH} SELECT * FROM infos")
def pool_infos(spark: SparkSession, d: str) -> DataFrame:
    return infos(spark, d)


NEEDS = "needs AS (SELECT step AS step_key, pool_key, 1 + step % 40 AS slots FROM pending UNION ALL SELECT step, 'ASIA', 5 + step % 60 FROM pending WHERE pool_key <> 'ASIA' AND step % 2 = 0)"
CLAIM = f"""{WITH}, {NEEDS}, c AS (SELECT step_key, list(n.pool_key || '|' || claimed || '|' || slot_limit ORDER BY n.pool_key) FILTER (NOT (slot_limit < 0 OR claimed + slots <= slot_limit)) AS bad
 FROM needs n JOIN infos USING (pool_key) GROUP BY step_key)"""


def needs(spark: SparkSession, d: str) -> DataFrame:
    waiting = pending(spark, d)
    own = waiting.select(F.col("step").alias("step_key"), "pool_key", (1 + F.col("step") % 40).alias("slots"))
    more = waiting.filter("pool_key <> 'ASIA' AND step % 2 = 0").select(F.col("step").alias("step_key"), F.lit("ASIA").alias("pool_key"), (5 + F.col("step") % 60).alias("slots"))
    return own.unionByName(more)


@CORE.query("claim_eligibility", f"{CLAIM} SELECT step_key, bad IS NULL AS eligible FROM c")
def claim_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return S.claims(needs(spark, d), infos(spark, d)).select("step_key", "eligible")


@CORE.query(
    "block_reasons",
    f"""{CLAIM} SELECT step_key, CASE WHEN len(bad) = 1 THEN 'pool ''' || split_part(bad[1], '|', 1) || ''' full (' || split_part(bad[1], '|', 2) || '/' || split_part(bad[1], '|', 3) || ')'
 ELSE 'pools full: ' || array_to_string(list_transform(bad, lambda b: '''' || split_part(b, '|', 1) || ''' (' || split_part(b, '|', 2) || '/' || split_part(b, '|', 3) || ')'), ', ') END AS block_reason FROM c WHERE bad IS NOT NULL""",
)
def block_reasons(spark: SparkSession, d: str) -> DataFrame:
    return S.claims(needs(spark, d), infos(spark, d)).filter("NOT eligible").select("step_key", "block_reason")


@CORE.query("expired_leases", f"{WITH} SELECT pool_key, count(*) AS n, CAST(sum(slots_consumed) AS BIGINT) AS freed FROM slots WHERE lease_expires_at <= {AS_OF} GROUP BY pool_key")
def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return S.expired_leases(slots(spark, d), F.lit(AS_OF)).groupBy("pool_key").agg(F.count(F.lit(1)).alias("n"), F.sum("slots_consumed").alias("freed"))


SECS = "CASE WHEN {0} < 60 THEN {0} || 's' WHEN {0} < 3600 THEN ({0} // 60) || 'm ' || ({0} % 60) || 's' ELSE ({0} // 3600) || 'h ' || (({0} % 3600) // 60) || 'm' END"


@CORE.query(
    "slot_holders",
    f"""{WITH}, h AS (SELECT *, ({AS_OF} - claimed_at) // {SECOND} AS e, (lease_expires_at - {AS_OF}) // {SECOND} AS l FROM slots)
SELECT pool_key, run_id, slots_consumed, claimed_at, lpad(CAST(e // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((e // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') AS elapsed,
 CASE WHEN l <= 0 THEN 'lease-expired' WHEN l < 30 THEN 'lease-expiring' ELSE '' END AS lease_class,
 CASE WHEN l > 0 THEN 'in ' || {SECS.format("l")} ELSE 'expired ' || {SECS.format("(-l)")} || ' ago' END AS remaining FROM h""",
)
def slot_holders(spark: SparkSession, d: str) -> DataFrame:
    return S.slot_holders(slots(spark, d), F.lit(AS_OF)).orderBy("claimed_at", "run_id")


# Backfills: the runs that one automation launched are a group.
GROUPS = "g AS (SELECT coalesce(launched_by.name, '') || ':' || launched_by.kind AS grp, run_id, status, partition_key FROM runs)"


def groups(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.coalesce("launched_by.name", F.lit("")), F.lit(":"), "launched_by.kind")
    return table(spark, d, "runs").select(name.alias("group"), "run_id", "status", F.col("partition_key.display").alias("partition"))


def members_sql() -> str:
    from tidemark.plans.event_queries import MEMBERS

    return f"""WITH {GROUPS}, m AS (SELECT grp, run_id, status, {MEMBERS} AS member FROM g WHERE partition_key IS NOT NULL),
x AS (SELECT DISTINCT run_id, {MEMBERS} AS member FROM asset_events WHERE event_type = 'StepFailure' AND partition_key IS NOT NULL),
o AS (SELECT grp, m.run_id, m.member, CASE status WHEN 'Success' THEN CASE WHEN x.run_id IS NULL THEN 'completed' ELSE 'failed' END WHEN 'Failure' THEN 'failed' WHEN 'Canceled' THEN 'canceled' ELSE 'pending' END AS outcome
 FROM m LEFT JOIN x ON m.run_id = x.run_id AND m.member = x.member),
a AS (SELECT grp, outcome, 1 AS n FROM o UNION ALL SELECT grp, CASE status WHEN 'Success' THEN 'completed' WHEN 'Failure' THEN 'failed' WHEN 'Canceled' THEN 'canceled' ELSE 'pending' END, 0 FROM g WHERE partition_key IS NULL)"""


@CORE.query(
    "backfill_outcome",
    f"""{members_sql()} SELECT grp AS "group", CAST(coalesce(sum(n) FILTER (outcome = 'completed'), 0) AS BIGINT) AS completed, CAST(coalesce(sum(n) FILTER (outcome = 'failed'), 0) AS BIGINT) AS failed,
 CAST(coalesce(sum(n) FILTER (outcome = 'canceled'), 0) AS BIGINT) AS canceled, CAST(coalesce(sum(n) FILTER (outcome = 'pending'), 0) AS BIGINT) AS pending,
 CASE WHEN bool_or(outcome = 'pending') THEN 'InProgress' WHEN bool_or(outcome = 'failed') THEN 'CompletedFailed' WHEN bool_or(outcome = 'canceled') THEN 'Canceled' ELSE 'CompletedSuccess' END AS status FROM a GROUP BY grp""",
)
def backfill_outcome(spark: SparkSession, d: str) -> DataFrame:
    return B.backfill_outcome(groups(spark, d), table(spark, d, "asset_events"))


@CORE.query(
    "backfill_partitions_page",
    f"""{members_sql()} SELECT member, list_extract(['completed', 'failed', 'canceled', 'pending'], min(list_position(['completed', 'failed', 'canceled', 'pending'], outcome))) AS state
FROM o WHERE grp = 'export_push:schedule' GROUP BY member ORDER BY member LIMIT 20 OFFSET 10""",
)
def backfill_partitions_page(spark: SparkSession, d: str) -> DataFrame:
    members = B.backfill_members(groups(spark, d).filter("group = 'export_push:schedule'"), table(spark, d, "asset_events"))
    return B.partitions_page(members, 10, 20)


@CORE.query(
    "backfills_summary",
    f"""{members_sql()}, s AS (SELECT grp, CASE WHEN bool_or(outcome = 'pending') THEN 'InProgress' WHEN bool_or(outcome = 'failed') THEN 'CompletedFailed' WHEN bool_or(outcome = 'canceled') THEN 'Canceled' ELSE 'CompletedSuccess' END AS st FROM a GROUP BY grp)
SELECT count(*) AS total, count(*) FILTER (st = 'InProgress') AS in_progress, count(*) FILTER (st = 'CompletedSuccess') AS completed_success, count(*) FILTER (st = 'CompletedFailed') AS completed_failed, count(*) FILTER (st = 'Canceled') AS canceled FROM s""",
)
def backfills_summary(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.runs import status_counts

    status = F.col("status")
    return status_counts(backfill_outcome(spark, d), in_progress=status == "InProgress", completed_success=status == "CompletedSuccess", completed_failed=status == "CompletedFailed", canceled=status == "Canceled")


@CORE.query("backfills_page", f"""{members_sql()} SELECT grp AS "group", count(*) AS n FROM a GROUP BY grp ORDER BY n DESC, grp LIMIT 10""")
def backfills_page(spark: SparkSession, d: str) -> DataFrame:
    rows = B.backfill_members(groups(spark, d), table(spark, d, "asset_events")).select("group").unionByName(groups(spark, d).filter("partition IS NULL").select("group"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group").limit(10)


@CORE.query("stalled_backfills", f"""WITH {GROUPS} SELECT grp AS "group" FROM g GROUP BY grp HAVING bool_or(status IN ('Queued', 'NotStarted')) AND NOT bool_or(status = 'Started')""")
def stalled_backfills(spark: SparkSession, d: str) -> DataFrame:
    """Groups with runs that wait and none that goes on."""
    status = F.col("status")
    per = groups(spark, d).groupBy("group").agg(F.bool_or(status.isin("Queued", "NotStarted")).alias("waits"), F.bool_or(status == "Started").alias("runs"))
    return per.filter("waits AND NOT runs").select("group")


@CORE.query(
    "materialization_plan",
    """WITH f AS (SELECT asset_key, list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)) AS keys FROM (SELECT asset_key, CASE WHEN eval_id % 3 = 0 THEN NULL ELSE 'k' || eval_id % 4 END AS p FROM condition_evals WHERE fired) GROUP BY asset_key)
SELECT CASE WHEN coalesce(len(keys), 0) = 0 THEN 'unpartitioned' WHEN len(keys) = 1 THEN 'single_key' ELSE 'backfill' END AS kind,
 CASE WHEN coalesce(len(keys), 0) = 0 THEN '' WHEN len(keys) = 1 THEN keys[1] ELSE asset_key END AS launch, list_sort(list(DISTINCT asset_key)) AS assets, max(coalesce(len(keys), 0)) AS n_keys FROM f GROUP BY 1, 2""",
)
def materialization_plan(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("eval_id") % 3 != 0, F.concat(F.lit("k"), F.col("eval_id") % 4))
    return B.materialization_plan(table(spark, d, "condition_evals").filter("fired").select("asset_key", key.alias("partition")))


@CORE.query(
    "retry_delay",
    """SELECT s_suppkey, round(least(2.0 * power(3.0, greatest(a, 1) - 1), 40) * (0.75 + 0.5 * r), 6) AS exponential, CAST(1.0 + 2.5 * greatest(a, 1) AS DOUBLE) AS linear, CAST(list_extract([1.0, 5.0, 30.0], least(greatest(a, 1), 3)) AS DOUBLE) AS fixed
FROM (SELECT s_suppkey, s_suppkey % 6 AS a, (s_suppkey % 10) / 10.0 AS r FROM supplier)""",
)
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    attempt, random = F.col("s_suppkey") % 6, (F.col("s_suppkey") % 10) / 10.0
    shapes = {
        "exponential": X.Backoff("exponential", 2.0, factor=3.0, longest=40.0, jitter=0.25),
        "linear": X.Backoff("linear", 1.0, step=2.5),
        "fixed": X.Backoff("fixed", schedule=(1.0, 5.0, 30.0)),
    }
    return table(spark, d, "supplier").select("s_suppkey", *(F.round(X.delay(b, attempt, random), 6).alias(n) for n, b in shapes.items()))


REASONS = ("OutOfMemory", "Timeout", "Infrastructure", "UserCode", "Cancelled")


@CORE.query(
    "should_retry",
    """SELECT s_suppkey, reason <> 'Cancelled' AND attempt <= 3 AND reason IN ('OutOfMemory', 'Timeout', 'Infrastructure') AS transient,
 reason <> 'Cancelled' AND attempt <= 2 AND (reason = 'UserCode' OR exc = 'OSError' OR reason = 'OutOfMemory') AS matched
FROM (SELECT s_suppkey, list_extract(['OutOfMemory', 'Timeout', 'Infrastructure', 'UserCode', 'Cancelled'], CAST(s_suppkey % 5 AS INTEGER) + 1) AS reason, s_suppkey % 4 + 1 AS attempt, CASE WHEN s_suppkey % 3 = 0 THEN 'OSError' ELSE 'ValueError' END AS exc FROM supplier)""",
)
def should_retry(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    reason = F.element_at(F.array(*(F.lit(r) for r in REASONS)), (key % 5).cast("int") + 1)
    raised = F.array(F.when(key % 3 == 0, "OSError").otherwise("ValueError"))
    transient = X.RetryPolicy(3, "transient")
    matched = X.RetryPolicy(2, "match", exceptions=("OSError",), reasons=("UserCode",), escalate=("OutOfMemory",))
    return table(spark, d, "supplier").select("s_suppkey", X.should_retry(transient, reason, raised, key % 4 + 1).alias("transient"), X.should_retry(matched, reason, raised, key % 4 + 1).alias("matched"))


@CORE.query("assets_by_tag", "SELECT code_location_id, asset_key FROM assets WHERE list_contains(tags, 'pii') AND list_contains(kinds, 'delta')")
def assets_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assets").filter(F.array_contains("tags", "pii") & F.array_contains("kinds", "delta")).select("code_location_id", "asset_key")


@CORE.query("assets_by_group", "SELECT asset_group, count(*) AS n, count(last_run_id) AS materialized FROM assets WHERE asset_group IN ('core', 'ops') GROUP BY asset_group")
def assets_by_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assets").filter(F.col("asset_group").isin("core", "ops")).groupBy("asset_group").agg(F.count(F.lit(1)).alias("n"), F.count("last_run_id").alias("materialized"))


@CORE.query(
    "avatar_hue",
    """SELECT DISTINCT asset_key, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(asset_key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 360 AS INTEGER) AS hue,
 upper(substr(asset_key, 1, 1)) AS initials FROM assets""",
)
def avatar_hue(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.formats import hue, initials

    return table(spark, d, "assets").select("asset_key", hue(F.col("asset_key")).alias("hue"), initials(F.col("asset_key")).alias("initials")).distinct()


@CORE.query(
    "relative_time",
    f"""SELECT run_id, CASE WHEN s < 0 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago'
 ELSE strftime(make_timestamp(start_time // 1000), '%Y-%m-%d') END AS started FROM (SELECT *, {AS_OF // SECOND} - start_time // {SECOND} AS s FROM runs)""",
)
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.formats import relative_text

    return table(spark, d, "runs").select("run_id", relative_text(F.col("start_time"), F.lit(AS_OF // SECOND)).alias("started"))


@CORE.query("exception_types", """SELECT DISTINCT asset_group, '["' || asset_group || '","OSError"]' AS encoded, 2 AS n FROM assets WHERE asset_group IS NOT NULL""")
def exception_types(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "assets").filter("asset_group IS NOT NULL").select("asset_group").distinct()
    encoded = names.withColumn("encoded", X.encode_types(F.array("asset_group", F.lit("OSError"))))
    return encoded.withColumn("n", F.size(X.decode_types(F.col("encoded"))))
