"""Queries over runs, their queue and their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import runs as R
from tidemark.plans.registry import CORE
from tidemark.sources.tables import table

#: Every query that compares with the present takes it from here (int64 ns), never from the clock.
AS_OF = 1_739_620_000_000_000_000
RUN = ["run_id", "status", "job_name", "start_time"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs")


@CORE.query(
    "runs_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'Started') AS in_progress,
 count(*) FILTER (status IN ('Queued', 'NotStarted')) AS queued, count(*) FILTER (status = 'Failure') AS failure,
 count(*) FILTER (status = 'Success') AS success, count(*) FILTER (start_time > {AS_OF - R.DAY_NS}) AS last_24h FROM runs""",
)
def runs_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.runs_summary(runs(spark, d), AS_OF)


@CORE.query("runs_page", "SELECT run_id, status, job_name, start_time, (SELECT count(*) FROM runs) AS total FROM runs ORDER BY start_time DESC, run_id LIMIT 50 OFFSET 100")
def runs_page(spark: SparkSession, d: str) -> DataFrame:
    return R.runs_page(runs(spark, d), offset=100).select(*RUN, "total")


@CORE.query(
    "runs_page_filtered",
    """WITH f AS (SELECT * FROM runs WHERE status IN ('Queued', 'NotStarted') AND job_name IS NOT NULL AND contains(lower(job_name), 'load')
 AND len(list_filter(node_names, lambda a: contains(lower(a), 'daily'))) > 0)
SELECT run_id, status, job_name, start_time, (SELECT count(*) FROM f) AS total FROM f ORDER BY start_time DESC, run_id LIMIT 20""",
)
def runs_page_filtered(spark: SparkSession, d: str) -> DataFrame:
    wanted = R.RunFilter(status="Queued", job_part="LOAD", asset_part="Daily")
    return R.runs_page(runs(spark, d), wanted, limit=20).select(*RUN, "total")


@CORE.query("array_exists_substring", "SELECT run_id FROM runs WHERE len(list_filter(node_names, lambda a: contains(lower(a), 'ledgers'))) > 0")
def array_exists_substring(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter(R.any_contains(F.col("node_names"), "Ledgers")).select("run_id")


@CORE.query("tag_pair_exists", "SELECT run_id FROM runs WHERE len(list_filter(tags, lambda t: t.k IN ('env', 'region') AND contains(lower(t.v), 'pr'))) > 0")
def tag_pair_exists(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter(R.tag_contains(F.col("tags"), ("env", "region"), "PR")).select("run_id")


@CORE.query(
    "run_tags_match",
    """SELECT run_id FROM runs WHERE len(list_filter(tags, lambda t: t.k = 'team')) > 0
 AND len(list_filter(tags, lambda t: t.k = 'env' AND t.v = 'prod')) > 0""",
)
def run_tags_match(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter(R.tags_match(F.col("tags"), ["team"], {"env": "prod"})).select("run_id")


@CORE.query("priority_from_tags", "SELECT run_id, coalesce(TRY_CAST(list_filter(tags, lambda t: t.k = 'priority')[1].v AS INTEGER), 0) AS tag_priority FROM runs")
def priority_from_tags(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("run_id", R.priority_of(F.col("tags")).alias("tag_priority"))


@CORE.query("run_stats_histogram", "SELECT status, count(*) AS n FROM (SELECT status FROM runs ORDER BY start_time DESC, run_id LIMIT 10000) GROUP BY status")
def run_stats_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The histogram is defined over the newest 10,000 runs; the limit is the feature."""
    return R.newest(runs(spark, d), 10_000, F.desc("start_time"), "run_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "last_run_per_job",
    """SELECT job_name, run_id, status, start_time FROM runs WHERE job_name IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY start_time DESC, run_id DESC) = 1""",
)
def last_run_per_job(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_per(runs(spark, d).filter("job_name IS NOT NULL"), ["job_name"], ["start_time", "run_id"], ["run_id", "status", "start_time"])


@CORE.query("runs_since", "SELECT run_id, status, start_time FROM runs WHERE start_time > 1739000000000000000")
def runs_since(spark: SparkSession, d: str) -> DataFrame:
    """Runs after a cursor, oldest first."""
    return runs(spark, d).filter(F.col("start_time") > 1_739_000_000_000_000_000).orderBy("start_time", "run_id").select("run_id", "status", "start_time")


@CORE.query(
    "prune_keep_latest_n",
    """SELECT eval_id, asset_key, timestamp FROM (SELECT DISTINCT eval_id, code_location_id, asset_key, timestamp FROM condition_evals)
 QUALIFY row_number() OVER (PARTITION BY code_location_id, asset_key ORDER BY timestamp DESC, eval_id DESC) <= 5""",
)
def prune_keep_latest_n(spark: SparkSession, d: str) -> DataFrame:
    evals = table(spark, d, "condition_evals").select("eval_id", "code_location_id", "asset_key", "timestamp").distinct()
    return R.keep_latest(evals, ["code_location_id", "asset_key"], 5, F.desc("timestamp"), F.desc("eval_id")).drop("code_location_id")


@CORE.query("lookup_by_keys", "SELECT run_id, status FROM runs WHERE run_id IN (SELECT run_id FROM pruned_runs)")
def lookup_by_keys(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups by a set of keys: a semi-join, whichever side is small."""
    return runs(spark, d).join(table(spark, d, "pruned_runs").select("run_id"), "run_id", "left_semi").select("run_id", "status")


@CORE.query(
    "stalled_runs",
    """WITH q AS (SELECT run_id, max(timestamp) AS t FROM asset_events WHERE event_type = 'RunDequeued' GROUP BY run_id)
SELECT run_id, coalesce(t, start_time) AS waiting_since FROM runs LEFT JOIN q USING (run_id)
WHERE status = 'NotStarted' AND coalesce(t, start_time) < 1739000000000000000""",
)
def stalled_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.stalled_runs(runs(spark, d), table(spark, d, "asset_events"), 1_739_000_000_000_000_000)


@CORE.query("in_progress_runs", "SELECT code_location_id, count(*) AS n_runs FROM runs WHERE status = 'Started' GROUP BY code_location_id")
def in_progress_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter("status = 'Started'").groupBy("code_location_id").agg(F.count(F.lit(1)).alias("n_runs"))


@CORE.query("runs_for_asset", "SELECT run_id, start_time FROM runs WHERE list_contains(node_names, 'raw_page_hits') ORDER BY start_time DESC, run_id LIMIT 100")
def runs_for_asset(spark: SparkSession, d: str) -> DataFrame:
    """Filter first, then the newest: older runs of the asset aren't missed."""
    return R.newest(runs(spark, d).filter(F.array_contains("node_names", "raw_page_hits")), 100, F.desc("start_time"), "run_id").select("run_id", "start_time")


@CORE.query(
    "tag_counts",
    """SELECT t.k AS tag_key, NULL AS tag_value, 'key' AS level, count(*) AS n FROM (SELECT unnest(tags) AS t FROM runs WHERE status = 'Started') GROUP BY t.k
UNION ALL SELECT t.k, t.v, 'key_value', count(*) FROM (SELECT unnest(tags) AS t FROM runs WHERE status = 'Started') GROUP BY t.k, t.v""",
)
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.tag_counts(runs(spark, d).filter("status = 'Started'"))


@CORE.query(
    "dequeue_global",
    """WITH b AS (SELECT code_location_id, count(*) AS n FROM runs WHERE status IN ('Started', 'NotStarted') GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY code_location_id ORDER BY priority DESC, start_time, run_id) AS place FROM runs WHERE status = 'Queued')
SELECT run_id, priority, start_time FROM q LEFT JOIN b USING (code_location_id) WHERE place + coalesce(n, 0) <= 30""",
)
def dequeue_global(spark: SparkSession, d: str) -> DataFrame:
    return R.dequeue_global(runs(spark, d), 30).select("run_id", "priority", "start_time")


def fold_sql(counters: str, limit: str, most: int, final: str) -> str:
    """The queue of each code location folded in order; ``counters`` are the counters that a run's tags touch, ``limit`` that of counter c."""
    free = f"f.n < {most} AND len(list_filter(q.cs, lambda c: len(list_filter(f.used, lambda u: u = c)) >= {limit})) = 0"
    return f"""WITH RECURSIVE live AS (SELECT *, {counters} AS cs FROM runs WHERE status IN ('Queued', 'Started', 'NotStarted')),
b AS (SELECT code_location_id, count(*) AS n, flatten(list(cs)) AS used FROM live WHERE status <> 'Queued' GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY code_location_id ORDER BY priority DESC, start_time, run_id) AS place FROM live WHERE status = 'Queued'),
f AS (SELECT code_location_id, CAST(0 AS BIGINT) AS place, '' AS run_id, 0 AS priority, CAST(0 AS BIGINT) AS start_time, false AS ok, coalesce(n, 0) AS n, coalesce(used, CAST([] AS VARCHAR[])) AS used
 FROM (SELECT DISTINCT code_location_id FROM q) LEFT JOIN b USING (code_location_id)
 UNION ALL SELECT q.code_location_id, q.place, q.run_id, q.priority, q.start_time, {free}, f.n + CASE WHEN {free} THEN 1 ELSE 0 END, CASE WHEN {free} THEN list_concat(f.used, q.cs) ELSE f.used END
 FROM f JOIN q ON q.code_location_id = f.code_location_id AND q.place = f.place + 1)
{final}"""


@CORE.query(
    "dequeue_tag_limit",
    fold_sql("list_transform(list_filter(tags, lambda t: t.k = 'region'), lambda t: t.v)", "8", 50, "SELECT run_id, priority, start_time FROM f WHERE ok"),
)
def dequeue_tag_limit(spark: SparkSession, d: str) -> DataFrame:
    return R.dequeue_tag_limit(runs(spark, d), "region", 8, 50).select("run_id", "priority", "start_time")


@CORE.query(
    "dequeue_many_limits",
    fold_sql(
        """list_transform(list_filter(tags, lambda t: t.k IN ('region', 'team') OR (t.k = 'env' AND t.v = 'prod')), lambda t: CASE WHEN t.k = 'region' THEN 'region=' || t.v ELSE t.k END)""",
        "CASE c WHEN 'env' THEN 10 WHEN 'team' THEN 15 ELSE 8 END",
        45,
        "SELECT code_location_id, run_id, CAST(row_number() OVER (PARTITION BY code_location_id ORDER BY place) AS INTEGER) AS position FROM f WHERE ok",
    ),
)
def dequeue_many_limits(spark: SparkSession, d: str) -> DataFrame:
    """Several limits at once fold each queue in order."""
    limits = [R.TagLimit("region", 8, per_value=True), R.TagLimit("env", 10, value="prod"), R.TagLimit("team", 15)]
    return R.dequeue(runs(spark, d), limits, 45).select("code_location_id", "run_id", "position")


@CORE.query(
    "queue_lanes",
    """SELECT CASE WHEN status = 'NotStarted' THEN 'launching' WHEN contains(coalesce(block_reason, ''), 'pool') OR contains(coalesce(block_reason, ''), 'gpu') THEN 'pool'
 WHEN contains(coalesce(block_reason, ''), 'limit') OR contains(coalesce(block_reason, ''), 'concurrency') THEN 'concurrency'
 WHEN contains(coalesce(block_reason, ''), 'backfill') THEN 'backfill' WHEN coalesce(block_reason, '') = '' THEN 'waiting' ELSE 'other' END AS lane,
 CASE WHEN priority > 0 THEN 'high' WHEN priority < 0 THEN 'low' ELSE 'normal' END AS priority_label, count(*) AS n
FROM runs WHERE status IN ('Queued', 'NotStarted') GROUP BY 1, 2""",
)
def queue_lanes(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("priority") > 0, "high").when(F.col("priority") < 0, "low").otherwise("normal")
    queued = runs(spark, d).filter(F.col("status").isin(*R.QUEUE_STATES))
    return queued.groupBy(R.queue_lane(F.col("status"), F.col("block_reason")).alias("lane"), label.alias("priority_label")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "pending_position",
    """SELECT run_id, code_location_id, row_number() OVER (PARTITION BY code_location_id ORDER BY priority DESC, start_time, run_id) AS place,
 count(*) OVER (PARTITION BY code_location_id) AS waiting FROM runs WHERE status = 'Queued'""",
)
def pending_position(spark: SparkSession, d: str) -> DataFrame:
    queued = runs(spark, d).filter("status = 'Queued'").select("run_id", "code_location_id", "priority", "start_time")
    return R.places(queued, ["code_location_id"], R.queue_order()).select("run_id", "code_location_id", "place", "waiting")


@CORE.query(
    "block_reason_update",
    "SELECT run_id, CASE WHEN status = 'Queued' THEN 'global run limit (20/20)' ELSE block_reason END AS block_reason FROM runs",
)
def block_reason_update(spark: SparkSession, d: str) -> DataFrame:
    """Conditional bulk update as a projection."""
    reason = F.when(F.col("status") == "Queued", "global run limit (20/20)").otherwise(F.col("block_reason"))
    return runs(spark, d).select("run_id", reason.alias("block_reason"))


@CORE.query("run_logs_ordered", "SELECT DISTINCT log_id, run_id, step_key, timestamp FROM run_logs ORDER BY run_id, timestamp, log_id")
def run_logs_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Each run's logs in the order of (timestamp, id): a range sort, which cuts the logs of a hot run over several tasks."""
    return table(spark, d, "run_logs").select("log_id", "run_id", "step_key", "timestamp").distinct().orderBy("run_id", "timestamp", "log_id")


LEVEL_WORDS = {"info": ("INFO",), "debug": ("DEBUG", "TRACE"), "warn": ("WARN", "WARNING"), "error": ("ERROR", "CRITICAL", "FATAL", "ERR")}


def line_has_level(line: str, level: str) -> F.Column:
    """True if the line holds one of the level's words, in any case, not as part of a longer word of letters."""
    words = "|".join(LEVEL_WORDS[level])
    return F.col(line).rlike(rf"(?i)(?<![A-Za-z])(?:{words})(?![A-Za-z])")


@CORE.query(
    "log_level_filter",
    """WITH l AS (SELECT DISTINCT log_id, stdout FROM run_logs), n AS (SELECT log_id, unnest(string_split(stdout, chr(10))) AS line FROM l),
c AS (SELECT log_id, count(*) FILTER (regexp_matches(line, '(^|[^A-Za-z])(ERROR|CRITICAL|FATAL|ERR)($|[^A-Za-z])', 'i')) AS error_lines,
 count(*) FILTER (regexp_matches(line, '(^|[^A-Za-z])(WARN|WARNING)($|[^A-Za-z])', 'i')) AS warn_lines FROM n GROUP BY log_id)
SELECT * FROM c WHERE error_lines + warn_lines > 0""",
)
def log_level_filter(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "run_logs").select("log_id", "stdout").distinct()
    lines = logs.select("log_id", F.explode(F.split("stdout", "\n")).alias("line"))
    counts = lines.groupBy("log_id").agg(F.count_if(line_has_level("line", "error")).alias("error_lines"), F.count_if(line_has_level("line", "warn")).alias("warn_lines"))
    return counts.filter("error_lines + warn_lines > 0")


@CORE.query(
    "format_duration",
    """SELECT run_id, CASE WHEN end_time IS NULL THEN 'Running...' ELSE CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's'
 ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END END AS took FROM (SELECT run_id, end_time, (end_time - start_time) // 1000000000 AS s FROM runs)""",
)
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.formats import duration_text

    return runs(spark, d).select("run_id", duration_text(F.col("start_time"), F.col("end_time")).alias("took"))


@CORE.query("nanos_to_timestamp", "SELECT run_id, make_timestamp(start_time // 1000) AS started_at FROM runs")
def nanos_to_timestamp(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.formats import nanos_to_ntz

    return runs(spark, d).select("run_id", nanos_to_ntz(F.col("start_time")).alias("started_at"))


@CORE.query("short_id", "SELECT DISTINCT substr(run_id, 1, 8) AS short, upper(substr(job_name, 1, 1)) AS initial FROM runs")
def short_id(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select(F.substring("run_id", 1, 8).alias("short"), F.upper(F.substring("job_name", 1, 1)).alias("initial")).distinct()


@CORE.query(
    "global_search",
    """SELECT 'run' AS category, run_id AS label FROM runs WHERE contains(lower(run_id), 'ab1') OR contains('run', 'ab1')
UNION ALL SELECT DISTINCT 'asset', asset_key FROM assets WHERE contains(lower(asset_key), 'ab1') OR contains('asset', 'ab1')
UNION ALL SELECT DISTINCT 'job', job_name FROM runs WHERE contains(lower(job_name), 'ab1')""",
)
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Substring search, in any case, over the labels of all kinds of things."""
    labels = (
        runs(spark, d).select(F.lit("run").alias("category"), F.col("run_id").alias("label"))
        .unionByName(table(spark, d, "assets").select(F.lit("asset").alias("category"), F.col("asset_key").alias("label")).distinct())
        .unionByName(runs(spark, d).select(F.lit("job").alias("category"), F.col("job_name").alias("label")).distinct())
    )
    return labels.filter(F.contains(F.lower("label"), F.lit("ab1")) | F.contains(F.col("category"), F.lit("ab1")))
