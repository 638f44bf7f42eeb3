"""Queries over the event log: state, failures, progress, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import partition_keys as K
from tidemark.operators import events as E
from tidemark.operators import runs as R
from tidemark.plans.registry import CORE
from tidemark.sources.tables import table


DAY_NS = 86_400_000_000_000


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_events")


#: The members of a batch key in SQL, for keys of one or two dimensions.
MEMBERS = """unnest(CASE WHEN partition_key.kind = 'single' THEN string_split(partition_key.display, ',') ELSE
 flatten(list_transform(string_split(split_part(split_part(partition_key.display, '|', 1), '=', 2), ','), lambda a:
  list_transform(string_split(split_part(split_part(partition_key.display, '|', 2), '=', 2), ','), lambda b:
   split_part(partition_key.display, '=', 1) || '=' || a || '|' || split_part(split_part(partition_key.display, '|', 2), '=', 1) || '=' || b))) END)"""
MATS = "SELECT * FROM asset_events WHERE event_type = 'Materialization' AND asset_key IS NOT NULL"


@CORE.query(
    "latest_materialization",
    f"""SELECT code_location_id, asset_key, event_id, run_id, timestamp, data_version FROM (SELECT DISTINCT code_location_id, asset_key, event_id, run_id, timestamp, data_version FROM ({MATS}))
 QUALIFY row_number() OVER (PARTITION BY code_location_id, asset_key ORDER BY timestamp DESC, event_id DESC) = 1""",
)
def latest_materialization(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_materialization(log(spark, d))


@CORE.query(
    "asset_state_from_events",
    f"""SELECT code_location_id, asset_key, event_id AS last_event_id, run_id AS last_run_id, timestamp AS last_timestamp, data_version AS last_data_version
 FROM (SELECT DISTINCT code_location_id, asset_key, event_id, run_id, timestamp, data_version FROM ({MATS}))
 QUALIFY row_number() OVER (PARTITION BY code_location_id, asset_key ORDER BY event_id DESC) = 1""",
)
def asset_state_from_events(spark: SparkSession, d: str) -> DataFrame:
    return E.asset_state(log(spark, d))


@CORE.query(
    "asset_partition_state",
    f"""SELECT code_location_id, asset_key, p AS partition, event_id, run_id, timestamp
 FROM (SELECT DISTINCT code_location_id, asset_key, {MEMBERS} AS p, event_id, run_id, timestamp FROM ({MATS}) WHERE partition_key IS NOT NULL)
 QUALIFY row_number() OVER (PARTITION BY code_location_id, asset_key, p ORDER BY event_id DESC) = 1""",
)
def asset_partition_state(spark: SparkSession, d: str) -> DataFrame:
    return E.partition_state(log(spark, d))


FAILED = f"""f AS (
 SELECT code_location_id, asset_key, p, max(mat) AS materialized_at, max(fail) AS failed_at FROM (
  SELECT code_location_id, asset_key, {MEMBERS} AS p, CASE WHEN event_type = 'Materialization' THEN timestamp END AS mat,
         CASE WHEN event_type = 'StepFailure' THEN timestamp END AS fail
  FROM asset_events WHERE event_type IN ('Materialization', 'StepFailure') AND asset_key IS NOT NULL AND partition_key IS NOT NULL
  UNION ALL SELECT code_location_id, node, {MEMBERS}, NULL, start_time FROM (SELECT *, unnest(node_names) AS node FROM runs) WHERE status = 'Failure' AND partition_key IS NOT NULL)
 GROUP BY ALL HAVING max(fail) IS NOT NULL AND (max(mat) IS NULL OR max(mat) < max(fail)))"""


@CORE.query("failed_partitions", f"WITH {FAILED} SELECT code_location_id, asset_key, p AS partition, materialized_at, failed_at FROM f")
def failed_partitions(spark: SparkSession, d: str) -> DataFrame:
    return E.failed_partitions(log(spark, d), table(spark, d, "runs"))


def universe(spark: SparkSession, d: str) -> DataFrame:
    """Each asset with every day of its daily partitions.

    The grid has no end of its own, so it ends with the last window that has begun: that of the
    latest event or run. A key of a later day isn't a partition yet.
    """
    latest = log(spark, d).select("timestamp").unionByName(table(spark, d, "runs").select(F.col("start_time").alias("timestamp"))).agg(F.max("timestamp").alias("now"))
    first, last = F.to_date(F.lit("2024-11-18")), F.date_from_unix_date(F.floor(F.col("now") / F.lit(DAY_NS)).cast("int"))
    days = F.when(first <= last, F.sequence(first, last))
    assets = table(spark, d, "assets").select(*E.ASSET).crossJoin(F.broadcast(latest))
    return assets.select(*E.ASSET, F.explode(F.transform(days, lambda x: F.date_format(x, "yyyy-MM-dd"))).alias("partition"))


UNIVERSE = f"""u AS (SELECT code_location_id, asset_key, strftime(t.x, '%Y-%m-%d') AS p FROM assets,
 (SELECT unnest(generate_series(DATE '2024-11-18', CAST(make_timestamp(max(latest) // 1000) AS DATE), INTERVAL 1 DAY)) AS x FROM (SELECT max(timestamp) AS latest FROM asset_events UNION ALL SELECT max(start_time) FROM runs)) t),
m AS (SELECT DISTINCT code_location_id, asset_key, {MEMBERS} AS p FROM asset_events WHERE event_type = 'Materialization')"""


@CORE.query("missing_partitions", f"WITH {UNIVERSE} SELECT code_location_id, asset_key, p AS partition FROM u ANTI JOIN m USING (code_location_id, asset_key, p)")
def missing_partitions(spark: SparkSession, d: str) -> DataFrame:
    return E.missing_partitions(universe(spark, d), log(spark, d))


@CORE.query(
    "partition_heatmap",
    f"""WITH {UNIVERSE}, {FAILED},
s AS (SELECT u.code_location_id, u.asset_key, CASE WHEN f.p IS NOT NULL THEN 'Failed' WHEN m.p IS NOT NULL THEN 'Materialized' ELSE 'Missing' END AS st
 FROM u LEFT JOIN m USING (code_location_id, asset_key, p) LEFT JOIN f USING (code_location_id, asset_key, p))
SELECT code_location_id, asset_key, count(*) AS total, count(*) FILTER (st = 'Materialized') AS materialized, count(*) FILTER (st = 'Failed') AS failed,
 count(*) FILTER (st = 'Missing') AS missing FROM s GROUP BY code_location_id, asset_key""",
)
def partition_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return E.partition_heatmap(universe(spark, d), log(spark, d), table(spark, d, "runs"))


@CORE.query(
    "in_progress_partitions",
    f"""SELECT DISTINCT code_location_id, asset_key, {MEMBERS} AS partition FROM asset_events
 WHERE event_type = 'StepStart' AND asset_key IS NOT NULL AND partition_key IS NOT NULL AND run_id IN (SELECT run_id FROM runs WHERE status = 'Started')""",
)
def in_progress_partitions(spark: SparkSession, d: str) -> DataFrame:
    return E.in_progress_partitions(log(spark, d), table(spark, d, "runs"))


OVER = "(event_type = 'StepSuccess' OR (event_type = 'StepFailure' AND partition_key IS NULL))"


@CORE.query(
    "run_progress",
    f"""WITH s AS (SELECT run_id, asset_key, bool_or(event_type = 'StepStart') AS started, bool_or({OVER}) AS ended, max(timestamp) FILTER ({OVER}) AS t
 FROM asset_events WHERE asset_key IS NOT NULL AND event_type IN ('StepStart', 'StepSuccess', 'StepFailure') GROUP BY run_id, asset_key)
SELECT run_id, count(*) FILTER (started) AS total_steps, count(*) FILTER (ended) AS completed_steps, max(t) AS last_step_completed_at,
 arg_max(asset_key, (t, asset_key)) FILTER (ended) AS last_completed_step FROM s GROUP BY run_id""",
)
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    return E.run_progress(log(spark, d))


@CORE.query(
    "gantt_spans",
    """WITH g AS (SELECT run_id, asset_key, min(timestamp) FILTER (event_type = 'StepStart') AS s, max(timestamp) FILTER (event_type <> 'StepStart') AS e,
 arg_max(event_type, (timestamp, event_id)) FILTER (event_type IN ('StepSuccess', 'StepFailure')) AS l FROM asset_events WHERE asset_key IS NOT NULL GROUP BY run_id, asset_key)
SELECT run_id, asset_key, coalesce(s, e, 0) AS start, CASE WHEN l IS NOT NULL THEN coalesce(e, s) END AS "end",
 CASE l WHEN 'StepSuccess' THEN 'Success' WHEN 'StepFailure' THEN 'Failure' ELSE 'Running' END AS status FROM g""",
)
def gantt_spans(spark: SparkSession, d: str) -> DataFrame:
    return E.gantt_spans(log(spark, d))


@CORE.query(
    "asset_chip_status",
    """SELECT run_id, asset_key, CASE WHEN bool_or(event_type = 'StepFailure' AND partition_key IS NULL) THEN 'failed' WHEN bool_or(event_type = 'StepSuccess') THEN 'success'
 WHEN bool_or(event_type = 'StepStart') THEN 'running' ELSE 'pending' END AS chip FROM asset_events WHERE asset_key IS NOT NULL GROUP BY run_id, asset_key""",
)
def asset_chip_status(spark: SparkSession, d: str) -> DataFrame:
    return E.asset_chip_status(log(spark, d))


PAGE = "SELECT DISTINCT event_id, event_type, run_id, asset_key, timestamp, sort_order FROM asset_events"


@CORE.query("asset_events_page", f"{PAGE} WHERE asset_key = 'raw_page_hits' ORDER BY timestamp DESC, sort_order DESC, event_id DESC LIMIT 50 OFFSET 50")
def asset_events_page(spark: SparkSession, d: str) -> DataFrame:
    return E.events_page(log(spark, d).filter("asset_key = 'raw_page_hits'"), 50, 50, newest_first=True)


BUSIEST = "(SELECT run_id FROM asset_events WHERE run_id <> '' GROUP BY run_id ORDER BY count(*) DESC, run_id LIMIT 1)"


def busiest_run(spark: SparkSession, d: str) -> DataFrame:
    """The events of the run with the most rows: a top-1 semi-joined back."""
    counts = log(spark, d).filter("run_id <> ''").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return log(spark, d).join(F.broadcast(counts.orderBy(F.desc("n"), "run_id").limit(1)), "run_id", "left_semi")


@CORE.query("run_events_page", f"{PAGE} WHERE run_id = {BUSIEST} ORDER BY timestamp, sort_order, event_id LIMIT 100")
def run_events_page(spark: SparkSession, d: str) -> DataFrame:
    return E.events_page(busiest_run(spark, d), 0, 100, newest_first=False)


@CORE.query("run_asset_events_page", f"{PAGE} WHERE run_id = {BUSIEST} AND asset_key = 'stg_page_hits' ORDER BY timestamp, sort_order, event_id LIMIT 40 OFFSET 10")
def run_asset_events_page(spark: SparkSession, d: str) -> DataFrame:
    return E.events_page(busiest_run(spark, d).filter("asset_key = 'stg_page_hits'"), 10, 40, newest_first=False)


@CORE.query("run_step_events", f"SELECT DISTINCT event_id, event_type, asset_key, timestamp FROM asset_events WHERE run_id = {BUSIEST} AND event_type IN ('StepStart', 'StepSuccess', 'StepFailure')")
def run_step_events(spark: SparkSession, d: str) -> DataFrame:
    return E.once(busiest_run(spark, d).filter(F.col("event_type").isin(*E.STEP_EVENTS)), "event_type", "asset_key", "timestamp").orderBy("timestamp", "event_id")


@CORE.query("step_events", f"SELECT DISTINCT event_id, event_type, timestamp FROM asset_events WHERE run_id = {BUSIEST} AND asset_key = 'fct_sessions' AND event_type IN ('StepSuccess', 'StepFailure')")
def step_events(spark: SparkSession, d: str) -> DataFrame:
    """The terminal events of one step."""
    step = busiest_run(spark, d).filter((F.col("asset_key") == "fct_sessions") & F.col("event_type").isin("StepSuccess", "StepFailure"))
    return E.once(step, "event_type", "timestamp").orderBy("timestamp", "event_id")


@CORE.query("completed_steps", "SELECT DISTINCT run_id, asset_key FROM asset_events WHERE event_type = 'StepSuccess' AND asset_key IS NOT NULL")
def completed_steps(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter("event_type = 'StepSuccess' AND asset_key IS NOT NULL").select("run_id", "asset_key").distinct()


@CORE.query(
    "step_completion",
    """SELECT asset_key, bool_or(event_type IN ('StepSuccess', 'StepFailure')) AS completed, count(DISTINCT run_id) FILTER (event_type = 'StepSuccess') AS succeeded_runs
 FROM asset_events WHERE asset_key IS NOT NULL GROUP BY asset_key""",
)
def step_completion(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    done = log(spark, d).filter("asset_key IS NOT NULL").groupBy("asset_key")
    return done.agg(F.bool_or(kind.isin("StepSuccess", "StepFailure")).alias("completed"), F.count_distinct(F.when(kind == "StepSuccess", F.col("run_id"))).alias("succeeded_runs"))


@CORE.query(
    "step_data_versions",
    f"""SELECT run_id, asset_key, data_version FROM (SELECT DISTINCT run_id, asset_key, data_version, event_id FROM ({MATS}))
 QUALIFY row_number() OVER (PARTITION BY run_id, asset_key ORDER BY event_id DESC) = 1""",
)
def step_data_versions(spark: SparkSession, d: str) -> DataFrame:
    made = log(spark, d).filter("event_type = 'Materialization' AND asset_key IS NOT NULL")
    return R.latest_per(made, ["run_id", "asset_key"], ["event_id"], ["data_version"])


@CORE.query("latest_observation", "SELECT code_location_id, max(timestamp) AS latest FROM asset_events WHERE event_type = 'Observation' GROUP BY code_location_id")
def latest_observation(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).filter("event_type = 'Observation'").groupBy("code_location_id").agg(F.max("timestamp").alias("latest"))


@CORE.query(
    "observations_since",
    """SELECT DISTINCT event_id, asset_key, timestamp FROM asset_events WHERE event_type = 'Observation' AND timestamp > 1739000000000000000
 AND (code_location_id = 'harbor-juniper-00000' OR code_location_id IS NULL)""",
)
def observations_since(spark: SparkSession, d: str) -> DataFrame:
    place = (F.col("code_location_id") == "harbor-juniper-00000") | F.col("code_location_id").isNull()
    seen = log(spark, d).filter((F.col("event_type") == "Observation") & (F.col("timestamp") > 1_739_000_000_000_000_000) & place)
    return E.once(seen, "asset_key", "timestamp")


@CORE.query(
    "count_materialized",
    f"""SELECT code_location_id, asset_key, count(DISTINCT p) AS partitions FROM (SELECT code_location_id, asset_key, {MEMBERS} AS p FROM asset_events
 WHERE event_type = 'Materialization' AND partition_key IS NOT NULL) GROUP BY code_location_id, asset_key""",
)
def count_materialized(spark: SparkSession, d: str) -> DataFrame:
    made = E.with_members(log(spark, d).filter("event_type = 'Materialization'"))
    return made.groupBy(*E.ASSET).agg(F.count_distinct("partition").alias("partitions"))


@CORE.query(
    "partition_timestamps_since",
    f"""SELECT code_location_id, asset_key, partition, max(timestamp) AS latest FROM (SELECT *, {MEMBERS} AS partition FROM asset_events
 WHERE event_type = 'Materialization' AND partition_key IS NOT NULL AND timestamp > 1739000000000000000) GROUP BY ALL""",
)
def partition_timestamps_since(spark: SparkSession, d: str) -> DataFrame:
    made = log(spark, d).filter((F.col("event_type") == "Materialization") & (F.col("timestamp") > 1_739_000_000_000_000_000))
    return E.with_members(made).groupBy(*E.ASSET, "partition").agg(F.max("timestamp").alias("latest"))


@CORE.query("metadata_lookup", "SELECT DISTINCT event_id, list_filter(metadata, lambda m: m.k = 'attempt')[1].v AS attempt, list_filter(metadata, lambda m: m.k = 'pool')[1].v AS pool FROM asset_events WHERE event_type LIKE 'Step%'")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pivot of pair lists into columns, the first pair of a key winning."""
    steps = log(spark, d).filter(F.col("event_type").startswith("Step"))
    return steps.select("event_id", E.pair_value(F.col("metadata"), "attempt").alias("attempt"), E.pair_value(F.col("metadata"), "pool").alias("pool")).distinct()


@CORE.query(
    "tumbling_daily_events",
    """SELECT event_type, CAST(date_trunc('day', make_timestamp(timestamp // 1000)) AS TIMESTAMP) AS day_start, count(DISTINCT event_id) AS n FROM asset_events GROUP BY 1, 2""",
)
def tumbling_daily_events(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.formats import nanos_to_ntz

    distinct = E.once(log(spark, d), "event_type", "timestamp").withColumn("at", nanos_to_ntz(F.col("timestamp")))
    return distinct.groupBy("event_type", F.window("at", "1 day")["start"].alias("day_start")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "partition_display",
    """WITH k AS (SELECT DISTINCT partition_key.display AS display FROM asset_events WHERE partition_key.kind = 'multi')
SELECT display, string_split(string_split(display, '|')[1], '=')[2] AS day, string_split(string_split(display, '|')[2], '=')[2] AS region, display AS again FROM k""",
)
def partition_display(spark: SparkSession, d: str) -> DataFrame:
    """Display form to dimensions and back."""
    keys = log(spark, d).filter("partition_key.kind = 'multi'").select(F.col("partition_key.display").alias("display")).distinct()
    shown = F.col("display")
    return keys.select("display", K.dimension_value(shown, "date").alias("day"), K.dimension_value(shown, "region").alias("region"), K.to_display(K.dimensions(shown)).alias("again"))


@CORE.query(
    "partition_key_json",
    """SELECT DISTINCT partition_key.display AS display, CASE WHEN partition_key.kind = 'multi' THEN '{"multi":{"date":["' || string_split(string_split(partition_key.display, '|')[1], '=')[2]
 || '"],"region":["' || string_split(string_split(partition_key.display, '|')[2], '=')[2] || '"]}}' ELSE '{"single":["' || replace(partition_key.display, ',', '","') || '"]}' END AS json FROM runs WHERE partition_key IS NOT NULL""",
)
def partition_key_json(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "runs").filter("partition_key IS NOT NULL").select(F.col("partition_key.display").alias("display")).distinct()
    return keys.select("display", K.key_json(F.col("display")).alias("json"))




@CORE.query(
    "partition_members",
    """SELECT k, unnest(['date=a|region=' || lower(r_name), 'date=b|region=' || lower(r_name), 'date=a|region=x', 'date=b|region=x']) AS member
 FROM (SELECT r_name, 'region=' || lower(r_name) || ',x|date=a,b' AS k FROM region)""",
)
def partition_members(spark: SparkSession, d: str) -> DataFrame:
    """A batch key expands to the product of its dimensions, whatever their order."""
    keys = table(spark, d, "region").select(F.concat(F.lit("region="), F.lower("r_name"), F.lit(",x|date=a,b")).alias("k"))
    return keys.select("k", F.explode(K.display_members(F.col("k"))).alias("member"))


@CORE.query("partition_member_count", "SELECT 'region=' || lower(r_name) || ',x|date=a,b,c' AS k, 6 AS n FROM region UNION ALL SELECT r_name || ',x', 2 FROM region")
def partition_member_count(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region")
    keys = region.select(F.concat(F.lit("region="), F.lower("r_name"), F.lit(",x|date=a,b,c")).alias("k")).unionByName(region.select(F.concat("r_name", F.lit(",x")).alias("k")))
    return keys.select("k", K.member_count(F.col("k")).cast("int").alias("n"))


@CORE.query(
    "partition_path",
    """SELECT DISTINCT partition_key.display AS display, CASE WHEN partition_key.kind = 'multi' THEN replace(partition_key.display, '|', '/') ELSE 'key=' || partition_key.display END AS path
 FROM runs WHERE partition_key IS NOT NULL""",
)
def partition_path(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "runs").filter("partition_key IS NOT NULL").select(F.col("partition_key.display").alias("display")).distinct()
    return keys.select("display", K.path_suffix(F.col("display")).alias("path"))


@CORE.query("migration_floor", "WITH m(version, reader, writer) AS (VALUES (1, 1, 1), (2, 1, 2), (3, 2, 3)) SELECT max(version) AS version, arg_max(reader, version) AS reader, arg_max(writer, version) AS writer FROM m")
def migration_floor(spark: SparkSession, d: str) -> DataFrame:
    """The floors of the latest migration decide."""
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 3)], "version int, reader int, writer int")
    return rows.agg(F.max("version").alias("version"), F.max_by("reader", "version").alias("reader"), F.max_by("writer", "version").alias("writer"))


@CORE.query(
    "condition_tick_summary",
    """SELECT code_location_id, tick_id, count(*) AS total_evaluated, count(*) FILTER (fired) AS total_fired, CAST(sum(eval_duration_us) AS BIGINT) AS eval_duration_us
 FROM (SELECT DISTINCT eval_id, code_location_id, tick_id, fired, eval_duration_us FROM condition_evals) GROUP BY code_location_id, tick_id""",
)
def condition_tick_summary(spark: SparkSession, d: str) -> DataFrame:
    evals = table(spark, d, "condition_evals").select("eval_id", "code_location_id", "tick_id", "fired", "eval_duration_us").distinct()
    return evals.groupBy("code_location_id", "tick_id").agg(F.count(F.lit(1)).alias("total_evaluated"), F.count_if("fired").alias("total_fired"), F.sum("eval_duration_us").alias("eval_duration_us"))


@CORE.query(
    "condition_evals_for_tick",
    """WITH t AS (SELECT max(tick_id) AS tick FROM condition_evals) SELECT DISTINCT asset_key, code_location_id, fired, eval_id FROM condition_evals, t WHERE tick_id = tick""",
)
def condition_evals_for_tick(spark: SparkSession, d: str) -> DataFrame:
    evals = table(spark, d, "condition_evals")
    tick = evals.agg(F.max("tick_id").alias("tick_id"))
    return evals.join(F.broadcast(tick), "tick_id", "left_semi").select("asset_key", "code_location_id", "fired", "eval_id").distinct().orderBy("asset_key", "eval_id")


@CORE.query(
    "ticks_latest",
    "SELECT DISTINCT code_location_id, tick_id, timestamp, eval_id FROM condition_evals ORDER BY timestamp DESC, eval_id DESC LIMIT 25",
)
def ticks_latest(spark: SparkSession, d: str) -> DataFrame:
    evals = table(spark, d, "condition_evals").select("code_location_id", "tick_id", "timestamp", "eval_id").distinct()
    return R.newest(evals, 25, F.desc("timestamp"), F.desc("eval_id"))


