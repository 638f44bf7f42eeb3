"""Queries p1, p2, p4, p5 and p6: the general data-processing problems over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import activity_by_type, event_types, feature_table, melt_features
from tidemark.operators.history import version_history
from tidemark.operators.log_templates import find_layouts, mine_templates, parse_entries
from tidemark.operators.references import orphan_counts, orphan_references, run_references
from tidemark.operators.tree_aggregate import heavy_keys, key_activity
from tidemark.plans.registry import CORE
from tidemark.session import cut_lineage
from tidemark.sources.tables import table

ACTIVITY_SQL = """
WITH d AS (SELECT DISTINCT event_id, run_id, asset_key, timestamp FROM asset_events),
k AS (SELECT 'run_id' AS key_field, run_id AS key_value, timestamp FROM d
      UNION ALL SELECT 'asset_key', asset_key, timestamp FROM d)
SELECT key_field, key_value, count(*) AS n_events, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp
FROM k GROUP BY key_field, key_value
"""


@CORE.query("p1_key_activity", ACTIVITY_SQL)
def p1_key_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_activity(table(spark, sf_dir, "asset_events"))


@CORE.query(
    "p1_found",
    f"""
WITH a AS ({ACTIVITY_SQL})
SELECT key_field, key_value FROM a
WHERE regexp_matches(key_value, '[^[:space:]]')
  AND n_events > 0.04 * (SELECT count(DISTINCT event_id) FROM asset_events)
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(key_activity(table(spark, sf_dir, "asset_events")), share=0.04)


@CORE.query("p2_templates")
def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined templates themselves: constants and variable slots of each cluster, with their lines."""
    return mine_templates(table(spark, sf_dir, "run_logs"))


@CORE.query("p2_entries")
def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "run_logs")
    return parse_entries(logs, find_layouts(mine_templates(logs)))


@CORE.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "run_logs")
    return parse_entries(logs, find_layouts(mine_templates(logs)), message=False)


@CORE.query(
    "p4_found",
    """
WITH m AS (
  SELECT code_location_id, asset_key, timestamp, arg_max(struct_pack(d := data_version, c := code_version), event_id) AS v
  FROM asset_events WHERE event_type = 'Materialization' AND asset_key IS NOT NULL AND timestamp IS NOT NULL AND code_location_id IS NOT NULL
  GROUP BY code_location_id, asset_key, timestamp),
f AS (
  SELECT code_location_id, asset_key, timestamp,
         coalesce(last_value(v.d IGNORE NULLS) OVER w, '') AS data_version,
         coalesce(last_value(v.c IGNORE NULLS) OVER w, '') AS code_version
  FROM m WINDOW w AS (PARTITION BY code_location_id, asset_key ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
c AS (
  SELECT *, lag(data_version, 1, '') OVER w AS pd, lag(code_version, 1, '') OVER w AS pc
  FROM f WINDOW w AS (PARTITION BY code_location_id, asset_key ORDER BY timestamp))
SELECT code_location_id, asset_key, timestamp AS valid_from,
       coalesce(lead(timestamp) OVER (PARTITION BY code_location_id, asset_key ORDER BY timestamp), -1) AS valid_to,
       data_version, code_version
FROM c WHERE data_version <> pd OR code_version <> pc
""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "asset_events").filter(F.col("event_type") == "Materialization")
    return version_history(updates, ["code_location_id", "asset_key"], ["data_version", "code_version"])


def references_sql(final: str) -> str:
    return f"""
WITH e AS (
  SELECT 'asset_events' AS source_table, event_id AS record_id, run_id, timestamp AS moment, ingested_at FROM asset_events
  UNION ALL SELECT 'pending_dispatch', entry_id, unnest(run_ids), tick_timestamp, ingested_at FROM pending_dispatch),
r AS (
  SELECT source_table, record_id, run_id, lower(regexp_replace(run_id, '^\\s+|\\s+$', '', 'g')) AS id, moment, min(ingested_at) AS ingested_at
  FROM e WHERE regexp_matches(run_id, '\\S') GROUP BY source_table, record_id, run_id, moment),
k AS (SELECT lower(regexp_replace(run_id, '^\\s+|\\s+$', '', 'g')) AS id, min(ingested_at) AS parent_at FROM runs GROUP BY 1),
p AS (SELECT DISTINCT lower(regexp_replace(run_id, '^\\s+|\\s+$', '', 'g')) AS id FROM pruned_runs),
f AS (
  SELECT source_table, record_id, run_id, r.id,
         CASE WHEN k.id IS NULL THEN CASE WHEN p.id IS NULL THEN 'missing' ELSE 'deleted' END
              WHEN parent_at > ingested_at THEN 'late' END AS reason,
         strftime(make_timestamp(moment // 1000), '%Y-%m-%d') AS period
  FROM r LEFT JOIN k ON r.id = k.id LEFT JOIN p ON r.id = p.id)
{final}"""


def found_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = run_references(table(spark, sf_dir, "asset_events"), table(spark, sf_dir, "pending_dispatch"))
    return orphan_references(references, table(spark, sf_dir, "runs"), table(spark, sf_dir, "pruned_runs"))


@CORE.query("p5_found", references_sql("SELECT source_table, record_id, run_id, reason, period FROM f WHERE reason IS NOT NULL"))
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_references(spark, sf_dir)


@CORE.query(
    "p5_orphan_counts",
    references_sql(
        "SELECT source_table, period, reason, count(*) AS n_references, count(DISTINCT id) AS n_ids FROM f WHERE reason IS NOT NULL GROUP BY source_table, period, reason"
    ),
)
def p5_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(found_references(spark, sf_dir))


@CORE.query(
    "p6_found",
    """
WITH d AS (
  SELECT DISTINCT event_id, code_location_id, asset_key, event_type, timestamp,
         list_sum(list_transform(list_filter(metadata, lambda m: m.k = 'rows' AND regexp_full_match(m.v, '[0-9]+')), lambda m: CAST(m.v AS BIGINT))) AS t
  FROM asset_events WHERE asset_key IS NOT NULL AND event_type IS NOT NULL AND code_location_id IS NOT NULL)
SELECT code_location_id, asset_key, event_type, count(*) AS n_events, max(timestamp) AS last_timestamp,
       CAST(coalesce(sum(t), 0) AS BIGINT) AS total_rows
FROM d GROUP BY code_location_id, asset_key, event_type
""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_by_type(table(spark, sf_dir, "asset_events"))


def features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The feature table and its types; the events are read once, and recency is taken at the last event of all."""
    last = Observation()
    events = table(spark, sf_dir, "asset_events").observe(last, F.max("timestamp").alias("at"))
    long = cut_lineage(activity_by_type(events))
    types = event_types(long)
    return feature_table(long, types, F.lit(last.get["at"] or 0)), types


@CORE.query("p6_features")
def p6_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset, three columns for each event type."""
    return features(spark, sf_dir)[0]


@CORE.query(
    "p6_features_melted",
    """
WITH d AS (
  SELECT DISTINCT event_id, code_location_id, asset_key, event_type, timestamp,
         list_sum(list_transform(list_filter(metadata, lambda m: m.k = 'rows' AND regexp_full_match(m.v, '[0-9]+')), lambda m: CAST(m.v AS BIGINT))) AS t
  FROM asset_events WHERE asset_key IS NOT NULL AND event_type IS NOT NULL AND code_location_id IS NOT NULL),
l AS (SELECT code_location_id, asset_key, event_type, count(*) AS n, max(timestamp) AS last_at, CAST(coalesce(sum(t), 0) AS BIGINT) AS total FROM d GROUP BY ALL),
e AS (SELECT DISTINCT code_location_id, asset_key FROM l), k AS (SELECT DISTINCT event_type FROM l)
SELECT code_location_id, asset_key, event_type, coalesce(n, 0) AS n, CAST(round(((SELECT max(timestamp) FROM asset_events) - last_at) / 1000000.0) AS BIGINT) AS age_ms, coalesce(total, 0) AS "rows"
FROM e CROSS JOIN k LEFT JOIN l USING (code_location_id, asset_key, event_type)
""",
)
def p6_features_melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the feature table as a row, so that it can be compared."""
    wide, types = features(spark, sf_dir)
    return melt_features(wide, types).withColumn("age_ms", F.round(F.col("age_s") * 1_000, 0).cast("long")).drop("age_s")
