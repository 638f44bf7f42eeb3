"""Streaming queries, run over the stored event files as a stream that ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.runs import latest_per
from tidemark.plans.registry import CORE
from tidemark.plans.table_queries import scratch
from tidemark.sources.tables import table
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import events as S


def stream(spark: SparkSession, d: str, lateness: str = "400 days") -> DataFrame:
    """A glob, as the table is a file or a folder. The lateness covers the whole of the stored span, as files are taken in no order of time."""
    return S.event_stream(spark, f"{d}/asset_events*.parquet", table(spark, d, "asset_events").schema, lateness=lateness)


@CORE.query(
    "stream_asset_state",
    """SELECT code_location_id, asset_key, event_id, run_id, timestamp, data_version FROM (SELECT DISTINCT code_location_id, asset_key, event_id, run_id, timestamp, data_version FROM asset_events
 WHERE event_type = 'Materialization' AND asset_key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY code_location_id, asset_key ORDER BY timestamp DESC, event_id DESC) = 1""",
)
def stream_asset_state(spark: SparkSession, d: str) -> DataFrame:
    state = VersionedTable(spark, scratch(spark))
    S.run_available(stream(spark, d), S.asset_state_sink(state))
    return state.read()


def gathered(spark: SparkSession, df: DataFrame, mode: str, partition: str | None = None) -> DataFrame:
    """What a stream wrote, batch by batch, into a table."""
    out = VersionedTable(spark, scratch(spark))

    def sink(batch: DataFrame, number: int) -> None:
        out.write(batch.withColumn("batch_id", F.lit(number).cast("long")), "append")

    S.run_available(df, sink, mode=mode)
    return out.read()


@CORE.query("stream_tumbling", "SELECT event_type, CAST(date_trunc('day', make_timestamp(timestamp // 1000)) AS TIMESTAMP) AS window_start, count(DISTINCT event_id) AS n FROM asset_events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    counts = gathered(spark, S.tumbling_counts(stream(spark, d)), "update")
    last = latest_per(counts, ["event_type", "window_start"], ["batch_id"], ["n"])
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@CORE.query(
    "stream_since_latch",
    """SELECT code_location_id, asset_key, coalesce(max(timestamp) FILTER (event_type = 'StepFailure'), -1) > coalesce(max(timestamp) FILTER (event_type = 'Materialization'), -1) AS latched
 FROM asset_events WHERE asset_key IS NOT NULL AND event_type IN ('StepFailure', 'Materialization') GROUP BY 1, 2""",
)
def stream_since_latch(spark: SparkSession, d: str) -> DataFrame:
    rows = gathered(spark, S.since_latch(stream(spark, d), "StepFailure", "Materialization"), "update")
    return latest_per(rows, S.ASSET, ["batch_id"], ["latched"])
