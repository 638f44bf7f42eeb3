"""State and history of assets, partitions and steps from the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.partition_keys import display_members
from tidemark.operators.runs import latest_per

ASSET = ["code_location_id", "asset_key"]
STEP_EVENTS = ("StepStart", "StepSuccess", "StepFailure")

# Rank of an event type among events of one timestamp; other types come last.
SORT_ORDER = {
    "StepStart": 0, "Observation": 2, "Materialization": 3, "StepSuccess": 4, "StepFailure": 4, "StepRetry": 4,
    "RunQueued": 5, "RunDequeued": 5, "RunLaunchFailed": 5,
    "StepSlotClaimed": 6, "StepSlotWaiting": 6, "StepSlotRenewed": 6, "StepSlotReleased": 6,
}


def sort_rank(event_type: Column) -> Column:
    table = F.create_map(*(x for k, v in SORT_ORDER.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, event_type), F.lit(7))


def once(events: DataFrame, *columns: str) -> DataFrame:
    """The events of a log that may deliver a row twice: distinct by event_id and the columns asked for."""
    return events.select("event_id", *(c for c in columns if c != "event_id")).distinct()


def latest_materialization(events: DataFrame, keys: Sequence[str] = tuple(ASSET)) -> DataFrame:
    """The newest materialisation of each key by (timestamp, event_id)."""
    made = events.filter((F.col("event_type") == "Materialization") & F.col("asset_key").isNotNull())
    return latest_per(made, keys, ["timestamp", "event_id"], ["event_id", "run_id", "timestamp", "data_version"])


def asset_state(events: DataFrame) -> DataFrame:
    """Current state of each asset where the last write wins: by event_id, not by timestamp."""
    made = events.filter((F.col("event_type") == "Materialization") & F.col("asset_key").isNotNull())
    return latest_per(made, ASSET, ["event_id"], ["event_id", "run_id", "timestamp", "data_version"]).withColumnsRenamed(
        {"event_id": "last_event_id", "run_id": "last_run_id", "timestamp": "last_timestamp", "data_version": "last_data_version"}
    )


def with_members(events: DataFrame) -> DataFrame:
    """One row per partition that an event is about: batch keys are expanded to their members."""
    return events.filter(F.col("partition_key").isNotNull()).withColumn("partition", F.explode(display_members(F.col("partition_key.display"))))


def partition_state(events: DataFrame) -> DataFrame:
    """Latest write of each asset partition (by event_id)."""
    made = with_members(events.filter((F.col("event_type") == "Materialization") & F.col("asset_key").isNotNull()))
    return latest_per(made, [*ASSET, "partition"], ["event_id"], ["event_id", "run_id", "timestamp"])


def failed_partitions(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Partitions whose last failure is later than their last materialisation, if there is any.

    Step failures count at their event, failed runs (for each of their nodes) at the run's start.
    A materialisation at the same time clears the failure. One pass over the events: both times are
    conditional maxima.
    """
    rows = with_members(events.filter(F.col("event_type").isin("Materialization", "StepFailure") & F.col("asset_key").isNotNull())).select(
        *ASSET, "partition", F.when(F.col("event_type") == "Materialization", F.col("timestamp")).alias("mat"), F.when(F.col("event_type") == "StepFailure", F.col("timestamp")).alias("fail")
    )
    if runs is not None:
        failed = with_members(runs.filter("status = 'Failure'")).select(
            "code_location_id", F.explode("node_names").alias("asset_key"), "partition", F.lit(None).cast("long").alias("mat"), F.col("start_time").alias("fail")
        )
        rows = rows.unionByName(failed)
    both = rows.groupBy(*ASSET, "partition").agg(F.max("mat").alias("materialized_at"), F.max("fail").alias("failed_at"))
    return both.filter(F.col("failed_at").isNotNull() & (F.col("materialized_at").isNull() | (F.col("materialized_at") < F.col("failed_at"))))


def missing_partitions(universe: DataFrame, events: DataFrame) -> DataFrame:
    """(asset, partition) of the universe that was never materialised."""
    made = with_members(events.filter("event_type = 'Materialization'")).select(*ASSET, "partition").distinct()
    return universe.join(made, [*ASSET, "partition"], "left_anti")


def in_progress_partitions(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Partitions of steps that started in a run still going on."""
    running = runs.filter("status = 'Started'").select("run_id")
    return with_members(events.filter("event_type = 'StepStart' AND asset_key IS NOT NULL")).join(running, "run_id", "left_semi").select(*ASSET, "partition").distinct()


def partition_heatmap(universe: DataFrame, events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per asset the partitions of the universe by state; a current failure wins over a materialisation."""
    state = F.when(F.col("__failed"), "Failed").when(F.col("__made"), "Materialized").otherwise("Missing")
    made = with_members(events.filter("event_type = 'Materialization'")).select(*ASSET, "partition").distinct().withColumn("__made", F.lit(True))
    failed = failed_partitions(events, runs).select(*ASSET, "partition").withColumn("__failed", F.lit(True))
    labelled = universe.join(made, [*ASSET, "partition"], "left").join(failed, [*ASSET, "partition"], "left").select(*ASSET, state.alias("state"))
    return labelled.groupBy(*ASSET).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "Materialized").alias("materialized"),
        F.count_if(F.col("state") == "Failed").alias("failed"),
        F.count_if(F.col("state") == "Missing").alias("missing"),
    )


def run_progress(events: DataFrame) -> DataFrame:
    """Per run the distinct steps started and ended, and the last end; a partition's failure ends no step."""
    over = (F.col("event_type") == "StepSuccess") | ((F.col("event_type") == "StepFailure") & F.col("partition_key").isNull())
    steps = events.filter(F.col("asset_key").isNotNull() & F.col("event_type").isin(*STEP_EVENTS))
    per_step = steps.groupBy("run_id", "asset_key").agg(
        F.bool_or(F.col("event_type") == "StepStart").alias("started"), F.bool_or(over).alias("ended"), F.max(F.when(over, F.col("timestamp"))).alias("at")
    )
    last = F.max(F.when(F.col("ended"), F.struct("at", "asset_key")))
    return per_step.groupBy("run_id").agg(
        F.count_if("started").alias("total_steps"), F.count_if("ended").alias("completed_steps"), last["at"].alias("last_step_completed_at"), last["asset_key"].alias("last_completed_step")
    )


def gantt_spans(events: DataFrame) -> DataFrame:
    """Start, end and last status of each step of a run; a step without an end is running."""
    order = F.struct("timestamp", sort_rank(F.col("event_type")), "event_id")
    kind, at = F.col("event_type"), F.col("timestamp")
    ended = kind.isin("StepSuccess", "StepFailure")
    spans = events.filter(F.col("asset_key").isNotNull()).groupBy("run_id", "asset_key").agg(
        F.min(F.when(kind == "StepStart", at)).alias("__start"), F.max(F.when(kind != "StepStart", at)).alias("__end"), F.max(F.when(ended, F.struct(order.alias("o"), kind.alias("k"))))["k"].alias("__last")
    )
    status = F.when(F.col("__last") == "StepSuccess", "Success").when(F.col("__last") == "StepFailure", "Failure").otherwise("Running")
    return spans.select(
        "run_id", "asset_key", F.coalesce("__start", "__end", F.lit(0)).alias("start"), F.when(F.col("__last").isNotNull(), F.coalesce("__end", "__start")).alias("end"), status.alias("status")
    )


def asset_chip_status(events: DataFrame) -> DataFrame:
    """Per run and asset: a failure of the step > success > start; failures of single partitions don't count."""
    kind = F.col("event_type")
    failed = F.bool_or((kind == "StepFailure") & F.col("partition_key").isNull())
    label = F.when(failed, "failed").when(F.bool_or(kind == "StepSuccess"), "success").when(F.bool_or(kind == "StepStart"), "running").otherwise("pending")
    return events.filter(F.col("asset_key").isNotNull()).groupBy("run_id", "asset_key").agg(label.alias("chip"))


def events_page(events: DataFrame, offset: int, limit: int, newest_first: bool) -> DataFrame:
    """One page in the total order (timestamp, sort_order, event_id): a top-k over distinct events."""
    order = [F.desc(c) if newest_first else F.asc(c) for c in ("timestamp", "sort_order", "event_id")]
    return once(events, "event_type", "run_id", "asset_key", "timestamp", "sort_order").orderBy(*order).offset(offset).limit(limit)


def consumed_versions(events: DataFrame) -> DataFrame:
    """Edges observed in the log: the newest version of each input that an asset consumed."""
    pairs = events.filter((F.col("event_type") == "Materialization") & (F.size("input_data_versions") > 0)).select(
        *ASSET, "timestamp", "event_id", F.explode("input_data_versions").alias("p")
    )
    flat = pairs.select(*ASSET, F.col("p.k").alias("dep_key"), F.col("p.v").alias("version"), "timestamp", "event_id")
    return latest_per(flat, [*ASSET, "dep_key"], ["timestamp", "event_id"], ["version"])


def pair_value(pairs: Column, key: str) -> Column:
    """The first value under a key of a pair list; null if there is none."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(1))["v"]


def rising_edges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> Column:
    """True where ``flag`` holds and did not at the row before; a first row that holds is an edge."""
    w = W.partitionBy(*keys).orderBy(*order)
    return flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
