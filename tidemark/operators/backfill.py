"""Backfills: outcome of their runs, pages of their partitions, plans of what fired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.partition_keys import display_members


def backfill_members(runs: DataFrame, events: DataFrame) -> DataFrame:
    """(group, run_id, member, outcome): what became of each partition of each run of a group.

    ``runs`` has group, run_id, status and partition (display). In a run that succeeded, members that
    an event reports as failed are failed; in a failed or cancelled run all are so.
    """
    members = runs.filter(F.col("partition").isNotNull()).withColumn("member", F.explode(display_members(F.col("partition"))))
    failures = (
        events.filter((F.col("event_type") == "StepFailure") & F.col("partition_key").isNotNull())
        .select("run_id", F.explode(display_members(F.col("partition_key.display"))).alias("member")).distinct().withColumn("__failed", F.lit(True))
    )
    outcome = (
        F.when(F.col("status") == "Success", F.when(F.col("__failed"), "failed").otherwise("completed"))
        .when(F.col("status") == "Failure", "failed")
        .when(F.col("status") == "Canceled", "canceled")
        .otherwise("pending")
    )
    return members.join(failures, ["run_id", "member"], "left").select("group", "run_id", "member", outcome.alias("outcome"))


def backfill_outcome(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Per group the members by outcome and the status: failed over cancelled over success; open runs keep it open.

    Runs without a partition have no member, yet their status counts.
    """
    of_members = backfill_members(runs, events).select("group", "outcome", F.lit(1).alias("n"))
    bare = {"Success": "completed", "Failure": "failed", "Canceled": "canceled"}
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in bare.items() for x in kv)), F.col("status")), F.lit("pending"))
    of_runs = runs.filter(F.col("partition").isNull()).select("group", kind.alias("outcome"), F.lit(0).alias("n"))
    rows = of_members.unionByName(of_runs)
    has = lambda o: F.bool_or(F.col("outcome") == o)
    status = F.when(has("pending"), "InProgress").when(has("failed"), "CompletedFailed").when(has("canceled"), "Canceled").otherwise("CompletedSuccess")
    return rows.groupBy("group").agg(*(F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(o) for o in ("completed", "failed", "canceled", "pending")), status.alias("status"))


def partitions_page(members: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of a backfill's partitions by name; of several outcomes completed wins, then failed, then canceled."""
    rank = F.array_position(F.array(*(F.lit(o) for o in ("completed", "failed", "canceled", "pending"))), F.col("outcome"))
    best = members.groupBy("member").agg(F.min(F.struct(rank.alias("r"), "outcome"))["outcome"].alias("state"))
    return best.orderBy("member").offset(offset).limit(limit)


def materialization_plan(fired: DataFrame) -> DataFrame:
    """What to launch for the assets that fired (asset_key, partition or null).

    No partition: a plain run; one key: runs grouped by the key; several: a backfill of the keys.
    """
    keys = F.sort_array(F.collect_set("partition"))
    per = fired.groupBy("asset_key").agg(keys.alias("keys"))
    kind = F.when(F.size("keys") == 0, "unpartitioned").when(F.size("keys") == 1, "single_key").otherwise("backfill")
    group = F.when(F.size("keys") == 0, F.lit("")).when(F.size("keys") == 1, F.col("keys")[0]).otherwise(F.col("asset_key"))
    return per.groupBy(kind.alias("kind"), group.alias("launch")).agg(F.sort_array(F.collect_set("asset_key")).alias("assets"), F.max(F.size("keys")).alias("n_keys"))
