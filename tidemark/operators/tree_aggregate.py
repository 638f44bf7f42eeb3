"""Per-key results over badly skewed keys, merged in rounds of bounded fan-in."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import scan_width, shuffle_width

CHUNK = "__chunk"
#: The merge of each kind of partial state; all are associative and commutative.
MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    states: Mapping[str, tuple[str, Column]],
    fan_in: int = 16,
    chunks: int | None = None,
) -> DataFrame:
    """Aggregate ``df`` per ``keys`` without one reducer receiving every partial of a hot key.

    ``states`` maps each result column to (kind, per-row value), kind being one of ``MERGES``.
    Each task first combines its own input chunk; the partial states then meet in rounds. In
    round r a reducer gets, for one key, the states of at most ``fan_in`` groups of round r-1, so a
    key that holds a third of all rows costs no task more than ``fan_in`` states. The number of
    rounds is the logarithm of ``chunks``, the number of tasks that hold ``df``; by default the larger of
    the session's shuffle width and the number of tasks that read the input.

    Null keys form a group of their own; an empty input gives no rows. Columns of ``df`` that are
    neither keys nor used in ``states`` are pruned, so their names can't clash.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    chunks = chunks or max(shuffle_width(df.sparkSession), scan_width(df), 1)
    rounds = max(1, math.ceil(math.log(max(chunks, 2), fan_in) - 1e-9))
    level = df.select(
        *keys,
        *(F.lit(1).cast("long").alias(name) if kind == "count" else value.alias(name) for name, (kind, value) in states.items()),
        F.floor(F.spark_partition_id() / fan_in).cast("int").alias(CHUNK),
    )
    for step in range(rounds):
        last = step == rounds - 1
        level = level.groupBy(*keys, *([] if last else [CHUNK])).agg(
            *(MERGES[kind](name).alias(name) for name, (kind, _) in states.items())
        )
        if not last:
            level = level.withColumn(CHUNK, F.floor(F.col(CHUNK) / fan_in).cast("int"))
    return level


def key_activity(
    events: DataFrame,
    key_fields: Sequence[str] = ("run_id", "asset_key"),
    event_id: str = "event_id",
    timestamp: str = "timestamp",
    fan_in: int = 16,
) -> DataFrame:
    """Distinct events, first and last timestamp of each value of each key field.

    Columns: key_field, key_value, n_events, first_timestamp, last_timestamp. Rows that share an
    event id are copies of one event with the same content and count once. A null key is a group
    with key_value null; blank keys are kept as written. Null timestamps are ignored (both bounds
    null if a key has no other). An empty input gives no rows.
    """
    distinct = events.select(event_id, *key_fields, timestamp).distinct()
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key_field"), F.col(k).cast("string").alias("key_value")) for k in key_fields)))
    keyed = distinct.select(F.col(timestamp).alias("__at"), pairs.alias("__key")).select("__key.*", "__at")
    return tree_aggregate(
        keyed,
        ["key_field", "key_value"],
        {"n_events": ("count", F.lit(1)), "first_timestamp": ("min", F.col("__at")), "last_timestamp": ("max", F.col("__at"))},
        fan_in=fan_in,
        chunks=shuffle_width(events.sparkSession),  # of the distinct events
    )


def heavy_keys(activity: DataFrame, share: float = 0.04, total_field: str = "run_id", fields: int = 2) -> DataFrame:
    """The keys of ``key_activity`` that hold more than ``share`` of all distinct events.

    Null and blank keys are left out of the result yet count in the total, which is that of
    ``total_field`` (each event has exactly one value of each field, null included). No more than
    1 / ``share`` keys of each of the ``fields`` can be above it, so only that many of the largest are
    kept, in the same pass in which the total is counted.
    """
    spark, total = activity.sparkSession, Observation()
    counted = activity.observe(total, F.sum(F.when(F.col("key_field") == total_field, F.col("n_events"))).alias("n"))
    largest = counted.filter(F.col("key_value").rlike(r"\S")).orderBy(F.desc("n_events")).limit(math.ceil(fields / share))
    found = [(r["key_field"], r["key_value"], r["n_events"]) for r in largest.collect()]
    bound = share * (total.get["n"] or 0)
    return spark.createDataFrame([r[:2] for r in found if r[2] > bound], "key_field string, key_value string")
