"""History of changing attributes from snapshots or from updates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import cut_lineage


def diff_snapshots(
    before: DataFrame, after: DataFrame, keys: Sequence[str], attributes: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """Classify the keys of two snapshots by a null-safe full outer join.

    Columns: the keys, the attributes (of ``after``, or of ``before`` for deleted keys), the
    ``carried`` columns of ``after`` (null for deleted keys; they aren't compared) and
    ``change``: ``inserted``, ``changed``, ``deleted`` or ``same``. Keys and attributes compare
    null-safely, so a null key matches a null key and null to null is no change. Each snapshot must
    hold a key once. Other columns are dropped, so clashing names don't matter.
    """
    left = before.select(*(F.col(k).alias(f"__bk_{k}") for k in keys), *(F.col(a).alias(f"__b_{a}") for a in attributes), F.lit(1).alias("__before"))
    right = after.select(*keys, *attributes, *carried, F.lit(1).alias("__after"))
    joined = left.join(right, reduce(Column.__and__, (F.col(f"__bk_{k}").eqNullSafe(F.col(k)) for k in keys)), "full_outer")
    same = reduce(Column.__and__, (F.col(f"__b_{a}").eqNullSafe(F.col(a)) for a in attributes))
    gone = F.col("__after").isNull()
    return joined.select(
        *(F.when(gone, F.col(f"__bk_{k}")).otherwise(F.col(k)).alias(k) for k in keys),
        *(F.when(gone, F.col(f"__b_{a}")).otherwise(F.col(a)).alias(a) for a in attributes),
        *carried,
        F.when(F.col("__before").isNull(), "inserted").when(gone, "deleted").when(same, "same").otherwise("changed").alias("change"),
    )


def history_from_snapshots(snapshots: DataFrame, period: str, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Full history from periodic snapshots held in one table, told apart by ``period``.

    Each snapshot is joined with the one before it (full outer, null-safe); the union of inserted,
    changed and deleted keys is the list of change events, and ``lead`` over them gives the time
    each version held. Columns: keys, attributes, valid_from, valid_to (null while current). A
    deleted key ends its version and has no row of its own; a key that returns starts a new version.
    Rows with a null period belong to no snapshot. An empty input gives no rows.
    """
    rows = snapshots.filter(F.col(period).isNotNull()).select(*keys, *attributes, F.col(period).alias("__period"))
    periods = rows.select("__period").distinct()
    # one row per period: as many as there are snapshots, far below the number of keys
    order = periods.withColumn("__next", F.lead("__period").over(W.orderBy("__period")))
    before = rows.join(order, "__period").filter(F.col("__next").isNotNull()).drop("__period").withColumnRenamed("__next", "__period")
    events = diff_snapshots(before, rows, ["__period", *keys], attributes).filter(F.col("change") != "same")
    timeline = W.partitionBy(*keys).orderBy("__period")
    return (
        events.withColumn("valid_to", F.lead("__period").over(timeline))
        .filter(F.col("change") != "deleted")
        .select(*keys, *attributes, F.col("__period").alias("valid_from"), "valid_to")
    )


def version_history(
    updates: DataFrame,
    keys: Sequence[str],
    attributes: Sequence[str],
    timestamp: str = "timestamp",
    sequence: str = "event_id",
) -> DataFrame:
    """Periods of validity of each entity's attributes, from updates in any order of arrival.

    Columns: keys, valid_from, valid_to (-1 while current), attributes (strings; '' stands for a
    value not yet known). Of several updates of an entity at one timestamp the one with the highest
    ``sequence`` counts; copies of an update count once. A null attribute leaves the last known
    value in force. A period begins where the attributes differ from those before; all-'' is no
    period. Rows with a null timestamp or a null key are left out. An empty input gives no rows.

    The state after an entity's n-th update is its n-th snapshot; consecutive snapshots are compared
    with ``diff_snapshots`` and ``lead`` over the changes gives the validity. No task takes all of
    an entity: updates are range-partitioned by (keys, time), which cuts a hot entity into slices of
    ordinary size, and only one row per slice is needed to carry state and ends across slices.
    """
    keys, attributes = list(keys), list(attributes)
    tidy = updates.filter(reduce(Column.__and__, (F.col(c).isNotNull() for c in [*keys, timestamp])))
    picked = (
        tidy.select(*keys, F.col(timestamp).alias("__at"), F.struct(F.col(sequence).alias("__seq"), *(F.col(a).cast("string").alias(a) for a in attributes)).alias("__row"))
        .groupBy(*keys, "__at")
        .agg(F.max("__row").alias("__row"))
        .select(*keys, "__at", *(F.col(f"__row.{a}").alias(a) for a in attributes))
    )
    sliced = cut_lineage(picked.repartitionByRange(*keys, "__at").withColumn("__slice", F.spark_partition_id()))
    part = [*keys, "__slice"]
    in_slice = W.partitionBy(*part).orderBy("__at")
    known = sliced.select(
        *part, "__at", F.row_number().over(in_slice).alias("__n"), *(F.last(a, ignorenulls=True).over(in_slice).alias(a) for a in attributes)
    )
    # One row per entity and slice: the values in force at its end, then those brought in from before.
    ends = sliced.groupBy(*part).agg(*(F.max(F.when(F.col(a).isNotNull(), F.struct("__at", F.col(a).alias("v"))))["v"].alias(a) for a in attributes))
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    brought = ends.select(
        *part,
        F.lag(F.lit(True), 1, False).over(W.partitionBy(*keys).orderBy("__slice")).alias("__later"),
        *(F.coalesce(F.last(a, ignorenulls=True).over(earlier), F.lit("")).alias(f"__in_{a}") for a in attributes),
    )
    states = known.join(brought, part).select(*part, "__at", "__n", *(F.coalesce(F.col(a), F.col(f"__in_{a}")).alias(a) for a in attributes))
    opening = brought.filter("__later").select(*part, F.lit(None).cast(dict(sliced.dtypes)["__at"]).alias("__at"), F.lit(0).alias("__n"), *(F.col(f"__in_{a}").alias(a) for a in attributes))
    before = states.unionByName(opening).withColumn("__n", F.col("__n") + 1)
    blank = reduce(Column.__and__, (F.col(a) == "" for a in attributes))
    changes = diff_snapshots(before, states, [*part, "__n"], attributes, carried=["__at"])
    # Stored, as both the ends within a slice and those across slices start from them.
    begins = cut_lineage(changes.filter(F.col("change").isin("inserted", "changed") & ~blank).drop("change"))
    # Ends are taken within a slice, then across slices.
    ordered = begins.withColumn("__end", F.lead("__at").over(W.partitionBy(*part).orderBy("__n")))
    firsts = begins.groupBy(*part).agg(F.min("__at").alias("__first")).select(*part, F.lead("__first").over(W.partitionBy(*keys).orderBy("__slice")).alias("__next"))
    return ordered.join(firsts, part).select(
        *keys, F.col("__at").alias("valid_from"), F.coalesce("__end", "__next", F.lit(-1)).cast("long").alias("valid_to"), *attributes
    )
