"""Run and queue analytics: filters, summaries, pages, latest-per-key, dequeue order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import cut_lineage, ship_package

QUEUE_STATES = ("Queued", "NotStarted")
BUSY_STATES = ("Started", "NotStarted")
TAGS = "array<struct<k:string,v:string>>"
COUNTERS = "array<struct<i:int,v:string>>"
DAY_NS = 86_400_000_000_000
PRIORITY_TAG = "priority"


def any_contains(items: Column, part: str) -> Column:
    """True if any string of an array holds ``part``, in any case; false for a null or empty array."""
    return F.coalesce(F.exists(items, lambda x: F.contains(F.lower(x), F.lit(part.lower()))), F.lit(False))


def tag_contains(tags: Column, keys: Sequence[str], part: str) -> Column:
    """True if the value of any pair under one of ``keys`` holds ``part``, in any case."""
    found = F.exists(tags, lambda t: t["k"].isin(list(keys)) & F.contains(F.lower(t["v"]), F.lit(part.lower())))
    return F.coalesce(found, F.lit(False))


def tags_match(tags: Column, keys: Sequence[str] = (), pairs: Mapping[str, str] | None = None) -> Column:
    """True if every key is present and every exact pair too; keys may repeat. Nothing asked matches all."""

    def has(key: str, value: str | None = None) -> Column:
        return F.exists(tags, lambda t: (t["k"] == key) if value is None else (t["k"] == key) & (t["v"] == value))

    parts = [*(has(k) for k in keys), *(has(k, v) for k, v in (pairs or {}).items())]
    return F.coalesce(reduce(Column.__and__, parts, F.lit(True)), F.lit(False))


def priority_of(tags: Column, key: str = PRIORITY_TAG) -> Column:
    """The first value under ``key`` as an int; 0 if there is none or it is no number."""
    first = F.filter(tags, lambda t: t["k"] == key)
    return F.coalesce(F.try_element_at(first, F.lit(1))["v"].try_cast("int"), F.lit(0))


@dataclass(frozen=True)
class RunFilter:
    status: str | None = None
    job: str | None = None
    job_part: str | None = None
    asset_part: str | None = None
    partition_part: str | None = None
    location: str | None = None

    def column(self) -> Column:
        """One predicate; ``Queued`` stands for the whole queue, waiting or launching."""
        parts = []
        if self.location is not None:
            parts.append(F.col("code_location_id") == self.location)
        if self.status is not None:
            parts.append(F.col("status").isin(*QUEUE_STATES) if self.status == "Queued" else F.col("status") == self.status)
        if self.job is not None:
            parts.append(F.col("job_name") == self.job)
        if self.job_part is not None:
            parts.append(F.contains(F.lower("job_name"), F.lit(self.job_part.lower())))
        if self.asset_part is not None:
            parts.append(any_contains(F.col("node_names"), self.asset_part))
        if self.partition_part is not None:
            parts.append(tag_contains(F.col("tags"), ("partition", "partition_key"), self.partition_part))
        return reduce(Column.__and__, parts, F.lit(True))


def runs_page(runs: DataFrame, wanted: RunFilter = RunFilter(), offset: int = 0, limit: int = 50) -> DataFrame:
    """The filtered runs newest first (ties by run_id), one page of them, each row with the total.

    The page is a top-k over the filter, so no full sort takes place; an offset past the end gives no
    rows.
    """
    kept = runs.filter(wanted.column())
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    page = kept.orderBy(F.desc("start_time"), "run_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def status_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts in one pass; ``total`` counts all rows, empty input gives zeros."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def runs_summary(runs: DataFrame, as_of: int) -> DataFrame:
    status = F.col("status")
    return status_counts(
        runs,
        in_progress=status == "Started",
        queued=status.isin(*QUEUE_STATES),
        failure=status == "Failure",
        success=status == "Success",
        last_24h=F.col("start_time") > as_of - DAY_NS,
    )


def newest(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows by a total order (top-k, not a sort of all)."""
    return rows.orderBy(*order).limit(n)


def latest_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` (lexicographic): a partial aggregate, no sort.

    Null order values lose to any other; rows with a null key form a group. Ties are rows equal in
    ``order``, of which the greatest by the remaining columns wins.
    """
    row = F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("__row")
    return rows.groupBy(*keys).agg(row).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in columns))


def keep_latest(rows: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The newest n rows of each key; with ``retained`` false the others would be deleted."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def stalled_runs(runs: DataFrame, events: DataFrame, cutoff: int) -> DataFrame:
    """Runs that never started since ``cutoff``: by their last dequeue, or else their start time."""
    waiting = runs.filter(F.col("status") == "NotStarted")
    dequeued = events.filter(F.col("event_type") == "RunDequeued").groupBy("run_id").agg(F.max("timestamp").alias("dequeued_at"))
    since = F.coalesce("dequeued_at", "start_time")
    return waiting.join(dequeued, "run_id", "left").filter(since < cutoff).select("run_id", since.alias("waiting_since"))


def tag_counts(runs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Runs in progress by tag key and by key and value, in one pass (grouping sets).

    A pair that a run repeats counts each time. ``tag_value`` is null in the rows by key.
    """
    pairs = runs.select(F.explode("tags").alias("t")).select(F.col("t.k").alias("tag_key"), F.col("t.v").alias("tag_value"))
    if keys is not None:
        pairs = pairs.filter(F.col("tag_key").isin(list(keys)))
    level = F.grouping("tag_value")
    return pairs.groupingSets([["tag_key"], ["tag_key", "tag_value"]], "tag_key", "tag_value").agg(level.alias("__g"), F.count(F.lit(1)).alias("n")).select(
        "tag_key", "tag_value", F.when(F.col("__g") == 1, "key").otherwise("key_value").alias("level"), "n"
    )


def queue_order() -> list[Column]:
    """Priority first, then age; run_id makes the order total."""
    return [F.desc("priority"), F.asc("start_time"), F.asc("run_id")]


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``place``, the number of each row within its key (from 1) in a total order, and ``waiting``, how many there are.

    No task takes all rows of a key: rows are range-partitioned by key and order, numbered slice by
    slice, and moved by the sizes of the slices before, of which there is one row per key and task.
    """
    stored = cut_lineage(rows.repartitionByRange(*(F.asc(k) for k in keys), *order).withColumn("__slice", F.spark_partition_id()))
    sizes = stored.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    of_key = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(of_key.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__slice").alias("__of"), before.alias("__before"), F.sum("__n").over(of_key).alias("waiting"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__slice") == F.col("__of"))
    number = F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(*order))
    return stored.withColumn("__local", number).join(offsets, same).select(*rows.columns, (F.col("__before") + F.col("__local")).alias("place"), "waiting")


def dequeue_global(runs: DataFrame, most: int) -> DataFrame:
    """The queued runs that start next if each code location may have ``most`` in progress; below 0 means no limit.

    Runs started and runs being launched are in progress. The constant bound on the place lets each
    task keep ``most`` runs of a location before the shuffle.
    """
    queued = runs.filter(F.col("status") == "Queued")
    if most < 0:
        return queued
    busy = runs.filter(F.col("status").isin(*BUSY_STATES)).groupBy("code_location_id").agg(F.count(F.lit(1)).alias("__busy"))
    first = queued.withColumn("__place", F.row_number().over(W.partitionBy("code_location_id").orderBy(*queue_order()))).filter(F.col("__place") <= most)
    return first.join(busy, "code_location_id", "left").filter(F.col("__place") + F.coalesce("__busy", F.lit(0)) <= most).select(*runs.columns)


@dataclass(frozen=True)
class TagLimit:
    key: str
    limit: int
    value: str | None = None
    per_value: bool = False

    def counters(self, number: int) -> Column:
        """The counters that a run's tags touch, one for each matching tag: (limit's number, value if each has its own)."""
        of_key = F.filter(F.coalesce("tags", F.array().cast(TAGS)), lambda t: (t["k"] == self.key) if self.value is None else (t["k"] == self.key) & (t["v"] == self.value))
        return F.transform(of_key, lambda t: F.struct(F.lit(number).alias("i"), (t["v"] if self.per_value else F.lit(None).cast("string")).alias("v")))


def dequeue(runs: DataFrame, limits: Iterable[TagLimit], most: int = -1) -> DataFrame:
    """The queued runs that start next under several tag limits and ``most`` runs in progress (below 0: any number).

    Each code location has a queue and counts of its own. A tag counts as often as a run has it; a run
    waits if any counter that it touches has reached its limit, and runs behind it go on. Runs in
    progress are those started or being launched. Columns: code_location_id, run_id, priority,
    start_time, position (from 1). Null tags are none.

    The queue is folded in order, but no call takes all of it: of runs that touch the same counters
    only as many can start as the least of their limits allows, and once one of them waits so do all
    behind it. So only that many of each set of counters are kept, before the shuffle.
    """
    limits = tuple(limits)
    ship_package(runs.sparkSession)
    touched = F.concat(F.array().cast(COUNTERS), *(limit.counters(i) for i, limit in enumerate(limits)))
    live = runs.select("code_location_id", "run_id", "status", "priority", "start_time", touched.alias("counters"))
    busy = live.filter(F.col("status").isin(*BUSY_STATES)).select("code_location_id", F.explode(F.concat("counters", F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("v"))))).alias("c"))
    counts = busy.groupBy("code_location_id", "c").agg(F.count(F.lit(1)).alias("n")).select("code_location_id", "c.i", "c.v", "n")
    queued = live.filter(F.col("status") == "Queued").drop("status")
    place = F.row_number().over(W.partitionBy("code_location_id", F.array_sort(F.array_distinct("counters"))).orderBy(*queue_order()))
    least = F.least(F.lit(1 << 30), F.lit(1 << 30 if most < 0 else most), *(F.when(F.array_contains("counters.i", i), limit.limit) for i, limit in enumerate(limits)))
    bound = max((x.limit for x in limits), default=0) if most < 0 else most
    tagged = queued.filter(F.size("counters") > 0) if most < 0 else queued
    kept = tagged.withColumn("__place", place).filter((F.col("__place") <= bound) & (F.col("__place") <= least)).drop("__place")

    def fold(queue: pd.DataFrame, used: pd.DataFrame) -> pd.DataFrame:
        count = {(int(i), v): int(n) for i, v, n in used[["i", "v", "n"]].itertuples(index=False)}
        free = len(queue) if most < 0 else most - count.get((-1, None), 0)
        taken = []
        for row in queue.sort_values(["priority", "start_time", "run_id"], ascending=[False, True, True]).itertuples(index=False):
            if len(taken) >= free:
                break
            wanted = [(int(c["i"]), c["v"]) for c in row.counters]
            if any(count.get(c, 0) >= limits[c[0]].limit for c in wanted):
                continue
            for c in wanted:
                count[c] = count.get(c, 0) + 1
            taken.append((row.code_location_id, row.run_id, row.priority, row.start_time))
        return pd.DataFrame(taken, columns=["code_location_id", "run_id", "priority", "start_time"])

    schema = ", ".join(f"{c} {t}" for c, t in queued.drop("counters").dtypes)
    started = kept.groupBy("code_location_id").cogroup(counts.groupBy("code_location_id")).applyInPandas(fold, schema)
    if most < 0:  # runs that no limit concerns all start
        started = started.unionByName(queued.filter(F.size("counters") == 0).drop("counters"))
    return started.withColumn("position", F.row_number().over(W.partitionBy("code_location_id").orderBy(*queue_order())))


def dequeue_tag_limit(runs: DataFrame, key: str, limit: int, most: int) -> DataFrame:
    """The next runs of each code location under one limit per distinct value of a tag key."""
    return dequeue(runs, [TagLimit(key, limit, per_value=True)], most)


def queue_lane(status: Column, reason: Column) -> Column:
    """The lane of a queued run by its status and the text of its block reason."""
    text = F.coalesce(reason, F.lit(""))
    return (
        F.when(status == "NotStarted", "launching")
        .when(text.contains("gpu") | text.contains("pool"), "pool")
        .when(text.contains("concurrency") | text.contains("limit"), "concurrency")
        .when(text.contains("backfill"), "backfill")
        .when(text == "", "waiting")
        .otherwise("other")
    )
