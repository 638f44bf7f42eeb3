"""References to records that don't exist, were deleted or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Candidate parents up to this many bytes of ids (and some 60 for the rest of each row) are broadcast; more are joined by a salted shuffle.
BROADCAST_BYTES = 10_000_000
#: An id with more than 1/HOT_SHARE of all references is salted, so there are fewer than HOT_SHARE such ids.
HOT_SHARE = 1_000


def normal_id(column: Column) -> Column:
    """An id without surrounding white space (of any script) and in lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def is_blank(column: Column) -> Column:
    return ~column.rlike(r"(?U)\S")


def day_of_nanos(column: Column) -> Column:
    """The UTC date of int64 nanoseconds, as yyyy-MM-dd (dates before 1970 too)."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(column / F.lit(86_400_000_000_000)).cast("int")), "yyyy-MM-dd")


def orphan_references(references: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Each reference whose parent is ``missing``, ``deleted`` or ``late``.

    ``references`` has source_table, record_id, run_id, at (int64 ns) and ingested_at; ``parents``
    run_id and ingested_at; ``deleted`` run_id. Result: source_table, record_id, run_id (as
    written), reason, period (UTC date of ``at``). Ids compare without case and surrounding white
    space; null and blank references are none. Rows of one (source_table, record_id, run_id) are
    copies: they count once, with the earliest ingested_at. A parent written twice counts from its
    earliest row. A null ingested_at on either side can't make a reference late. Empty tables are
    allowed on every side.

    The distinct ids (with the earliest time each is referred to) are anti-joined with the parents;
    only ids that are orphans, or whose parent came after some reference, are joined back to the
    references. That candidate list is broadcast if it is small by bytes, else the ids are
    shuffled, the few hot ones in salted parts.
    """
    written = references.filter(F.col("run_id").isNotNull() & ~is_blank(F.col("run_id"))).withColumn("__id", normal_id(F.col("run_id")))
    # One row per id, stored, as both kinds of candidates start from it.
    distinct = cut_lineage(written.groupBy("__id").agg(F.min("ingested_at").alias("__first"), F.count(F.lit(1)).alias("__n")))
    known = parents.filter(F.col("run_id").isNotNull()).groupBy(normal_id(F.col("run_id")).alias("__id")).agg(F.min("ingested_at").alias("__parent_at"))
    gone = deleted.filter(F.col("run_id").isNotNull()).select(normal_id(F.col("run_id")).alias("__id")).distinct()
    orphans = distinct.join(known, "__id", "left_anti").join(gone.withColumn("__gone", F.lit(True)), "__id", "left")
    late = distinct.join(known, "__id").filter(F.col("__parent_at") > F.col("__first"))
    reasons = orphans.select(
        "__id", "__n", F.when(F.col("__gone"), "deleted").otherwise("missing").alias("reason"), F.lit(None).cast(dict(parents.dtypes)["ingested_at"]).alias("__parent_at")
    ).unionByName(late.select("__id", "__n", F.lit("late").alias("reason"), "__parent_at"))
    candidates = cut_lineage(reasons)
    size, total = candidates.agg(F.sum(F.octet_length("__id") + 60), F.sum("__n")).first()
    if (size or 0) <= BROADCAST_BYTES:
        found = written.join(F.broadcast(candidates.drop("__n")), "__id")
    else:
        hot = F.broadcast(candidates.filter(F.col("__n") * HOT_SHARE > total).select("__id", F.ceil(F.col("__n") * HOT_SHARE / total).cast("int").alias("__salts")))
        spread = F.coalesce(F.col("__salts"), F.lit(1))
        salted = written.join(hot, "__id", "left").withColumn("__salt", F.pmod(F.xxhash64("source_table", "record_id"), spread).cast("int")).drop("__salts")
        copies = candidates.drop("__n").join(hot, "__id", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("__salts")
        found = salted.join(copies, ["__id", "__salt"])
    records = found.groupBy("source_table", "record_id", "run_id", "at", "reason", "__parent_at").agg(F.min("ingested_at").alias("ingested_at"))
    return records.filter((F.col("reason") != "late") | (F.col("__parent_at") > F.col("ingested_at"))).select(
        "source_table", "record_id", "run_id", "reason", day_of_nanos(F.col("at")).alias("period")
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, period and reason, with the number of distinct ids named."""
    return found.groupBy("source_table", "period", "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.count_distinct(normal_id(F.col("run_id"))).alias("n_ids")
    )


def run_references(events: DataFrame, dispatch: DataFrame) -> DataFrame:
    """The references of event rows (run_id) and of dispatch entries (each element of run_ids)."""
    of_events = events.select(F.lit("asset_events").alias("source_table"), F.col("event_id").alias("record_id"), "run_id", F.col("timestamp").alias("at"), "ingested_at")
    of_dispatch = dispatch.select(F.lit("pending_dispatch").alias("source_table"), F.col("entry_id").alias("record_id"), F.explode("run_ids").alias("run_id"), F.col("tick_timestamp").alias("at"), "ingested_at")
    return of_events.unionByName(of_dispatch)
