"""Slot pools: use, eligibility of claims, leases, reasons for waiting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formats import elapsed_text, seconds_text

EXPIRING_NS = 30_000_000_000


def pool_usage(slots: DataFrame, as_of: Column) -> DataFrame:
    """Slots in use per pool: those whose lease hasn't run out."""
    return slots.filter(F.col("lease_expires_at") > as_of).groupBy("pool_key").agg(F.sum("slots_consumed").alias("claimed"))


def pool_infos(pools: DataFrame, slots: DataFrame, pending: DataFrame, as_of: Column) -> DataFrame:
    """Each pool with its limit, the slots claimed and the steps that wait."""
    waiting = pending.groupBy("pool_key").agg(F.count(F.lit(1)).alias("pending"))
    return (
        pools.join(pool_usage(slots, as_of), "pool_key", "left").join(waiting, "pool_key", "left")
        .select("pool_key", "slot_limit", F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("pending", F.lit(0)).alias("pending"))
    )


def claims(needs: DataFrame, infos: DataFrame) -> DataFrame:
    """Per step, whether all pools it needs have room, and the text of what is full.

    ``needs`` has step_key, pool_key, slots. A limit below 0 is none; a pool that doesn't exist has
    no room. All or nothing: one full pool refuses the step.
    """
    rows = needs.join(infos, "pool_key", "left")
    room = F.coalesce("slot_limit", F.lit(0)) - F.coalesce("claimed", F.lit(0))
    fits = F.coalesce(F.col("slot_limit") < 0, F.lit(False)) | (F.col("slots") <= room)
    part = F.format_string("'%s' (%d/%d)", "pool_key", F.coalesce("claimed", F.lit(0)).cast("int"), F.coalesce("slot_limit", F.lit(0)).cast("int"))
    full = rows.withColumn("__full", F.when(~fits, F.struct("pool_key", part.alias("text"))))
    listed = full.groupBy("step_key").agg(F.sort_array(F.collect_list("__full"))["text"].alias("texts"))
    several = F.concat(F.lit("pools full: "), F.array_join("texts", ", "))
    one = F.concat(F.lit("pool "), F.regexp_replace(F.array_join("texts", ""), r" \((\d+/-?\d+)\)$", " full ($1)"))
    return listed.select("step_key", (F.size("texts") == 0).alias("eligible"), F.when(F.size("texts") == 1, one).when(F.size("texts") > 1, several).alias("block_reason"))


def expired_leases(slots: DataFrame, as_of: Column) -> DataFrame:
    return slots.filter(F.col("lease_expires_at") <= as_of)


def lease_class(expires: Column, as_of: Column) -> Column:
    return F.when(expires <= as_of, "lease-expired").when(expires - as_of < EXPIRING_NS, "lease-expiring").otherwise("")


def lease_text(expires: Column, as_of: Column) -> Column:
    left = expires - as_of
    whole = lambda ns: F.floor(ns / F.lit(1_000_000_000)).cast("long")
    return F.when(left > 0, F.concat(F.lit("in "), seconds_text(whole(left)))).otherwise(F.concat(F.lit("expired "), seconds_text(whole(-left)), F.lit(" ago")))


def slot_holders(slots: DataFrame, as_of: Column) -> DataFrame:
    """Who holds slots, since when and until when."""
    expires = F.col("lease_expires_at")
    return slots.select(
        "pool_key", "run_id", "slots_consumed", "claimed_at", elapsed_text(F.col("claimed_at"), as_of).alias("elapsed"),
        lease_class(expires, as_of).alias("lease_class"), lease_text(expires, as_of).alias("remaining"),
    )
