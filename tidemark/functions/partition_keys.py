"""Partition keys in display form: ``a``, ``a,b``, ``date=2024-01-01|region=eu,us``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a key can't hold, as the display form uses them.
RESERVED = ("|", ",")


def is_multi(display: Column) -> Column:
    return F.contains(display, F.lit("="))


def dimensions(display: Column) -> Column:
    """The dimensions of a multi key as array<struct<dim, values>>, sorted by name; a single key has one, ''."""
    parts = F.transform(
        F.split(display, r"\|"),
        lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("dim"), F.split(F.substring_index(p, "=", -1), ",").alias("values")),
    )
    single = F.array(F.struct(F.lit("").alias("dim"), F.split(display, ",").alias("values")))
    return F.when(is_multi(display), F.array_sort(parts)).otherwise(single)


def to_display(dims: Column) -> Column:
    """The display form of array<struct<dim, values>>, dimensions in order of name."""
    part = lambda d: F.when(d["dim"] == "", F.concat_ws(",", d["values"])).otherwise(F.concat(d["dim"], F.lit("="), F.concat_ws(",", d["values"])))
    return F.concat_ws("|", F.transform(F.array_sort(dims), part))


def member_count(display: Column) -> Column:
    """How many concrete keys a batch key stands for: the product over its dimensions."""
    return F.aggregate(dimensions(display), F.lit(1).cast("long"), lambda n, d: n * F.size(d["values"]))


def display_members(display: Column) -> Column:
    """The concrete keys of a batch key in display form: the product of its dimensions' values."""

    def extend(done: Column, d: Column) -> Column:
        named = F.transform(d["values"], lambda v: F.when(d["dim"] == "", v).otherwise(F.concat(d["dim"], F.lit("="), v)))
        return F.when(F.size(done) == 0, named).otherwise(F.flatten(F.transform(done, lambda a: F.transform(named, lambda b: F.concat(a, F.lit("|"), b)))))

    return F.aggregate(dimensions(display), F.array().cast("array<string>"), extend)


def members_preview(display: Column, limit: int) -> Column:
    """The first ``limit`` concrete keys of a batch key; no more than ``limit`` are built at any step."""

    def extend(done: Column, d: Column) -> Column:
        named = F.transform(F.slice(d["values"], 1, limit), lambda v: F.when(d["dim"] == "", v).otherwise(F.concat(d["dim"], F.lit("="), v)))
        longer = F.flatten(F.transform(done, lambda a: F.transform(named, lambda b: F.concat(a, F.lit("|"), b))))
        return F.slice(F.when(F.size(done) == 0, named).otherwise(longer), 1, limit)

    none = F.array().cast("array<string>")
    return F.aggregate(dimensions(display), none, extend) if limit > 0 else none


def dimension_value(display: Column, name: str) -> Column:
    """The first value of a dimension of a multi key; null if it has none of that name."""
    found = F.filter(dimensions(display), lambda d: d["dim"] == name)
    return F.try_element_at(F.try_element_at(found, F.lit(1))["values"], F.lit(1))


def key_json(display: Column) -> Column:
    """The JSON form: {"single":[...]} or {"multi":{dim:[...]}}."""
    multi = F.concat(F.lit('{"multi":'), F.to_json(F.map_from_entries(dimensions(display))), F.lit("}"))
    single = F.to_json(F.struct(F.split(display, ",").alias("single")))
    return F.when(is_multi(display), multi).otherwise(single)


def is_valid_key(key: Column) -> Column:
    """Not null, not empty and without reserved characters."""
    bad = key.rlike(r"[|,]")
    return F.coalesce((F.length(key) > 0) & ~bad, F.lit(False))


def path_suffix(display: Column) -> Column:
    """The Hive-style folder of a key: dim=value/dim=value, or key=value for a single key."""
    part = lambda d: F.concat(F.when(d["dim"] == "", "key").otherwise(d["dim"]), F.lit("="), F.concat_ws(",", d["values"]))
    return F.concat_ws("/", F.transform(dimensions(display), part))
