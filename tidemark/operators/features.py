"""One row per entity from its events: counts, recency and totals by event type."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most event types that a pivot takes; a longer list is an error, never cut.
MAX_TYPES = 2_000
MOST = (1 << 63) - 1


def digits_total(pairs: Column, key: str = "rows") -> Column:
    """Sum of the values under ``key`` in a list of (k, v) pairs that are digits 0-9 only.

    Other values count as 0, as does a null or empty list. A value or sum beyond int64 is its largest number.
    """
    wanted = F.filter(pairs, lambda p: (p["k"] == key) & p["v"].rlike(r"\A[0-9]+\z"))
    return F.coalesce(F.aggregate(wanted, F.lit(0).cast("long"), lambda acc, p: F.coalesce(F.try_add(acc, F.coalesce(p["v"].try_cast("long"), F.lit(MOST))), F.lit(MOST))), F.lit(0).cast("long"))


def activity_by_type(
    events: DataFrame,
    entity: Sequence[str] = ("code_location_id", "asset_key"),
    event_type: str = "event_type",
    timestamp: str = "timestamp",
    total: Column | None = None,
    event_id: str = "event_id",
) -> DataFrame:
    """The compact long table: one row per entity and event type that occurs for it.

    Columns: entity, event_type, n_events, last_timestamp, total_rows. Rows sharing an event id are
    copies and count once. Totals beyond int64 are its largest number. Entities with a null part and null types are left out. An empty input
    gives no rows. Partial counts are formed before the shuffle, so a hot entity costs one row per
    task.
    """
    total = total if total is not None else digits_total(F.col("metadata"))
    rows = events.filter(F.col(event_type).isNotNull())
    for part in entity:
        rows = rows.filter(F.col(part).isNotNull())
    distinct = rows.select(event_id, *entity, F.col(event_type).alias("event_type"), F.col(timestamp).alias("__at"), total.alias("__total")).distinct()
    return distinct.groupBy(*entity, "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("__at").alias("last_timestamp"), F.coalesce(F.try_sum("__total"), F.when(F.count("__total") > 0, F.lit(MOST))).alias("total_rows")
    )


def event_types(long: DataFrame) -> list[str]:
    """The event types of a long table in order; more than ``MAX_TYPES`` are an error."""
    found = [r[0] for r in long.select("event_type").distinct().orderBy("event_type").limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types: give the list of those wanted")
    return found


def feature_names(types: Sequence[str]) -> list[str]:
    """The types as parts of column names, each once."""
    names: list[str] = []
    for t in types:
        base = name = re.sub(r"\W", "_", t).lower()
        while name in names:
            name = f"{base}_{len(names)}"
        names.append(name)
    return names


def feature_table(long: DataFrame, types: Sequence[str], as_of: Column, entity: Sequence[str] = ("code_location_id", "asset_key")) -> DataFrame:
    """Pivot the long table with an explicit list of types, one row per entity.

    For each type: ``<type>_n`` (0 if none), ``<type>_age_s`` (seconds from its last event to
    ``as_of``, int64 ns; null if none) and ``<type>_rows`` (0 if none); characters other than
    letters, digits and _ become _ in names, and a name that would clash gets a number. Types
    outside the list are not in the result. With no types only the entities remain.
    """
    if len(types) > MAX_TYPES:
        raise ValueError(f"{len(types)} types; at most {MAX_TYPES} can be pivoted")
    names = feature_names(types)
    if not types:
        return long.select(*entity).distinct()
    n, at, rows = (F.first(c, ignorenulls=True).alias(c) for c in ("n_events", "last_timestamp", "total_rows"))
    # A column per entity part, then three for each type in the order of the list.
    wide = long.groupBy(*entity).pivot("event_type", list(types)).agg(n, at, rows)
    flat = wide.toDF(*entity, *(f"__{k}_{i}" for i in range(len(types)) for k in ("n", "at", "rows")))
    return flat.select(
        *entity,
        *(
            cell
            for i, name in enumerate(names)
            for cell in (
                F.coalesce(F.col(f"__n_{i}"), F.lit(0)).alias(f"{name}_n"),
                ((as_of - F.col(f"__at_{i}")) / F.lit(1_000_000_000)).alias(f"{name}_age_s"),
                F.coalesce(F.col(f"__rows_{i}"), F.lit(0)).alias(f"{name}_rows"),
            )
        ),
    )


def melt_features(wide: DataFrame, types: Sequence[str], entity: Sequence[str] = ("code_location_id", "asset_key")) -> DataFrame:
    """A feature table back in long form, one row per entity and type of the list: entity, event_type, n, age_s, rows."""
    cells = [F.struct(F.lit(t).alias("event_type"), *(F.col(f"`{name}_{c}`").alias(c) for c in ("n", "age_s", "rows"))) for t, name in zip(types, feature_names(types), strict=True)]
    return wide.select(*entity, F.inline(F.array(*cells)))
