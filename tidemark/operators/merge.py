"""MERGE over plain DataFrames: one null-safe full outer join, then a CASE over the clauses.

The clauses of a row apply in a fixed order of kinds, the first that matches wins: matched update,
matched update-all, matched delete; insert, insert-all; delete and update of rows the source lacks.
Predicates and expressions name the source ``s`` and the target ``t``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kind = Literal["update", "update_all", "delete", "insert", "insert_all", "source_delete", "source_update"]
MATCHED: tuple[Kind, ...] = ("update", "update_all", "delete")
ABSENT: tuple[Kind, ...] = ("insert", "insert_all")
ORPHANED: tuple[Kind, ...] = ("source_delete", "source_update")


@dataclass(frozen=True)
class Clause:
    kind: Kind
    when: str | None = None
    sets: Mapping[str, str] = field(default_factory=dict)
    skip: Sequence[str] = ()


PRESETS: dict[str, tuple[Clause, ...]] = {
    "update_only": (Clause("update_all"),),
    "deduplicate_insert": (Clause("insert_all"),),
    "upsert": (Clause("update_all"), Clause("insert_all")),
    "replace_delete_unmatched": (Clause("update_all"), Clause("source_delete")),
}


class AmbiguousMerge(ValueError):
    """Several source rows match one target row."""


def check_source(source: DataFrame, keys: Sequence[str], target: DataFrame, clauses: str | Sequence[Clause]) -> None:
    """Raise if several source rows match one target row and a clause would act on it: which one wins is undefined.

    Keys that the source has twice and the target lacks are rows to insert.
    """
    if not any(c.kind in MATCHED for c in (PRESETS[clauses] if isinstance(clauses, str) else clauses)):
        return
    twice = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    there = target.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    if row := twice.join(there, same, "left_semi").limit(1).first():
        raise AmbiguousMerge(f"the source has {row['__n']} rows for {[row[k] for k in keys]}")


def joined(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = target.select(F.struct(*target.columns).alias("t"))
    s = source.select(F.struct(*source.columns).alias("s"))
    on = reduce(Column.__and__, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    return t.join(s, on, "full_outer")


def _actions(clauses: Sequence[Clause]) -> tuple[Column, list[Clause]]:
    """The number of the clause that applies to a joined row, or null; and the clauses in order."""
    ordered = [c for kinds in (MATCHED, ABSENT, ORPHANED) for kind in kinds for c in clauses if c.kind == kind]
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    side = {**dict.fromkeys(MATCHED, has_t & has_s), **dict.fromkeys(ABSENT, ~has_t & has_s), **dict.fromkeys(ORPHANED, has_t & ~has_s)}
    number = F.lit(None).cast("int")
    for i in reversed(range(len(ordered))):
        c = ordered[i]
        holds = side[c.kind] & (F.expr(c.when) if c.when else F.lit(True))
        number = F.when(holds, F.lit(i)).otherwise(number)
    return number, ordered


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: str | Sequence[Clause], check: bool = True) -> DataFrame:
    """The target after the merge, with the target's columns.

    A null key matches a null key. Source columns that the target lacks are ignored; those it
    has and the source lacks keep their value on update-all and are null on insert-all.
    """
    if check:
        check_source(source, keys, target, clauses)
    number, ordered = _actions(PRESETS[clauses] if isinstance(clauses, str) else clauses)
    rows = joined(target, source, keys).withColumn("__do", number)

    def value(column: str) -> Column:
        out = F.col(f"t.{column}")
        kind = target.schema[column].dataType
        for i, c in enumerate(ordered):
            if c.kind in ("update", "source_update", "insert"):
                unset = F.col(f"t.{column}") if c.kind != "insert" else F.lit(None)
                new = F.expr(c.sets[column]) if column in c.sets else unset
            elif c.kind in ("update_all", "insert_all"):
                unset = F.col(f"t.{column}") if c.kind == "update_all" else F.lit(None)
                new = F.col(f"s.{column}") if column in source.columns and column not in c.skip else unset
            else:
                continue
            out = F.when(F.col("__do") == i, new.cast(kind)).otherwise(out)
        return out.alias(column)

    removed = [i for i, c in enumerate(ordered) if c.kind in ("delete", "source_delete")]
    inserted = [i for i, c in enumerate(ordered) if c.kind in ABSENT]
    kept = F.when(F.col("__do").isNull(), F.col("t").isNotNull()).otherwise(~F.col("__do").isin(removed) if removed else F.lit(True))
    if not inserted:
        kept = kept & F.col("t").isNotNull()
    return rows.filter(kept).select(*(value(c) for c in target.columns))


def merge_stats(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: str | Sequence[Clause]) -> DataFrame:
    """One row: how many rows the merge inserts, updates, deletes and copies."""
    number, ordered = _actions(PRESETS[clauses] if isinstance(clauses, str) else clauses)
    kinds = F.lit(None).cast("string")
    for i, c in enumerate(ordered):
        name = "inserted" if c.kind in ABSENT else "deleted" if c.kind.endswith("delete") else "updated"
        kinds = F.when(F.col("__do") == i, name).otherwise(kinds)
    rows = joined(target, source, keys).withColumn("__do", number).select(F.coalesce(kinds, F.when(F.col("t").isNotNull(), "copied")).alias("kind"))
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("inserted", "updated", "deleted", "copied")))


def replace_where(target: DataFrame, source: DataFrame, predicate: Column, check: bool = True) -> DataFrame:
    """The target with the rows of a predicate replaced by the source's; the source must lie within it.

    Rows for which the predicate is null stay.
    """
    if check and not source.filter(~F.coalesce(predicate, F.lit(False))).isEmpty():
        raise ValueError("the source has rows outside the part that it replaces")
    return target.filter(~F.coalesce(predicate, F.lit(False))).unionByName(source, allowMissingColumns=True)


def partition_overwrite(target: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The target with every partition that the source touches replaced by the source's rows."""
    touched = source.select(*(F.col(c).alias(f"__{c}") for c in columns)).distinct()
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return target.join(touched, on, "left_anti").unionByName(source)
