"""Automation conditions: an expression tree over facts per asset and tick, replayed as DataFrames.

A tree is evaluated over a frame with one row for each identity (an asset, or an asset and a
partition) and tick, and the facts of that tick. Stateless nodes become Columns, latches become
windows over the ticks, quantifiers over dependencies become a join with the edges and an aggregate.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from tidemark.functions.cron import Cron, tick_passed
from tidemark.operators.runs import tags_match
from tidemark.session import cut_lineage, ship_package

#: Facts without a state of their own and the column that holds each.
FACTS = {
    "in_progress": "in_progress", "execution_failed": "failed", "backfill_in_progress": "backfill_in_progress",
    "will_be_requested": "requested_this_tick", "in_latest_time_window": "in_latest_window",
}
LEAVES = (*FACTS, "missing", "newly_updated", "newly_requested", "code_version_changed", "data_version_changed", "initial_evaluation", "last_run_includes_target")


@dataclass(frozen=True)
class Node:
    label: str | None = field(default=None, kw_only=True)

    def __and__(self, other: Node) -> Node:
        return All((self, other))

    def __or__(self, other: Node) -> Node:
        return Any((self, other))

    def __invert__(self) -> Node:
        return Not(self)

    def newly_true(self) -> Node:
        return NewlyTrue(self)

    def since(self, reset: Node) -> Node:
        return Since(self, reset)

    def since_last_handled(self) -> Node:
        return SinceLastHandled(self)

    def named(self, label: str) -> Node:
        return replace(self, label=label)

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, Node):
                yield value
            elif isinstance(value, tuple):
                yield from (v for v in value if isinstance(v, Node))

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children():
            yield from child.walk()

    def swap(self, old: Node | str, new: Node) -> Node:
        """The tree with every node that equals ``old``, or has that label, replaced."""
        if self == old or (isinstance(old, str) and self.label == old):
            return new

        def inner(value: object) -> object:
            if isinstance(value, Node):
                return value.swap(old, new)
            return tuple(inner(v) for v in value) if isinstance(value, tuple) else value

        return replace(self, **{f.name: inner(getattr(self, f.name)) for f in fields(self)})

    def without(self, old: Node | str) -> Node:
        """The tree with matching operands of all-of and any-of nodes left out; one left stands for itself."""
        if isinstance(self, (All, Any)):
            kept = tuple(p.without(old) for p in self.parts if not (p == old or (isinstance(old, str) and p.label == old)))
            return kept[0] if len(kept) == 1 else replace(self, parts=kept)
        return self

    def to_dict(self) -> dict:
        def plain(value: object) -> object:
            if isinstance(value, Node):
                return value.to_dict()
            return [plain(v) for v in value] if isinstance(value, tuple) else value

        return {"node": type(self).__name__} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}

    def fingerprint(self) -> str:
        """Changes with the tree: stored state of another tree must not be used."""
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]

    def is_time_based(self) -> bool:
        return any(isinstance(n, CronTickPassed) for n in self.walk())


@dataclass(frozen=True)
class Fact(Node):
    name: str

    def __post_init__(self) -> None:
        if self.name not in LEAVES:
            raise ValueError(f"unknown fact {self.name!r}")


@dataclass(frozen=True)
class CronTickPassed(Node):
    schedule: str
    zone: str | None = None

    def __post_init__(self) -> None:
        Cron.parse(self.schedule)


@dataclass(frozen=True)
class RunTags(Node):
    """Tags of runs: ``last`` of the last run, ``any`` or ``all`` of this tick's runs."""

    which: str
    keys: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class All(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    part: Node


@dataclass(frozen=True)
class NewlyTrue(Node):
    part: Node


@dataclass(frozen=True)
class Since(Node):
    trigger: Node
    reset: Node


@dataclass(frozen=True)
class SinceLastHandled(Node):
    part: Node


@dataclass(frozen=True)
class Deps(Node):
    """A condition over the dependencies: of any (false if there are none) or of all (true if there are none)."""

    quantifier: str
    condition: Node


@dataclass(frozen=True)
class AssetMatches(Node):
    """A condition over named assets, true if any fulfils it."""

    keys: tuple[str, ...]
    condition: Node


MISSING, IN_PROGRESS, FAILED, UPDATED = (Fact(x) for x in ("missing", "in_progress", "execution_failed", "newly_updated"))
REQUESTED, WILL_BE_REQUESTED, BACKFILL, SAME_RUN = (Fact(x) for x in ("newly_requested", "will_be_requested", "backfill_in_progress", "last_run_includes_target"))


def any_deps_updated() -> Node:
    return Deps("any", (UPDATED & ~SAME_RUN) | WILL_BE_REQUESTED, label="any_deps_updated")


def any_deps_missing() -> Node:
    return Deps("any", MISSING & ~WILL_BE_REQUESTED, label="any_deps_missing")


def any_deps_in_progress() -> Node:
    return Deps("any", IN_PROGRESS, label="any_deps_in_progress")


def in_flight() -> Node:
    return IN_PROGRESS | BACKFILL


def all_deps_updated_since_cron(schedule: str, zone: str | None = None) -> Node:
    return Deps("all", UPDATED.since(CronTickPassed(schedule, zone)) | WILL_BE_REQUESTED, label="all_deps_updated_since_cron")


def eager() -> Node:
    return All(((MISSING.newly_true() | any_deps_updated()).since_last_handled(), ~any_deps_missing(), ~any_deps_in_progress(), ~in_flight(), ~FAILED))


def on_missing() -> Node:
    return All((MISSING.newly_true().since_last_handled(), ~any_deps_missing(), ~FAILED))


def on_cron(schedule: str, zone: str | None = None) -> Node:
    tick = CronTickPassed(schedule, zone)
    return All((tick.since((REQUESTED | UPDATED) & ~tick), all_deps_updated_since_cron(schedule, zone), ~in_flight()))


#: Facts and what they are where the frame lacks them.
DEFAULTS: Mapping[str, str] = {
    "last_run_id": "string", "last_timestamp": "long", "failed_timestamp": "long", "data_version": "string", "code_version": "string", "made_with_code_version": "string",
    "last_run_nodes": "array<string>", "last_run_tags": "array<struct<k:string,v:string>>", "tick_run_tags": "array<array<struct<k:string,v:string>>>",
    "handled_tick": "long", "tick_ns": "long",
}
FLAGS = ("in_progress", "failed", "backfill_in_progress", "requested_this_tick")
#: What a condition may ask of the asset whose tree it is, also where it is judged on another asset.
ROOT = ("__floor", "__prev_tick", "__prev_ns", "__handled")
#: Facts that are the same whoever asks and need no earlier tick.
PLAIN = (*FACTS, "missing", "code_version_changed")


def with_defaults(facts: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in DEFAULTS.items() if c not in facts.columns}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in facts.columns else F.lit(False) for c in FLAGS}
    return facts.withColumns({**missing, **flags, "in_latest_window": F.coalesce(F.col("in_latest_window"), F.lit(False)) if "in_latest_window" in facts.columns else F.lit(True)})


def is_plain(node: Node) -> bool:
    """Whether a condition is the same for every root and has no state: it can be judged once per asset and tick."""
    return all(isinstance(n, (All, Any, Not, RunTags)) or (isinstance(n, Fact) and n.name in PLAIN) for n in node.walk())


def quantifiers(node: Node) -> Iterator[Deps | AssetMatches]:
    """The outermost conditions over other assets in a tree."""
    if isinstance(node, (Deps, AssetMatches)):
        yield node
        return
    for child in node.children():
        yield from quantifiers(child)


def cron_passed(schedule: str, zone: str | None) -> Callable[[Column, Column], Column]:
    """Whether an occurrence lies in (previous, now]; each distinct pair of a batch is asked once."""

    @F.pandas_udf("boolean")
    def passed(previous: pd.Series, now: pd.Series) -> pd.Series:
        pairs = list(zip(previous, now, strict=True))
        known = {p: not (pd.isna(p[0]) or pd.isna(p[1])) and tick_passed(schedule, int(p[0]), int(p[1]), zone) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], dtype=bool)

    return passed


class Evaluation:
    """Evaluates trees over ``facts``: columns ``ids``, tick (long, ascending), and facts; null flags are false.

    ``ids`` begins with the column ``key``, the asset; more id columns (a partition, a location)
    make separate cells. ``edges`` (from_key, to_key, and any further id columns but ``partition``)
    are needed for conditions over dependencies.

    A condition over other assets is judged on each of them for the asset that asks (the root): what
    is newer, the previous tick and the last handling are those of the root, and latches are kept for
    each pair. An asset without facts fulfils nothing. All such conditions of a tree with the same
    assets share one join and one aggregate.
    """

    def __init__(self, facts: DataFrame, ids: Sequence[str] = ("key",), edges: DataFrame | None = None) -> None:
        self.facts, self.ids, self.edges = with_defaults(facts), list(ids), edges
        self.other = [i for i in self.ids if i != "key"]
        self._n, self._kept = 0, None

    def _name(self) -> str:
        self._n += 1
        return f"__c{self._n}"

    def _stored_facts(self) -> DataFrame:
        """The facts once computed: trees over other assets read them several times."""
        if self._kept is None:
            self._kept = cut_lineage(self.facts)
        return self._kept

    def _roots(self, trees: Sequence[Node], roots: DataFrame | None) -> DataFrame:
        """The frame of the assets that are evaluated, with what their conditions may ask of them."""
        ship_package(self.facts.sparkSession)
        frame = self._stored_facts() if any(True for t in trees for _ in quantifiers(t)) else self.facts
        if roots is not None:
            frame = frame.join(roots, [c for c in self.ids if c in roots.columns], "left_semi")
        ticks = W.partitionBy(*self.ids).orderBy("tick")
        return frame.withColumns({
            "__floor": F.greatest("last_timestamp", "failed_timestamp"), "__prev_tick": F.lag("tick").over(ticks), "__prev_ns": F.lag("tick_ns").over(ticks),
            "__handled": F.max("handled_tick").over(ticks.rowsBetween(W.unboundedPreceding, W.currentRow)),
        })

    def run(self, tree: Node, roots: DataFrame | None = None) -> DataFrame:
        """ids, tick, fired; ``roots`` (some of the id columns) restricts the assets that are evaluated."""
        frame, (fired,) = self._level(self._roots([tree], roots), [], [tree])
        return frame.select(*self.ids, "tick", fired.alias("fired"))

    def trace(self, tree: Node) -> DataFrame:
        """tick, path, node, label, n_true, n_cells: how each node of the tree came out, for display.

        The path numbers the operands from the root ('' ), as in 0.1; conditions over dependencies
        are shown as one node.
        """

        def nodes(node: Node, path: str) -> Iterator[tuple[str, Node]]:
            yield path, node
            if not isinstance(node, (Deps, AssetMatches)):
                for i, child in enumerate(node.children()):
                    yield from nodes(child, f"{path}.{i}" if path else str(i))

        listed = list(nodes(tree, ""))
        frame, columns = self._level(self._roots([tree], None), [], [n for _, n in listed])
        held = frame.select("tick", *(c.alias(f"__t{i}") for i, c in enumerate(columns)))
        counts = held.groupBy("tick").agg(F.count(F.lit(1)).alias("n_cells"), *(F.count_if(f"__t{i}").alias(f"__t{i}") for i in range(len(listed))))
        rows = F.explode(F.array(*(
            F.struct(F.lit(path).alias("path"), F.lit(n.name if isinstance(n, Fact) else type(n).__name__).alias("node"), F.lit(n.label).cast("string").alias("label"), F.col(f"__t{i}").alias("n_true"))
            for i, (path, n) in enumerate(listed)
        ))).alias("r")
        return counts.select("tick", rows, "n_cells").select("tick", "r.path", "r.node", "r.label", "r.n_true", "n_cells")

    def _level(self, frame: DataFrame, outer: list[str], nodes: Sequence[Node]) -> tuple[DataFrame, list[Column]]:
        """Evaluate trees over one frame; ``outer`` names the assets that ask, the root first."""
        solved: dict[Node, Column] = {}
        groups: dict[object, list[Deps | AssetMatches]] = {}
        for q in dict.fromkeys(q for n in nodes for q in quantifiers(n)):
            groups.setdefault(q.keys if isinstance(q, AssetMatches) else None, []).append(q)
        for keys, group in groups.items():
            frame = self._fold(frame, outer, keys, group, solved)
        columns = []
        for node in nodes:
            frame, c = self._eval(frame, outer, node, solved)
            columns.append(c)
        return frame, columns

    def _eval(self, frame: DataFrame, outer: list[str], node: Node, solved: Mapping[Node, Column]) -> tuple[DataFrame, Column]:
        before = W.partitionBy(*outer, *self.ids).orderBy("tick")
        so_far = before.rowsBetween(W.unboundedPreceding, W.currentRow)
        if isinstance(node, (Deps, AssetMatches)):
            return frame, solved[node]
        if isinstance(node, Fact):
            return frame, self._fact(node.name, before, outer)
        if isinstance(node, CronTickPassed):
            return self._stored(frame, cron_passed(node.schedule, node.zone)(F.col("__prev_ns"), F.col("tick_ns")))
        if isinstance(node, RunTags):
            match = lambda tags: tags_match(tags, node.keys, dict(node.pairs))
            if node.which == "last":
                return frame, match(F.col("last_run_tags"))
            sets = F.col("tick_run_tags")
            holds = F.forall(sets, match) if node.which == "all" else F.exists(sets, match)
            return frame, F.coalesce((F.size(sets) > 0) & holds, F.lit(False))
        if isinstance(node, (All, Any)):
            columns = []
            for part in node.parts:
                frame, c = self._eval(frame, outer, part, solved)
                columns.append(c)
            both = Column.__and__ if isinstance(node, All) else Column.__or__
            return frame, reduce(both, columns, F.lit(isinstance(node, All)))
        if isinstance(node, Not):
            frame, c = self._eval(frame, outer, node.part, solved)
            return frame, ~c
        if isinstance(node, NewlyTrue):
            frame, c = self._stored(*self._eval(frame, outer, node.part, solved))
            return frame, c & ~self._held(node, c, before)
        if isinstance(node, Since):
            frame, on = self._stored(*self._eval(frame, outer, node.trigger, solved))
            frame, off = self._stored(*self._eval(frame, outer, node.reset, solved))
            return self._latched(frame, node, on, off, so_far)
        if isinstance(node, SinceLastHandled):
            frame, c = self._eval(frame, outer, node.part, solved)
            return frame, c & (F.col("__handled").isNull() | F.coalesce(F.col("__handled") < F.col("__prev_tick"), F.lit(True)))
        raise TypeError(f"no rule for {type(node).__name__}")

    def _was(self, column: str, before: WindowSpec) -> Column:
        """The value of a fact at the tick before."""
        return F.lag(column).over(before)

    def _held(self, node: Node, now: Column, before: WindowSpec) -> Column:
        """Whether a part held at the tick before."""
        return F.coalesce(F.lag(now).over(before), F.lit(False))

    def _latched(self, frame: DataFrame, node: Node, on: Column, off: Column, so_far: WindowSpec) -> tuple[DataFrame, Column]:
        last = lambda c: F.coalesce(F.max(F.when(c, F.col("tick"))).over(so_far), F.lit(-(1 << 62)))
        return frame, last(on) > last(off)

    def _stored(self, frame: DataFrame, c: Column) -> tuple[DataFrame, Column]:
        """Keep a result as a column, so that windows over it don't nest."""
        name = self._name()
        return frame.withColumn(name, c), F.col(name)

    def _fact(self, name: str, before: WindowSpec, outer: Sequence[str]) -> Column:
        now = F.col("last_timestamp")
        other = F.col("key") != F.col(outer[0]) if outer else F.lit(False)  # judged for another asset, the root
        initial = F.col("__prev_tick").isNull()
        if name in FACTS:
            return F.col(FACTS[name])
        if name == "missing":
            return F.col("last_run_id").isNull()
        if name == "initial_evaluation":
            return initial
        if name == "newly_requested":
            return F.coalesce(F.col("handled_tick") == self._was("tick", before), F.lit(False))
        if name == "last_run_includes_target":
            return other & F.coalesce(F.array_contains("last_run_nodes", F.col(outer[0])), F.lit(False)) if outer else F.lit(False)
        if name == "code_version_changed":
            return F.col("code_version").isNotNull() & ~F.col("code_version").eqNullSafe(F.col("made_with_code_version"))
        earlier = self._was("last_timestamp", before)
        if name == "data_version_changed":
            was = self._was("data_version", before)
            changed = F.when(was.isNotNull(), F.col("data_version") != was).otherwise(~initial & ~earlier.eqNullSafe(now))
            return F.col("data_version").isNotNull() & changed
        own = F.coalesce(F.when(earlier.isNotNull(), now > earlier).otherwise(now.isNotNull() & ~initial), F.lit(False))
        # Another asset against the last attempt at the root: never attempted counts as older.
        newer = F.coalesce(now.isNotNull() & (F.col("__floor").isNull() | (now > F.col("__floor"))), F.lit(False))
        return F.when(other, newer).otherwise(own) if outer else own

    def _fold(self, frame: DataFrame, outer: list[str], keys: tuple[str, ...] | None, group: Sequence[Deps | AssetMatches], solved: dict[Node, Column]) -> DataFrame:
        """Judge the conditions of ``group`` on the named assets, or on the dependencies without ``keys``.

        The identities are false for any and true for all.
        """
        asks, other = f"__asks{len(outer)}", self.other
        facts, names = self._stored_facts(), [self._name() for _ in group]
        plain = all(is_plain(q.condition) for q in group)
        if keys is None and self.edges is None:
            raise ValueError("conditions over dependencies need edges")
        shared = [c for c in other if keys is None and c in self.edges.columns]
        pairs = None if keys is not None else self.edges.select(F.col("from_key").alias(asks), F.col("to_key").alias("key"), *shared).distinct()
        judged = facts.filter(F.col("key").isin(list(keys))) if keys is not None else facts
        if plain:
            judged, columns = self._level(judged, [], [q.condition for q in group])
            judged = judged.select(*self.ids, "tick", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
        if pairs is not None:
            judged = judged.join(pairs, ["key", *shared])
        by = [*([] if keys is not None else [asks]), *other, "tick"]
        if not plain:
            ask = frame.select(*outer, F.col("key").alias(asks), *other, "tick", *ROOT)
            judged, columns = self._level(judged.join(ask, by), [*outer, asks], [q.condition for q in group])
            by = [*outer, asks, *other, "tick"]
            judged = judged.select(*by, *(c.alias(n) for c, n in zip(columns, names, strict=True)))
        universal = [isinstance(q, Deps) and q.quantifier == "all" for q in group]
        seen = self._name()
        folded = judged.groupBy(*by).agg(F.count(F.lit(1)).alias(seen), *((F.bool_and if u else F.bool_or)(n).alias(n) for n, u in zip(names, universal, strict=True)))
        frame = frame.join(folded.withColumnRenamed(asks, "key"), ["key" if c == asks else c for c in by], "left")
        if any(universal):  # a dependency without facts fulfils nothing
            wanted = self._name()
            frame = frame.join(pairs.groupBy(F.col(asks).alias("key"), *shared).agg(F.count(F.lit(1)).alias(wanted)), ["key", *shared], "left")
            whole = F.coalesce(wanted, F.lit(0)) == F.coalesce(seen, F.lit(0))
        for q, name, u in zip(group, names, universal, strict=True):
            solved[q] = whole & F.coalesce(F.col(name), F.lit(True)) if u else F.coalesce(F.col(name), F.lit(False))
        return frame


def evaluate_in_order(facts: DataFrame, edges: DataFrame, levels: DataFrame, tree: Node, ids: Sequence[str] = ("key",)) -> DataFrame:
    """Evaluate level by level, so that a node sees which of its dependencies will be requested in the same tick.

    ``levels`` (key, any further id columns, level) is the topological order; there is one round for
    each level, which evaluates the assets of that level alone.
    """
    levels, facts = cut_lineage(levels), cut_lineage(facts)
    top = levels.agg(F.max("level")).first()[0]
    done: DataFrame | None = None
    for level in range((top if top is not None else -1) + 1):
        frame = facts
        if done is not None:
            frame = facts.drop("requested_this_tick").join(done.filter("fired").select(*ids, "tick", F.lit(True).alias("requested_this_tick")), [*ids, "tick"], "left")
        fired = Evaluation(frame, ids, edges).run(tree, levels.filter(F.col("level") == level).drop("level"))
        done = cut_lineage(fired if done is None else done.unionByName(fired))
    return done if done is not None else Evaluation(facts, ids, edges).run(tree).filter(F.lit(False))


def floor_over(mapped: DataFrame, attempted_only: bool = False) -> DataFrame:
    """Per dependency key (dep_key) the least of its targets' attempt times (at).

    A target never attempted makes the floor null, as it has to be built; with ``attempted_only``
    such targets don't count.
    """
    least = F.min("at")
    return mapped.groupBy("dep_key").agg((least if attempted_only else F.when(F.count("at") == F.count(F.lit(1)), least)).alias("floor"))
