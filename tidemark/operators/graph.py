"""Dependency graphs as edge tables: closure, cycles, levels, plans and staleness.

An edge (from_key, to_key) says that ``from_key`` depends on ``to_key``. A graph of at most
``LOCAL_EDGES`` edges (counted first) is walked in memory, in time linear in its edges. A larger one
is walked in rounds: each joins only what the round before found and stores only what is new, so
plans stay short, cycles end and lost executors cost nothing. A walk that needs more than
``MAX_ROUNDS`` rounds is an error, never a part of the answer.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import cut_lineage

PAIR = ["from_key", "to_key"]
MAX_ROUNDS = 10_000
#: Edges that are walked in memory at most (some 40 MB of keys).
LOCAL_EDGES = 200_000
#: Stored rounds after which they are put together, so that a deep graph doesn't make a wide union.
COMPACT_AFTER = 16


def tidy_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between two named nodes."""
    return edges.select(*PAIR).filter("from_key IS NOT NULL AND to_key IS NOT NULL").distinct()


def small_graph(edges: DataFrame) -> list[tuple] | None:
    """The edges of a stored edge table if they are few enough to be walked in memory, else None."""
    return [tuple(r) for r in edges.collect()] if edges.count() <= LOCAL_EDGES else None


class Rounds:
    """What the rounds of a walk found, each stored once."""

    def __init__(self, first: DataFrame) -> None:
        self.parts = [cut_lineage(first)]

    @property
    def last(self) -> DataFrame:
        return self.parts[-1]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, found: DataFrame) -> None:
        if len(self.parts) > COMPACT_AFTER:
            self.parts = [cut_lineage(reduce(DataFrame.unionByName, self.parts[:-1])), self.last]
        self.parts.append(cut_lineage(found))

    def __iter__(self) -> Iterator[int]:
        """Numbers of rounds from 1, as long as the last one found something."""
        for number in range(1, MAX_ROUNDS + 1):
            if self.last.isEmpty():
                return
            yield number
        if not self.last.isEmpty():
            raise RuntimeError(f"the graph isn't walked after {MAX_ROUNDS} rounds")


def reachable_pairs(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(from_key, to_key, depth): all nodes a node depends on, directly or not, by the shortest way.

    ``start`` (a column from_key) restricts the nodes one starts from. A node on a cycle reaches
    itself. Pairs are quadratic in the worst case: give ``start`` for anything but small graphs.
    """
    step = cut_lineage(tidy_edges(edges))
    first = step if start is None else step.join(start.select("from_key").distinct(), "from_key", "left_semi")
    seen = Rounds(first.withColumn("depth", F.lit(1)))
    hop = step.select(F.col("from_key").alias("to_key"), F.col("to_key").alias("__next"))
    for depth in seen:
        found = seen.last.join(hop, "to_key").select("from_key", F.col("__next").alias("to_key")).distinct()
        seen.add(found.join(seen.all().select(*PAIR), PAIR, "left_anti").withColumn("depth", F.lit(depth + 1)))
    return seen.all()


def closure(edges: DataFrame, targets: DataFrame, downstream: bool = False, include_targets: bool = False) -> DataFrame:
    """The nodes reached from a set of targets (column ``key``), as one set.

    Upstream by default. The targets themselves are left out unless they are asked for; a target
    reached from another one is then left out too. Beyond ``LOCAL_EDGES`` a round reads the edges and
    the keys found so far, and writes only new ones.
    """
    here, there = ("to_key", "from_key") if downstream else ("from_key", "to_key")
    stored = cut_lineage(tidy_edges(edges))
    starts = targets.select("key").filter("key IS NOT NULL").distinct()
    if (pairs := small_graph(stored)) is not None:
        ends = stored.select(F.col(here).alias("key")).distinct()
        begun = [r[0] for r in starts.join(ends, "key", "left_semi").collect()]  # at most the nodes of the small graph
        reached = walk(((t, f) for f, t in pairs) if downstream else pairs, begun)
        found = stored.sparkSession.createDataFrame([(k,) for k in reached], starts.schema)
        seen = found.unionByName(starts).distinct()
    else:
        hop = stored.select(F.col(here).alias("key"), F.col(there).alias("__next"))
        rounds = Rounds(starts)
        for _ in rounds:
            found = rounds.last.join(hop, "key").select(F.col("__next").alias("key")).distinct()
            rounds.add(found.join(rounds.all(), "key", "left_anti"))
        seen = rounds.all()
    return seen if include_targets else seen.join(starts, "key", "left_anti")


def walk(pairs: Iterable[tuple], starts: Iterable) -> set:
    """The nodes reached from some nodes along (from, to) pairs, the starts only if they are reached."""
    following = defaultdict(list)
    for a, b in pairs:
        following[a].append(b)
    seen: set = set()
    queue = deque(starts)
    while queue:
        for b in following[queue.popleft()]:
            if b not in seen:
                seen.add(b)
                queue.append(b)
    return seen


def levels_of(pairs: Iterable[tuple]) -> dict:
    """The level of each node of (node, dependency) pairs; nodes on a cycle or behind one have none."""
    waiting, users = defaultdict(int), defaultdict(list)
    for a, b in pairs:
        waiting[a] += 1
        waiting[b] += 0
        users[b].append(a)
    level = {k: 0 for k, n in waiting.items() if not n}
    queue = deque(level)
    while queue:
        at = queue.popleft()
        for user in users[at]:
            waiting[user] -= 1
            if not waiting[user]:
                level[user] = level[at] + 1
                queue.append(user)
    return level


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level): 0 without dependencies, else one above the highest dependency.

    Nodes on a cycle, and those that depend on one, have no level and no row. Dependencies that are
    no node don't count. In rounds, a node is settled as soon as all it depends on is: each round
    stores the nodes still open, with the number of their open dependencies.
    """
    keys = nodes.select("key").distinct()
    among = tidy_edges(edges).join(keys.withColumnRenamed("key", "from_key"), "from_key", "left_semi").join(keys.withColumnRenamed("key", "to_key"), "to_key", "left_semi")
    among = cut_lineage(among.select(*PAIR))
    if (pairs := small_graph(among)) is not None:
        found = levels_of(pairs)
        rows = [(k, found.get(k)) for k in {x for pair in pairs for x in pair}]
        settled = among.sparkSession.createDataFrame(rows, StructType([*keys.schema.fields, StructField("__level", IntegerType())])).withColumn("__edge", F.lit(True))
        return keys.join(settled, "key", "left").filter("__edge IS NULL OR __level IS NOT NULL").select("key", F.coalesce("__level", F.lit(0)).alias("level"))
    counts = among.groupBy(F.col("from_key").alias("key")).agg(F.count(F.lit(1)).alias("__open"))
    waiting = cut_lineage(keys.join(counts, "key", "left").fillna(0, "__open"))
    settled = Rounds(waiting.filter("__open = 0").select("key", F.lit(0).alias("level")))
    waiting = waiting.filter("__open > 0")
    for level in settled:
        told = among.join(settled.last.select(F.col("key").alias("to_key")), "to_key", "left_semi").groupBy(F.col("from_key").alias("key")).agg(F.count(F.lit(1)).alias("__told"))
        waiting = cut_lineage(waiting.join(told, "key", "left").select("key", (F.col("__open") - F.coalesce("__told", F.lit(0))).alias("__open")))
        settled.add(waiting.filter("__open = 0").select("key", F.lit(level).alias("level")))
        waiting = waiting.filter("__open > 0")
    return settled.all()


def on_cycles(pairs: Iterable[tuple]) -> set:
    """The nodes that lie on a cycle: those of strongly connected components of two nodes or more, and self loops."""
    ahead, back, loops = defaultdict(list), defaultdict(list), set()
    for a, b in pairs:
        ahead[a].append(b)
        back[b].append(a)
        if a == b:
            loops.add(a)
    # Nodes in the order in which a depth-first walk leaves them; components are then found against the edges.
    left: list = []
    seen: set = set()
    for start in list(ahead):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead[start]))]
        while stack:
            at, rest = stack[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    stack.append((b, iter(ahead[b])))
                    break
            else:
                left.append(at)
                stack.pop()
    taken: set = set()
    found = set(loops)
    for start in reversed(left):
        if start in taken:
            continue
        component, queue = [start], deque([start])
        taken.add(start)
        while queue:
            for a in back[queue.popleft()]:
                if a not in taken:
                    taken.add(a)
                    component.append(a)
                    queue.append(a)
        if len(component) > 1:
            found.update(component)
    return found


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle.

    Beyond ``LOCAL_EDGES``, peel off what has no open dependency and what nothing open depends on, then
    keep those of the rest that reach themselves.
    """
    inner = cut_lineage(tidy_edges(edges))
    known = nodes.select("key").distinct()
    if (pairs := small_graph(inner)) is not None:
        found = inner.sparkSession.createDataFrame([(k,) for k in on_cycles(pairs)], known.schema)
        return found.join(known, "key", "left_semi")
    size = inner.count()
    for _ in range(MAX_ROUNDS):
        kept = inner.join(inner.select(F.col("from_key").alias("to_key")).distinct(), "to_key", "left_semi").join(inner.select(F.col("to_key").alias("from_key")).distinct(), "from_key", "left_semi")
        inner = cut_lineage(kept.select(*PAIR))
        before, size = size, inner.count()
        if size == before:
            break
    else:
        raise RuntimeError(f"the graph isn't peeled after {MAX_ROUNDS} rounds")
    return reachable_pairs(inner).filter("from_key = to_key").select(F.col("from_key").alias("key")).distinct().join(known, "key", "left_semi")


def sort_items(dependencies: dict) -> list:
    """Any items in an order in which each comes after all it depends on, ties as given.

    A dependency that is no item is left out of account; a cycle is an error that names its members.
    """
    among = {item: [d for d in needs if d in dependencies] for item, needs in dependencies.items()}
    level = {k: 0 for k, needs in among.items() if not needs} | levels_of([(k, d) for k, needs in among.items() for d in set(needs)])
    if stuck := [k for k in among if k not in level]:
        members = on_cycles([(k, d) for k in stuck for d in among[k]])
        raise ValueError(f"cycle among {sorted(map(str, members))}")
    return sorted(among, key=level.__getitem__)


def unresolved_inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to a name that is no node, or to the node itself."""
    named = edges.select(*PAIR).distinct()
    missing = named.join(nodes.select(F.col("key").alias("to_key")), "to_key", "left_anti").withColumn("problem", F.lit("unresolved"))
    return missing.select(*PAIR, "problem").unionByName(named.filter("from_key = to_key").withColumn("problem", F.lit("self")))


def missing_dependencies(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Edges out of a selection of nodes: what a subgraph lacks."""
    chosen = selection.select("key").distinct()
    return tidy_edges(edges).join(chosen.withColumnRenamed("key", "from_key"), "from_key", "left_semi").join(chosen.withColumnRenamed("key", "to_key"), "to_key", "left_anti").select(*PAIR)


def grouped_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between steps when nodes (key) are grouped into steps (step): those within a step go away."""
    a, b = (groups.select(F.col("key").alias(c), F.col("step").alias(s)) for c, s in (("from_key", "from_step"), ("to_key", "to_step")))
    return tidy_edges(edges).join(a, "from_key").join(b, "to_key").filter("from_step <> to_step").select("from_step", "to_step").distinct()


def staleness(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, status): Missing without a data version, Stale with a cause of its own or from upstream, else UpToDate.

    ``records`` has key, data_version, code_version, made_with_code_version and consumed (pairs k, v).
    Own causes: the code version changed, an input has a version other than the consumed one or was
    never consumed. Missing and stale nodes make what depends on them stale. On an acyclic graph
    this is exact; nodes on a cycle or behind one see only their own code version.
    """
    causes = stale_causes(records, edges)
    stale = causes.select("key").distinct().withColumn("__stale", F.lit(True))
    status = F.when(F.col("data_version").isNull(), "Missing").when(F.col("__stale"), "Stale").otherwise("UpToDate")
    return records.join(stale, "key", "left").select("key", status.alias("status"))


def direct_causes(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, category, dependency, reason): what makes a node stale by itself, its code or a version of an input."""
    live = records.filter(F.col("data_version").isNotNull())
    code = live.filter(F.col("code_version").isNotNull() & ~F.col("code_version").eqNullSafe(F.col("made_with_code_version"))).select(
        "key", F.lit("code").alias("category"), F.lit(None).cast("string").alias("dependency"), F.lit("code version changed").alias("reason")
    )
    against = (
        edges.join(live.select(F.col("key").alias("from_key"), "consumed"), "from_key")
        .join(records.filter(F.col("data_version").isNotNull()).select(F.col("key").alias("to_key"), F.col("data_version").alias("__now")), "to_key")
        .withColumn("__used", F.try_element_at(F.filter("consumed", lambda p: p["k"] == F.col("to_key")), F.lit(-1))["v"])
    )
    text = F.when(F.col("__used").isNull(), F.format_string("upstream '%s' has data not yet consumed", "to_key")).otherwise(F.format_string("upstream '%s' has new data version", "to_key"))
    data = against.filter(~F.col("__used").eqNullSafe(F.col("__now")))
    return code.unionByName(data.select(F.col("from_key").alias("key"), F.lit("data").alias("category"), F.col("to_key").alias("dependency"), text.alias("reason")))


def stale_causes(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, category, dependency, reason): the direct causes of every stale node, and those from upstream.

    A small graph is collected once for both walks, its order and the spread of staleness.
    """
    records = cut_lineage(records)
    spark, known = records.sparkSession, records.select("key")
    missing = records.filter("data_version IS NULL").select("key")
    live = records.filter(F.col("data_version").isNotNull())
    edges = tidy_edges(edges).join(known.withColumnRenamed("key", "from_key"), "from_key", "left_semi").join(known.withColumnRenamed("key", "to_key"), "to_key", "left_semi")
    edges = cut_lineage(edges.select(*PAIR))
    if (pairs := small_graph(edges)) is not None:
        level = levels_of(pairs)
        moves = [p for p in pairs if p[0] in level]
        in_order = spark.createDataFrame(moves, edges.schema)
        direct = cut_lineage(direct_causes(records, in_order))
        inputs = in_order.select(F.col("to_key").alias("key")).distinct()
        begun = {r[0] for r in direct.select("key").unionByName(missing).join(inputs, "key", "left_semi").collect()}  # nodes of the small graph
        bad = walk(((t, f) for f, t in moves), begun) | begun
        tainted = spark.createDataFrame([(k,) for k in bad], known.schema)
    else:
        ordered = topological_levels(records, edges).select(F.col("key").alias("from_key"))
        in_order = cut_lineage(edges.join(ordered, "from_key", "left_semi").select(*PAIR))
        direct = cut_lineage(direct_causes(records, in_order))
        tainted = closure(in_order, direct.select("key").unionByName(missing), downstream=True, include_targets=True)
    # Staleness spreads downstream over nodes that have data; a missing node in between spreads it as well.
    inherited = in_order.join(tainted.withColumnRenamed("key", "to_key"), "to_key", "left_semi").join(live.select(F.col("key").alias("from_key")), "from_key", "left_semi")
    above = inherited.select(F.col("from_key").alias("key"), F.lit("data").alias("category"), F.col("to_key").alias("dependency"), F.format_string("upstream '%s' is stale", "to_key").alias("reason"))
    # An input that is itself stale is the cause, whatever its version.
    own = direct.filter("category = 'code'")
    versions = direct.filter("category = 'data'").join(above.select("key", "dependency"), ["key", "dependency"], "left_anti")
    columns = ["key", "category", "dependency", "reason"]
    return own.select(*columns).unionByName(versions.select(*columns)).unionByName(above.select(*columns))
