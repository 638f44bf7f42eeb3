"""Conditions evaluated tick by tick, with the state between ticks in tables.

A tick has two phases. ``begin`` evaluates the tree on the facts of the tick and stores what fired
and the state that would follow, as an intent. ``finish`` takes the state over once the requests have
been sent: an asset whose request failed keeps its old state, so its condition fires again. After a
crash between the two, ``recover`` gives the intent, and nothing is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.conditions import AssetMatches, Deps, Evaluation, NewlyTrue, Node, Since
from tidemark.session import cut_lineage, ship_package
from tidemark.sources.versioned import TableSet

#: Facts that a tick remembers for the next.
REMEMBERED = {"tick": "long", "tick_ns": "long", "last_timestamp": "long", "data_version": "string", "handled_tick": "long"}


def _stateful(nodes: Sequence[Node]) -> bool:
    """Whether trees have latches of their own, outside conditions over other assets."""
    return any(
        isinstance(n, (NewlyTrue, Since)) or (not isinstance(n, (Deps, AssetMatches)) and _stateful(list(n.children()))) for n in nodes
    )


class TickEvaluation(Evaluation):
    """Evaluates one tick: earlier facts and latches come from tables in place of windows.

    A latch belongs to the assets that ask (``asks``, the root first), the asset that is judged and the
    node, which its fingerprint names; ``latches`` collects those that the tick leaves behind.
    """

    def __init__(self, facts: DataFrame, memory: DataFrame, latches: DataFrame, ids: Sequence[str], edges: DataFrame | None) -> None:
        was = memory.select(*ids, *(F.col(c).alias(f"__was_{c}") for c in REMEMBERED))
        super().__init__(facts.join(was, list(ids), "left"), ids, edges)
        self.before, self.latches = latches, list[DataFrame]()
        self._new: dict[str, Column] = {}

    def _roots(self, trees: Sequence[Node], roots: DataFrame | None) -> DataFrame:
        ship_package(self.facts.sparkSession)
        frame = self._stored_facts()
        return frame.withColumns({
            "__floor": F.greatest("last_timestamp", "failed_timestamp"), "__prev_tick": F.col("__was_tick"), "__prev_ns": F.col("__was_tick_ns"), "__handled": F.col("handled_tick"),
        })

    def _level(self, frame: DataFrame, outer: list[str], nodes: Sequence[Node]) -> tuple[DataFrame, list[Column]]:
        if not _stateful(nodes):
            return super()._level(frame, outer, nodes)
        held = self.before.filter(F.size("asks") == len(outer)).select(*(F.col("asks")[i].alias(o) for i, o in enumerate(outer)), *self.ids, F.col("latches").alias("__held"))
        outside, self._new = self._new, {}
        frame, columns = super()._level(frame.join(held, [*outer, *self.ids], "left"), outer, nodes)
        new, self._new = self._new, outside
        frame = cut_lineage(frame.withColumn("__new", F.map_from_arrays(F.array(*map(F.lit, new)), F.array(*new.values()))))
        asks = F.array(*(F.col(o) for o in outer)).cast("array<string>")
        self.latches.append(frame.select(asks.alias("asks"), *self.ids, F.col("__new").alias("latches")))
        return frame, columns

    def _was(self, column: str, before: WindowSpec) -> Column:
        return F.when(F.col("__prev_tick").isNotNull(), F.col(f"__was_{column}"))

    def _held(self, node: Node, now: Column, before: WindowSpec) -> Column:
        self._new[node.fingerprint()] = now
        return F.coalesce(F.col("__held")[node.fingerprint()], F.lit(False))

    def _latched(self, frame: DataFrame, node: Node, on: Column, off: Column, so_far: WindowSpec) -> tuple[DataFrame, Column]:
        frame, c = self._stored(frame, (F.coalesce(F.col("__held")[node.fingerprint()], F.lit(False)) | on) & ~off)
        self._new[node.fingerprint()] = c
        return frame, c


class Standing:
    """A tree that is evaluated tick by tick; its state is a set of tables that change together.

    State of another tree (another fingerprint) isn't used: its latches begin anew, while what was last
    seen of the assets stays.
    """

    def __init__(self, spark: SparkSession, root: str, tree: Node, ids: Sequence[str] = ("key",), edges: DataFrame | None = None) -> None:
        self.spark, self.tables, self.tree, self.ids, self.edges = spark, TableSet(spark, root), tree, list(ids), edges
        columns = ", ".join(f"{i} string" for i in self.ids)
        self.schemas = {
            "memory": f"{columns}, {', '.join(f'{c} {t}' for c, t in REMEMBERED.items())}",
            "latches": f"asks array<string>, {columns}, latches map<string,boolean>, fingerprint string",
            "intents": f"{columns}, tick long",
        }
        self.schemas |= {f"next_{n}": self.schemas[n] for n in ("memory", "latches")}

    def _read(self, name: str) -> DataFrame:
        return self.tables.read(name) if name in self.tables.names() else self.spark.createDataFrame([], self.schemas[name])

    def recover(self) -> DataFrame | None:
        """The intent of a tick that was begun and not finished: what fired, with its tick; None without one."""
        return self._read("intents") if "intents" in self.tables.names() else None

    def begin(self, facts: DataFrame, tick: int, tick_ns: int | None = None) -> DataFrame:
        """Evaluate a tick on the facts of every asset; returns the ids of those that fired.

        When an asset was last requested is known from earlier ticks; ``handled_tick`` of the facts, if
        they have it, counts as well.
        """
        if self.recover() is not None:
            raise RuntimeError("a tick is begun: send what recover() gives, and finish it")
        memory = self._read("memory")
        given = F.col("handled_tick") if "handled_tick" in facts.columns else F.lit(None).cast("long")
        handled = memory.select(*self.ids, F.col("handled_tick").alias("__handled_before"))
        now = facts.withColumns({"tick": F.lit(tick).cast("long"), "tick_ns": F.lit(tick_ns).cast("long"), "__given": given}).join(handled, self.ids, "left")
        now = now.withColumn("handled_tick", F.greatest("__given", "__handled_before")).drop("__given", "__handled_before")
        mark = self.tree.fingerprint()
        latches = self._read("latches").filter(F.col("fingerprint") == mark).drop("fingerprint")
        step = TickEvaluation(now, memory, latches, self.ids, self.edges)
        fired = cut_lineage(step.run(self.tree).filter("fired").select(*self.ids, "tick"))
        kept = step.facts.select(*self.ids, *REMEMBERED)
        left = self.spark.createDataFrame([], self.schemas["latches"])
        for part in step.latches:
            left = left.unionByName(part.withColumn("fingerprint", F.lit(mark)))
        whole = {"mode": "overwrite", "schema_mode": "overwrite"}
        self.tables.commit({"intents": (fired, whole), "next_memory": (kept, whole), "next_latches": (left, whole)})
        return fired.drop("tick")

    def finish(self, sent: DataFrame) -> None:
        """Take over the state of the tick that was begun; ``sent`` has the ids of the fired assets whose request went out."""
        intents = self._read("intents")
        lost = cut_lineage(intents.select(*self.ids).join(sent.select(*self.ids), self.ids, "left_anti"))
        requested = sent.select(*self.ids, F.lit(True).alias("__sent")).distinct()
        memory = self._read("next_memory").join(requested, self.ids, "left").withColumn("handled_tick", F.when(F.col("__sent"), F.col("tick")).otherwise(F.col("handled_tick"))).drop("__sent")
        memory = memory.join(lost, self.ids, "left_anti").unionByName(self._read("memory").join(lost, self.ids, "left_semi"))
        # The root of a latch is the first asset that asks, or the asset itself.
        of_lost = lost.select(F.col("key").alias("__root"), *[i for i in self.ids if i != "key"])
        by = ["__root", *[i for i in self.ids if i != "key"]]
        rooted = lambda df: df.withColumn("__root", F.coalesce(F.try_element_at("asks", F.lit(1)), F.col("key")))
        latches = rooted(self._read("next_latches")).join(of_lost, by, "left_anti").unionByName(rooted(self._read("latches")).join(of_lost, by, "left_semi")).drop("__root")
        whole = {"mode": "overwrite", "schema_mode": "overwrite"}
        done = dict.fromkeys(("intents", "next_memory", "next_latches"))
        self.tables.commit({"memory": (memory.select(*self.ids, *REMEMBERED), whole), "latches": (latches.select("asks", *self.ids, "latches", "fingerprint"), whole), **done})
