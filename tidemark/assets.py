"""Assets as functions over DataFrames: graph, selection, materialisation, events and hooks."""

from __future__ import annotations

import inspect
import time
import typing
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.events import SORT_ORDER
from tidemark.operators.graph import sort_items
from tidemark.operators.predicates import Key
from tidemark.session import ship_package
from tidemark.sources.handlers import AssetSettings, Context, Handlers, convert, partition_suffix, to_frame

EVENT_SCHEMA = "event_type string, asset_key string, run_id string, partition string, timestamp long, sort_order int, metadata map<string,string>"


class GraphError(ValueError):
    pass


@dataclass
class Asset:
    """A node: a function whose parameters name the assets that it reads.

    ``outputs`` has the names of a function that returns a dict or tuple of several; ``observe``
    makes it external: it is never computed, only looked at. A parameter named as the asset itself
    gets its previous output, or None the first time.
    """

    key: str
    run: Callable[..., Any]
    inputs: dict[str, str]
    group: str | None = None
    tags: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    io: str | None = None
    input_io: Mapping[str, str] = field(default_factory=dict)
    partition_columns: str | Mapping[str, str] | None = None
    definitions: Any = None
    mappings: Mapping[str, Callable[[Key], Sequence[Key] | None]] = field(default_factory=dict)
    settings: AssetSettings = field(default_factory=AssetSettings)
    code_version: str | None = None
    external: bool = False
    success: Sequence[Callable[[str, dict], None]] = ()
    failure: Sequence[Callable[[str, BaseException], None]] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return self.outputs or (self.key,)


def asset(key: str | None = None, *, deps: Mapping[str, str] | None = None, **options: Any) -> Callable[[Callable[..., Any]], Asset]:
    """Decorate a function as an asset; ``deps`` renames parameters to asset keys."""

    def make(run: Callable[..., Any]) -> Asset:
        names = [p for p in inspect.signature(run).parameters if p not in ("spark", "partition")]
        return Asset(key or run.__name__, run, {p: (deps or {}).get(p, p) for p in names}, **options)

    return make


@dataclass
class Task:
    """A step of a pipeline within an asset, with a fan-out over rows and a barrier behind it."""

    run: Callable[..., Any]

    def __call__(self, *args: Any) -> Any:
        if (open_ := _COMPOSING.get()) is not None:
            return open_.record("call", self, args)
        return self.run(*args)

    def map(self, rows: DataFrame, schema: str) -> DataFrame:
        """Apply the function to each row (a dict), which gives any number of rows; batches go through Arrow."""
        if (open_ := _COMPOSING.get()) is not None:
            return open_.record("map", self, (rows,), schema)
        ship_package(rows.sparkSession)
        run = self.run

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [r for row in frame.to_dict("records") for r in _rows(run(row))]
                if out:
                    yield pd.DataFrame(out)

        return rows.mapInPandas(batches, schema)

    @staticmethod
    def collect(mapped: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        """Gather the mapped rows of each key into one array, in order."""
        if (open_ := _COMPOSING.get()) is not None:
            return open_.record("collect", None, (mapped,), keys, order)
        rest = [c for c in mapped.columns if c not in keys]
        item = F.struct(*order, *(c for c in rest if c not in order))
        return mapped.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))

    @staticmethod
    def stream(mapped: DataFrame) -> Iterator[Any]:
        """The mapped rows one by one, a partition at a time on the driver."""
        if (open_ := _COMPOSING.get()) is not None:
            return open_.record("stream", None, (mapped,))
        return mapped.toLocalIterator()


@dataclass(frozen=True)
class Handle:
    """What a step of a composition will give, or one of its inputs."""

    name: str


@dataclass(frozen=True)
class Step:
    name: str
    kind: str  # call, map, collect or stream
    task: Task | None
    inputs: tuple[Any, ...]
    options: tuple[Any, ...]


_COMPOSING: ContextVar[Composition | None] = ContextVar("composing", default=None)


class Composition:
    """The steps of a graph asset, captured by running its function once on handles in place of data."""

    def __init__(self, build: Callable[..., Any], inputs: Sequence[str]) -> None:
        self.steps: list[Step] = []
        token = _COMPOSING.set(self)
        try:
            self.result = build(**{i: Handle(i) for i in inputs})
        finally:
            _COMPOSING.reset(token)

    def record(self, kind: str, task: Task | None, inputs: tuple[Any, ...], *options: Any) -> Handle:
        base = kind if task is None else getattr(task.run, "__name__", "task")
        name = f"{base}.{sum(s.name.split('.')[0] == base for s in self.steps)}"
        self.steps.append(Step(name, kind, task, inputs, options))
        return Handle(name)

    def edges(self) -> list[tuple[str, str]]:
        """(step, the step or input that it reads)."""
        return [(s.name, i.name) for s in self.steps for i in s.inputs if isinstance(i, Handle)]

    def run(self, **inputs: Any) -> Any:
        """Run the steps in the order in which they were called; frames stay lazy."""
        done: dict[str, Any] = dict(inputs)
        value = lambda x: done[x.name] if isinstance(x, Handle) else {k: value(v) for k, v in x.items()} if isinstance(x, dict) else x
        for s in self.steps:
            given = [value(i) for i in s.inputs]
            if s.task is not None:
                done[s.name] = s.task.map(*given, *s.options) if s.kind == "map" else s.task(*given)
            else:
                done[s.name] = Task.collect(*given, *s.options) if s.kind == "collect" else Task.stream(*given)
        return value(self.result)


def graph_asset(key: str | None = None, *, deps: Mapping[str, str] | None = None, **options: Any) -> Callable[[Callable[..., Any]], Asset]:
    """Decorate a function that only calls tasks: its steps are captured once and run as one asset."""

    def make(build: Callable[..., Any]) -> Asset:
        names = list(inspect.signature(build).parameters)
        found = Composition(build, names)

        def run(**inputs: Any) -> Any:
            return found.run(**inputs)

        run.composition = found  # type: ignore[attr-defined]
        return Asset(key or build.__name__, run, {p: (deps or {}).get(p, p) for p in names}, **options)

    return make


def _rows(value: Any) -> Iterable[dict]:
    return [] if value is None else [value] if isinstance(value, dict) else value


@dataclass
class Outcome:
    run_id: str
    status: str
    events: list[tuple]
    failed: dict[str, str]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENT_SCHEMA)


class Repository:
    """A resolved set of assets: acyclic, every input known."""

    def __init__(self, spark: SparkSession, assets: Sequence[Asset], handlers: Handlers, workers: int = 4) -> None:
        self.spark, self.handlers, self.workers = spark, handlers, workers
        self.nodes = {a.key: a for a in assets}
        if len(self.nodes) != len(assets):
            raise GraphError("an asset key occurs twice")
        self.owner = {n: a.key for a in assets for n in a.names}
        for a in assets:
            for name in a.inputs.values():
                if name not in self.owner:
                    raise GraphError(f"asset {a.key} reads {name}, which no asset makes")
        self.upstream = {a.key: {self.owner[n] for n in a.inputs.values()} - {a.key} for a in assets}
        self.levels = self._levels()

    def _levels(self) -> dict[str, int]:
        try:
            order = sort_items({k: sorted(us) for k, us in self.upstream.items()})
        except ValueError as error:
            raise GraphError(str(error)) from None
        found: dict[str, int] = {}
        for k in order:
            found[k] = 1 + max((found[u] for u in self.upstream[k]), default=-1)
        return found

    def edges(self) -> DataFrame:
        rows = [(k, u) for k, us in self.upstream.items() for u in us]
        return self.spark.createDataFrame(rows, "from_key string, to_key string")

    def select(self, keys: Sequence[str] | None = None, upstream: bool = False) -> list[str]:
        """The keys to make, dependencies first; all of them by default, with all they depend on if asked."""
        wanted = set(self.nodes if keys is None else keys)
        if unknown := wanted - set(self.nodes):
            raise GraphError(f"no such assets: {sorted(unknown)}")
        open_ = set(wanted) if upstream else set()
        while open_:
            open_ = {u for k in open_ for u in self.upstream[k]} - wanted
            wanted |= open_
        return sorted((k for k in wanted if not self.nodes[k].external), key=lambda k: (self.levels[k], k))

    def plan(self, keys: Sequence[str] | None = None, upstream: bool = False) -> list[list[str]]:
        """Levels of assets that can be made side by side."""
        steps: dict[int, list[str]] = {}
        for k in self.select(keys, upstream):
            steps.setdefault(self.levels[k], []).append(k)
        return [steps[i] for i in sorted(steps)]

    def _context(self, a: Asset, name: str, partitions: Sequence[Key] | None) -> Context:
        return Context(name, partitions if a.partition_columns is not None else None, a.partition_columns, a.definitions, a.settings)

    def load(self, name: str, partitions: Sequence[Key] | None = None, io: str | None = None) -> DataFrame:
        a = self.nodes[self.owner[name]]
        if a.external:
            return to_frame(self.spark, a.run(self.spark))
        return self.handlers.for_input(io, a.io).load_input(self.spark, self._context(a, name, partitions))

    def _arguments(self, a: Asset, partition: Key | None) -> dict[str, Any]:
        hints = typing.get_type_hints(a.run)
        arguments: dict[str, Any] = {}
        for parameter, name in a.inputs.items():
            if name in a.names:
                try:
                    arguments[parameter] = convert(self.load(name), hints.get(parameter))
                except (KeyError, ValueError):
                    arguments[parameter] = None
                continue
            keys: Sequence[Key] | None = None if partition is None else [partition]
            if partition is not None and name in a.mappings:
                keys = a.mappings[name](partition)
                if keys is None:  # the mapping says to skip this input
                    arguments[parameter] = None
                    continue
            arguments[parameter] = convert(self.load(name, keys, a.input_io.get(parameter)), hints.get(parameter))
        for extra, value in (("spark", self.spark), ("partition", partition)):
            if extra in inspect.signature(a.run).parameters:
                arguments[extra] = value
        return arguments

    def _make(self, a: Asset, partition: Key | None) -> dict[str, dict]:
        result = a.run(**self._arguments(a, partition))
        if a.outputs:
            named = result if isinstance(result, dict) else dict(zip(a.outputs, result, strict=True))
            if set(named) != set(a.outputs):
                raise TypeError(f"asset {a.key} returned {sorted(named)} instead of {sorted(a.outputs)}")
        else:
            named = {a.key: result}
        handler = self.handlers.get(a.io)
        return {n: handler.handle_output(self._context(a, n, None if partition is None else [partition]), to_frame(self.spark, v)) for n, v in named.items()}

    def materialize(self, keys: Sequence[str] | None = None, partition: Key | None = None, upstream: bool = False) -> Outcome:
        """Make assets level by level; within a level their jobs run at the same time.

        An asset that fails is reported, and what depends on it is skipped; the rest goes on.
        """
        run_id, events, failed = str(uuid.uuid4()), [], {}

        def note(kind: str, key: str, **metadata: Any) -> None:
            text = {k: str(v) for k, v in metadata.items()}
            events.append((kind, key, run_id, partition_suffix(partition) or None, time.time_ns(), SORT_ORDER[kind], text))

        def step(key: str) -> None:
            a = self.nodes[key]
            if blocked := sorted(self.upstream[key] & set(failed)):
                failed[key] = f"skipped: {', '.join(blocked)} failed"
                return
            note("StepStart", key)
            try:
                for name, metadata in self._make(a, partition).items():
                    note("Materialization", name, **metadata)
                note("StepSuccess", key)
                self._hooks(a.success, key, {})
            except Exception as error:  # noqa: BLE001 - any failure of an asset is its outcome
                failed[key] = f"{type(error).__name__}: {error}"
                note("StepFailure", key, error=failed[key])
                self._hooks(a.failure, key, error)

        with ThreadPoolExecutor(self.workers) as pool:
            for level in self.plan(keys, upstream):
                list(pool.map(step, level))
        return Outcome(run_id, "Failure" if failed else "Success", events, failed)

    @staticmethod
    def _hooks(hooks: Sequence[Callable[[str, Any], None]], key: str, value: Any) -> None:
        for hook in hooks:
            try:
                hook(key, value)
            except Exception as error:  # noqa: BLE001 - a hook must not fail the run
                print(f"hook of {key} failed: {error}")

    def observe(self, key: str) -> dict[str, Any]:
        """Freshness of an external asset: its number of rows and its schema."""
        df = self.load(key)
        return {"rows": df.count(), "schema": df.schema.json()}

    def backfill(self, key: str, partitions: Sequence[Key], upstream: bool = False) -> dict[str, Outcome]:
        """One run for each partition, in order; a failed partition doesn't stop the others."""
        return {partition_suffix(p): self.materialize([key], p, upstream) for p in partitions}


def check_schema(df: DataFrame, expected: str) -> list[str]:
    """Differences between a frame's columns and an expected DDL: missing, extra, or of another type."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(expected).fields}
    have = dict(df.dtypes)
    return [f"{n}: expected {want.get(n)}, found {have.get(n)}" for n in sorted({*want, *have}) if want.get(n) != have.get(n)]


def mark_failures(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``failed_checks``: the names of the checks a row fails (null counts as failed)."""
    names = [F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]
    return rows.withColumn("failed_checks", F.array_compact(F.array(*names)))
