"""IO handlers: how an asset's output is stored and how it is loaded as an input."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.operators.merge import Clause
from tidemark.operators.partitions import Static, TimeWindow
from tidemark.operators.predicates import Key, partition_predicate
from tidemark.sources.versioned import Mode, VersionedTable, WriteStats


@dataclass(frozen=True)
class AssetSettings:
    """Per-asset settings that override the handler's."""

    root_name: str | None = None
    mode: Mode | None = None
    schema_mode: str | None = None
    columns: Sequence[str] | None = None
    version: int | None = None
    keys: Sequence[str] = ()
    clauses: str | Sequence[Clause] = "upsert"


@dataclass(frozen=True)
class Context:
    """What a handler is told: the asset, the partitions in question and where they are in the rows."""

    asset: str
    partitions: Sequence[Key] | None = None
    partition_columns: str | Mapping[str, str] | None = None
    definitions: Any = None
    settings: AssetSettings = field(default_factory=AssetSettings)

    def predicate(self) -> Column | None:
        if self.partitions is None:
            return None
        if self.partition_columns is None:
            raise ValueError(f"asset {self.asset} has partitions but no columns for them")
        return partition_predicate(self.partitions, self.partition_columns, self.definitions)


class IOHandler(ABC):
    @abstractmethod
    def load_input(self, spark: SparkSession, context: Context) -> DataFrame: ...

    @abstractmethod
    def handle_output(self, context: Context, output: DataFrame) -> dict[str, Any]: ...


def partition_suffix(partition: Key | None) -> str:
    """``a`` or ``dim=v|dim2=w`` in order of name; '' without a partition."""
    if partition is None:
        return ""
    if isinstance(partition, str):
        return partition
    return "|".join(f"{d}={v if isinstance(v, str) else ','.join(v)}" for d, v in sorted(partition.items()))


class MemoryHandler(IOHandler):
    """Keeps lazy DataFrames by asset and partition: nothing is computed until it is read.

    Several partitions at once are stored one by one, by their columns, and loaded as their union.
    """

    def __init__(self) -> None:
        self.stored: dict[tuple[str, str], DataFrame] = {}

    def load_input(self, spark: SparkSession, context: Context) -> DataFrame:
        keys = [(context.asset, partition_suffix(p)) for p in context.partitions or [None]]
        if absent := [k for k in keys if k not in self.stored]:
            raise KeyError(f"nothing stored for {absent}")
        return reduce(DataFrame.unionByName, (self.stored[k] for k in keys))

    def handle_output(self, context: Context, output: DataFrame) -> dict[str, Any]:
        several = context.partitions if context.partitions is not None and len(context.partitions) > 1 else None
        for partition in context.partitions or [None]:
            rows = output.filter(replace(context, partitions=[partition]).predicate()) if several else output
            self.stored[context.asset, partition_suffix(partition)] = rows
        return {"schema": output.schema.json()}


class PickleHandler(IOHandler):
    """Python objects of any kind, pickled one file per asset and partition below a root on any store of Hadoop.

    Values are as large as the driver can hold; tables belong to ``TableHandler``. Load only what you
    trust: unpickling runs code.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, context: Context):
        if context.partitions is not None and len(context.partitions) != 1:
            raise ValueError("a pickled value belongs to one partition")
        name = quote(partition_suffix(context.partitions[0]) if context.partitions else "value", safe="=|,")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{context.settings.root_name or context.asset}/{name}.pickle")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def handle_output(self, context: Context, output: Any) -> dict[str, Any]:
        path, fs = self._path(context)
        data = pickle.dumps(output)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return {"bytes": len(data)}

    def load_input(self, spark: SparkSession, context: Context) -> Any:
        path, fs = self._path(context)
        if not fs.exists(path):
            raise KeyError(f"nothing stored at {path.toString()}")
        stream = fs.open(path)
        try:
            return pickle.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()


class TableHandler(IOHandler):
    """A versioned parquet table for each asset below a root; partitions are replaced alone."""

    def __init__(self, spark: SparkSession, root: str, mode: Mode = "overwrite") -> None:
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode

    def table(self, context: Context) -> VersionedTable:
        """Folders by the columns of plain keys; times are left to the files' statistics, as each would be a folder."""
        by, kinds = context.partition_columns, context.definitions
        pairs = {} if by is None else {"": by} if isinstance(by, str) else by
        kind = lambda d: kinds.get(d) if isinstance(kinds, Mapping) else kinds
        columns = sorted(c for d, c in pairs.items() if not isinstance(kind(d), TimeWindow))
        return VersionedTable(self.spark, f"{self.root}/{context.settings.root_name or context.asset}", columns)

    def load_input(self, spark: SparkSession, context: Context) -> DataFrame:
        s = context.settings
        return self.table(context).read(s.version, s.columns, context.predicate())

    def handle_output(self, context: Context, output: DataFrame) -> dict[str, Any]:
        s = context.settings
        mode = s.mode or self.mode
        scope = context.predicate() if mode == "overwrite" else None
        stats: WriteStats | None = self.table(context).write(output, mode, s.schema_mode or "strict", scope, s.keys, s.clauses)  # type: ignore[arg-type]
        return {} if stats is None else vars(stats)


class Handlers:
    """Resolves the handler of an input: its own, else its upstream's, else the default."""

    def __init__(self, default: IOHandler, named: Mapping[str, IOHandler] | None = None) -> None:
        self.default, self.named = default, dict(named or {})

    def get(self, name: str | None) -> IOHandler:
        if name is None:
            return self.default
        if name not in self.named:
            raise KeyError(f"no IO handler {name!r}; known are {sorted(self.named)}")
        return self.named[name]

    def for_input(self, of_input: str | None, of_upstream: str | None) -> IOHandler:
        return self.get(of_input if of_input is not None else of_upstream)


class TypeHandler(ABC):
    """How one Python type is loaded from a table and stored as one. Local types pull all rows to the driver."""

    kind: type

    def accepts(self, wanted: Any) -> bool:
        return isinstance(wanted, type) and issubclass(wanted, self.kind)

    @abstractmethod
    def load(self, df: DataFrame) -> Any: ...

    @abstractmethod
    def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame: ...


def _created(spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
    return spark.createDataFrame(value, schema) if schema is not None else spark.createDataFrame(value)


class SparkFrames(TypeHandler):
    kind = DataFrame

    def load(self, df: DataFrame) -> Any:
        return df

    def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
        return value


class PandasFrames(TypeHandler):
    kind = pd.DataFrame

    def load(self, df: DataFrame) -> Any:
        return df.toPandas()

    def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
        return _created(spark, value, schema)


class ArrowTables(TypeHandler):
    kind = pa.Table

    def load(self, df: DataFrame) -> Any:
        return df.toArrow()

    def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
        return _created(spark, value, schema)


class ArrowReaders(ArrowTables):
    kind = pa.RecordBatchReader

    def load(self, df: DataFrame) -> Any:
        return df.toArrow().to_reader()

    def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
        return super().store(spark, value.read_all(), schema)


class Rows(TypeHandler):
    """A list of dicts; an empty one needs a schema."""

    kind = list

    def load(self, df: DataFrame) -> Any:
        return [r.asDict(recursive=True) for r in df.collect()]

    def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
        if not value and schema is None:
            raise TypeError("can't store an empty list without a schema")
        return _created(spark, value, schema)


#: The first that accepts a type handles it; ``register`` puts one in front.
TYPES: list[TypeHandler] = [SparkFrames(), PandasFrames(), ArrowTables(), ArrowReaders(), Rows()]


def register(handler: TypeHandler) -> None:
    TYPES.insert(0, handler)


def polars_types(polars: Any) -> list[TypeHandler]:
    """Handlers of Polars' frames, eager and lazy, by way of Arrow."""

    class PolarsFrames(TypeHandler):
        kind = polars.DataFrame

        def load(self, df: DataFrame) -> Any:
            return polars.from_arrow(df.toArrow())

        def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
            return _created(spark, value.to_arrow(), schema)

    class PolarsLazyFrames(PolarsFrames):
        kind = polars.LazyFrame

        def load(self, df: DataFrame) -> Any:
            return super().load(df).lazy()

        def store(self, spark: SparkSession, value: Any, schema: StructType | None) -> DataFrame:
            return super().store(spark, value.collect(), schema)

    return [PolarsFrames(), PolarsLazyFrames()]


try:
    import polars as _polars
except ImportError:
    pass
else:
    TYPES += polars_types(_polars)


def convert(df: DataFrame, wanted: Any) -> Any:
    """``df`` as the wanted type; no annotation or Any means a DataFrame."""
    if wanted is None or wanted is Any:
        return df
    for handler in TYPES:
        if handler.accepts(wanted):
            return handler.load(df)
    hint = "; install polars" if getattr(wanted, "__module__", "").startswith("polars") else ""
    raise TypeError(f"can't load an input as {wanted!r}{hint}; known are {[h.kind.__name__ for h in TYPES]}")


def to_frame(spark: SparkSession, value: Any, schema: StructType | None = None) -> DataFrame:
    """A DataFrame from what a function returned: a DataFrame, or what a type handler knows."""
    for handler in TYPES:
        if handler.accepts(type(value)):
            return handler.store(spark, value, schema)
    raise TypeError(f"can't store a {type(value).__name__} as a table")


def schema_to_bytes(schema: StructType) -> bytes:
    """A schema as an Arrow IPC message, readable by any Arrow library."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).serialize().to_pybytes()


def schema_from_bytes(data: bytes) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(data)), prefer_timestamp_ntz=True)


class KeyValues:
    """A small map of keys to bytes in a versioned table; a set replaces the key's value."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, root)

    def set(self, key: str, value: bytes) -> None:
        self.table.write(self.spark.createDataFrame([(key, bytearray(value))], "key string, value binary"), "merge", keys=["key"])

    def get(self, key: str) -> bytes | None:
        from pyspark.sql import functions as F

        row = self.table.read(predicate=F.col("key") == key).first() if self.table.exists() else None
        return None if row is None else bytes(row["value"])


class RunFlags:
    """Outcome and cancellation of runs, kept by run id."""

    def __init__(self, values: KeyValues) -> None:
        self.values = values

    def finish(self, run_id: str, outcome: str) -> None:
        self.values.set(f"outcome/{run_id}", outcome.encode())

    def outcome(self, run_id: str) -> str | None:
        found = self.values.get(f"outcome/{run_id}")
        return None if found is None else found.decode()

    def cancel(self, run_id: str) -> None:
        self.values.set(f"cancelled/{run_id}", b"1")

    def cancelled(self, run_id: str) -> bool:
        return self.values.get(f"cancelled/{run_id}") is not None


__all__ = ["KeyValues", "PickleHandler", "RunFlags", "TypeHandler", "register", "schema_from_bytes", "schema_to_bytes", "AssetSettings", "Context", "Handlers", "IOHandler", "MemoryHandler", "Static", "TableHandler", "TimeWindow", "convert", "partition_suffix", "to_frame"]
