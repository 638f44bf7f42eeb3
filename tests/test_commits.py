"""Commits under races, restarts and crashes; sets of tables; handlers of values."""

import types

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators.merge import AmbiguousMerge, merge
from tidemark.sources import handlers as H
from tidemark.sources.versioned import CommitConflict, TableSet, VersionedTable, enqueue
from tidemark.streaming.events import CommittedSink, run_available

SCHEMA = "key string, val long"


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


class Overtaken(VersionedTable):
    """A writer that another one overtakes just before it commits."""

    other = None

    def _commit(self, version, entry):
        if self.other:
            first, self.other = self.other, None
            first()
        super()._commit(version, entry)


def test_an_append_that_comes_second_joins_the_first(spark, tmp_path):
    root = str(tmp_path / "t")
    VersionedTable(spark, root).write(frame(spark, [("a", 1)]))
    late = Overtaken(spark, root)
    late.other = lambda: VersionedTable(spark, root).write(frame(spark, [("b", 2)]), "append")
    assert late.write(frame(spark, [("c", 3)]), "append").version == 2
    assert rows(late.read()) == [("a", 1), ("b", 2), ("c", 3)] and rows(late.read(1)) == [("a", 1), ("b", 2)]
    late.other = lambda: VersionedTable(spark, root).write(frame(spark, [("d", 4)]), "append")
    with pytest.raises(CommitConflict):
        late.write(frame(spark, [("x", 9)]), "overwrite")
    assert late.read().count() == 4
    assert not [f for f in (tmp_path / "t" / "log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_vacuum_spares_a_writer_that_has_not_committed(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(3):
        table.write(frame(spark, [("a", i)]), "overwrite" if i else "error")
    flying = table._place("flat/v3-inflight")
    frame(spark, [("z", 0)]).write.parquet(flying)
    assert table.vacuum(1) == 2 and rows(table.read()) == [("a", 2)] and table.versions() == [2]
    assert spark.read.parquet(flying).count() == 1
    assert table.vacuum(1, grace_s=-1) == 1


def test_many_appends_are_one_scan(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["key"])
    for i in range(12):
        table.write(frame(spark, [("ab"[i % 2], i)]), "append")
    plan = table.read(predicate=F.col("key") == "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters" in plan and table.read().count() == 12
    flat = VersionedTable(spark, table.root)  # other partition columns: a layout of its own
    flat.write(frame(spark, [("c", 99)]), "append")
    assert flat.read().count() == 13 and rows(flat.read(predicate=F.col("val") > 10)) == [("b", 11), ("c", 99)]
    flat.write(frame(spark, [("a", 0), ("c", 1)]), "merge", keys=["key"], clauses="deduplicate_insert")
    assert flat.read().count() == 13


def test_doubled_source_keys_matter_only_where_they_match(spark):
    target, twice = frame(spark, [("a", 1)]), frame(spark, [("b", 1), ("b", 2)])
    assert rows(merge(target, twice, ["key"], "upsert")) == [("a", 1), ("b", 1), ("b", 2)]
    with pytest.raises(AmbiguousMerge):
        merge(target, frame(spark, [("a", 1), ("a", 2)]), ["key"], "upsert")
    assert rows(merge(target, frame(spark, [("a", 7), ("c", 2), ("c", 3)]), ["key"], "deduplicate_insert")) == [("a", 1), ("c", 2), ("c", 3)]


def test_a_new_stream_over_an_old_table_loses_no_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))
    frame(spark, [("a", 1)]).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    sink = lambda: CommittedSink(table, lambda b: b.groupBy("key").agg(F.max("val").alias("val")), ["key"])
    one, two = str(tmp_path / "c1"), str(tmp_path / "c2")
    run_available(stream(), sink(), one)
    frame(spark, [("b", 2)]).write.mode("append").parquet(source)
    run_available(stream(), sink(), one)
    assert rows(table.read()) == [("a", 1), ("b", 2)] and table.batches() == {one: 1}
    frame(spark, [("c", 3)]).write.mode("append").parquet(source)
    run_available(stream(), sink(), two)
    assert rows(table.read()) == [("a", 1), ("b", 2), ("c", 3)] and table.batches() == {one: 1, two: 0}
    again = sink()
    again.stream = two
    again(frame(spark, [("z", 9)]), 0)  # the batch is there
    again(frame(spark, []), 1)  # no row, but the batch is recorded
    assert table.read().count() == 3 and table.batches()[two] == 1
    table.write(frame(spark, [("d", 4)]), "append")
    assert table.batches()[two] == 1


def test_tables_of_a_set_change_together(spark, tmp_path, monkeypatch):
    tables = TableSet(spark, str(tmp_path / "s"))
    runs = lambda *ids: frame(spark, [(i, "loc") for i in ids], "run_id string, code_location_id string")
    assert enqueue(tables, runs("r1", "r2", "r2"), 5) == 0
    assert rows(tables.read("runs"), "run_id", "status") == [("r1", "Queued"), ("r2", "Queued")]
    assert rows(tables.read("events")) == [("r1", "RunQueued", 5), ("r2", "RunQueued", 5)]
    assert enqueue(tables, runs("r2", "r3"), 6) == 1 and rows(tables.read("events"), "run_id") == [("r1",), ("r2",), ("r3",)]
    with pytest.raises(CommitConflict):
        tables.commit({"runs": (tables.read("runs"), {"mode": "overwrite"})}, base=0)
    monkeypatch.setattr("tidemark.sources.versioned.write_once", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        enqueue(tables, runs("r9"), 7)
    monkeypatch.undo()
    assert tables.read("runs").count() == 3 == tables.read("events").count() and tables.read("runs", 0).count() == 2
    assert enqueue(tables, runs("r9"), 8) == 2 and rows(tables.read("events").filter("run_id = 'r9'")) == [("r9", "RunQueued", 8)]


def test_memory_handler_holds_several_partitions(spark):
    memory = H.MemoryHandler()
    memory.handle_output(H.Context("x", ["a", "b"], "key"), frame(spark, [("a", 1), ("b", 2), ("b", 3)]))
    assert rows(memory.load_input(spark, H.Context("x", ["a", "b"], "key"))) == [("a", 1), ("b", 2), ("b", 3)]
    assert rows(memory.load_input(spark, H.Context("x", ["b"], "key"))) == [("b", 2), ("b", 3)]
    with pytest.raises(KeyError):
        memory.load_input(spark, H.Context("x", ["a", "c"], "key"))


def test_pickles(spark, tmp_path):
    handler = H.PickleHandler(spark, str(tmp_path))
    value = {"weights": [1.5, None], "é/|": {3}}
    assert handler.handle_output(H.Context("m", [{"day": "2024-01-01", "r": "a/b"}]), value)["bytes"] > 0
    assert handler.load_input(spark, H.Context("m", [{"r": "a/b", "day": "2024-01-01"}])) == value
    handler.handle_output(H.Context("m"), None)
    assert handler.load_input(spark, H.Context("m")) is None
    with pytest.raises(KeyError):
        handler.load_input(spark, H.Context("m", ["nothing"]))
    with pytest.raises(ValueError):
        handler.handle_output(H.Context("m", ["a", "b"]), 1)


def test_frames_of_a_library_that_may_be_absent(spark):
    """Polars isn't installed here: a stand-in with the methods that the handlers use."""

    class Frame:
        def __init__(self, table):
            self.table = table

        def to_arrow(self):
            return self.table

        def lazy(self):
            return Lazy(self.table)

    class Lazy(Frame):
        def collect(self):
            return Frame(self.table)

    eager, lazy = H.polars_types(types.SimpleNamespace(DataFrame=Frame, LazyFrame=type("Own", (Lazy,), {}), from_arrow=Frame))
    df = frame(spark, [("a", 1)])
    assert eager.load(df).table.to_pylist() == [{"key": "a", "val": 1}] and isinstance(lazy.load(df), Lazy)
    assert rows(eager.store(spark, Frame(pa.table({"key": ["b"], "val": [2]})), None)) == [("b", 2)] == rows(lazy.store(spark, Lazy(pa.table({"key": ["b"], "val": [2]})), None))
    Frame.__module__ = "polars.frame"
    with pytest.raises(TypeError, match="install polars"):
        H.convert(df, Frame)


def test_own_types_come_first(spark):
    class Total(int):
        pass

    class Totals(H.TypeHandler):
        kind = Total

        def load(self, df):
            return Total(df.agg(F.sum("val")).first()[0])

        def store(self, spark, value, schema):
            return frame(spark, [("total", int(value))])

    H.register(Totals())
    try:
        df = frame(spark, [("a", 1), ("b", 5)])
        assert H.convert(df, Total) == 6 and rows(H.to_frame(spark, Total(7))) == [("total", 7)]
        assert H.convert(df, pa.Table).num_rows == 2 and sum(b.num_rows for b in H.convert(df, pa.RecordBatchReader)) == 2
    finally:
        H.TYPES.pop(0)


def test_buffered_events_are_committed_without_jobs(spark, tmp_path):
    from pyspark.sql.types import StructType

    from tidemark.streaming.events import EventBuffer

    table, mixed = VersionedTable(spark, str(tmp_path / "t x")), [("Überlauf", 1 << 62, -0.5, True, 7), (None, None, None, None, None), ("a\0,", -1, float("inf"), False, -7)]
    schema = "kind string, n long, x double, ok boolean, i int"
    spark.sparkContext.setJobGroup("buffer", "")
    try:
        with EventBuffer(table, schema, size=3, wait_s=float("inf")) as buffer:
            for event in 40 * mixed + mixed[:1]:
                buffer.add(*event)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("buffer")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert table.versions() == list(range(41)) and rows(table.read(5)) == sorted(6 * mixed, key=repr)
    assert rows(table.read()) == sorted(40 * mixed + mixed[:1], key=repr) and table.schema() == StructType.fromDDL(schema)
    assert not [f for f in (tmp_path / "t x" / "log").iterdir() if f.name.startswith(".")]


def test_appended_rows_see_what_other_writers_did(spark, tmp_path):
    from pyspark.sql.types import StructType

    root, schema = str(tmp_path / "t"), StructType.fromDDL(SCHEMA)
    one, other = VersionedTable(spark, root), VersionedTable(spark, root)
    assert [t.append_rows([(k, 1)], schema).version for t, k in ((one, "a"), (other, "b"), (one, "c"))] == [0, 1, 2]
    for i in range(3):
        other.append_rows([("d", i)], schema)
    other.vacuum(1)
    assert one.append_rows([("e", 9)], schema).version == 6 and one.versions() == [5, 6] and one.read().count() == 7
    other.write(frame(spark, [("f", 1)]), "merge", keys=["key"], batch=("s", 4))
    one.append_rows([("g", 1)], schema)
    assert one.batches() == {"s": 4} and rows(one.read().filter("key > 'd'"), "key") == [("e",), ("f",), ("g",)]
    late = Overtaken(spark, root)
    late.other = lambda: other.append_rows([("h", 1)], schema)
    late.append_rows([("i", 1)], schema)
    late.other = lambda: other.write(spark.createDataFrame([(1,)], "z int"), "create_or_replace")
    with pytest.raises(CommitConflict):
        late.append_rows([("j", 1)], schema)
    with pytest.raises(AnalysisException):
        one.append_rows([("k", 1)], schema)
    assert rows(one.read()) == [(1,)]


def test_appended_rows_that_are_not_plain_go_by_a_frame(spark, tmp_path):
    from datetime import UTC, datetime

    from pyspark.sql.types import StructType

    from tidemark.streaming.events import EventBuffer

    buffer = EventBuffer(VersionedTable(spark, str(tmp_path / "t")), SCHEMA, size=1)
    for bad in (("a", "x"), ("a", True), ("a", 1 << 63), ("a",)):
        with pytest.raises(Exception):  # noqa: B017 - Spark's own error
            buffer.add(*bad)
        assert buffer.held.pop() == bad and not buffer.held and not buffer.table.exists()
    buffer.add(5, 5)
    buffer.add("b", 6)
    at = StructType.fromDDL("val int, key string")
    buffer.table.append_rows([(7, "c")], at)
    assert rows(buffer.table.read()) == [("5", 5), ("b", 6), ("c", 7)] and buffer.table.schema() == StructType.fromDDL(SCHEMA)
    nested = VersionedTable(spark, str(tmp_path / "n"))
    nested.append_rows([([1, 2], datetime(2024, 1, 1, tzinfo=UTC))], StructType.fromDDL("a array<int>, t timestamp"))
    assert nested.read().select("a", F.unix_seconds("t")).first() == ([1, 2], 1704067200)
    parted = VersionedTable(spark, str(tmp_path / "p"), ["key"])
    parted.append_rows([("a/b", 1), ("c", 2)], StructType.fromDDL(SCHEMA))
    assert rows(parted.read()) == [("a/b", 1), ("c", 2)]


def test_a_disk_without_links_commits_by_renaming(spark, tmp_path, monkeypatch):
    import os

    from pyspark.sql.types import StructType

    def refused(*_):
        raise PermissionError

    monkeypatch.setattr(os, "link", refused)
    table, schema = VersionedTable(spark, str(tmp_path / "t")), StructType.fromDDL(SCHEMA)
    for i in range(3):
        table.append_rows([("a", i)], schema)
    late = Overtaken(spark, table.root)
    late.other = lambda: table.append_rows([("b", 3)], schema)
    late.append_rows([("c", 4)], schema)
    assert rows(table.read(), "val") == [(i,) for i in range(5)] and table.versions() == list(range(5))


def test_rows_are_appended_off_the_local_disk_too(spark, tmp_path, monkeypatch):
    from pyspark.sql.types import StructType

    monkeypatch.setattr(VersionedTable, "_disk", None)  # by Hadoop's calls, as on any store
    table, schema = VersionedTable(spark, str(tmp_path / "t")), StructType.fromDDL(SCHEMA)
    assert [table.append_rows([("a", i)], schema).version for i in range(3)] == [0, 1, 2]
    VersionedTable(spark, table.root).append_rows([("b", 3)], schema)
    assert table.append_rows([("c", 4)], schema).version == 4 and rows(table.read(), "val") == [(i,) for i in range(5)]
