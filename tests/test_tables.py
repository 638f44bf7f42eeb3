"""Versioned tables, MERGE, predicates, IO handlers and assets."""

from datetime import datetime

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.assets import GraphError, Repository, Task, asset, check_schema, mark_failures
from tidemark.operators.merge import AmbiguousMerge, Clause, merge, merge_stats, replace_where
from tidemark.operators.partitions import daily
from tidemark.operators.predicates import partition_predicate, windows_of
from tidemark.sources.handlers import AssetSettings, Context, Handlers, MemoryHandler, TableHandler, convert, partition_suffix
from tidemark.sources.versioned import CommitConflict, TableExists, VersionedTable


def frame(spark, data, schema="id long, val long"):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def pair(spark):
    return frame(spark, [(1, 10), (2, 20)]), frame(spark, [(2, 99), (3, 30)])


@pytest.mark.parametrize(
    ("preset", "want"),
    [
        ("upsert", [(1, 10), (2, 99), (3, 30)]), ("deduplicate_insert", [(1, 10), (2, 20), (3, 30)]),
        ("update_only", [(1, 10), (2, 99)]), ("replace_delete_unmatched", [(2, 99)]),
    ],
)
def test_presets(pair, preset, want):
    assert rows(merge(*pair, ["id"], preset)) == want


def test_first_clause_wins_and_null_keys_match(spark):
    target = frame(spark, [(1, "a"), (2, "b"), (None, "n"), (4, "d")], "id long, s string")
    source = frame(spark, [(1, "A", 1), (2, "B", 2), (None, "N", 3), (9, "Z", 4)], "id long, s string, extra int")
    clauses = [
        Clause("source_update", None, {"s": "'orphan'"}), Clause("delete", "s.id = 2"), Clause("update", "s.id = 1", {"s": "concat(t.s, s.s)"}),
        Clause("update_all", "s.id IS NULL"), Clause("insert", "s.extra > 100", {"id": "s.id"}), Clause("insert_all", skip=["s"]),
    ]
    assert rows(merge(target, source, ["id"], clauses)) == [(1, "aA"), (4, "orphan"), (9, None), (None, "N")]
    assert merge_stats(target, source, ["id"], clauses).first().asDict() == {"inserted": 1, "updated": 3, "deleted": 1, "copied": 0}


def test_ambiguous_source_is_an_error(pair):
    with pytest.raises(AmbiguousMerge):
        merge(pair[0], pair[1].union(pair[1]), ["id"], "upsert")


def test_empty_sides(spark, pair):
    empty = pair[0].limit(0)
    assert rows(merge(empty, pair[1], ["id"], "upsert")) == [(2, 99), (3, 30)]
    assert rows(merge(pair[0], empty, ["id"], "upsert")) == [(1, 10), (2, 20)]


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["id"])
    one, two = frame(spark, [(1, 10)]), frame(spark, [(2, 20), (2, 21)])
    stats = t.write(one)
    assert (stats.version, stats.rows) == (0, 1) and stats.files > 0 and stats.bytes > 0
    t.write(two, "append")
    t.write(frame(spark, [(7, 70)]), "overwrite")
    assert t.versions() == [0, 1, 2]
    assert [rows(t.read(v)) for v in t.versions()] == [[(1, 10)], [(1, 10), (2, 20), (2, 21)], [(7, 70)]]
    assert rows(t.read(1, ["val"], F.col("id") == 2)) == [(20,), (21,)]
    assert t.write(one, "ignore") is None
    with pytest.raises(TableExists):
        t.write(one)
    with pytest.raises(ValueError, match="no version"):
        t.read(9)
    with pytest.raises(CommitConflict):
        t._commit(2, {})
    t.write(frame(spark, [(8, 80, "x")], "id long, val long, note string"), "append", schema_mode="merge")
    assert rows(t.read()) == [(7, 70, None), (8, 80, "x")]
    t.write(frame(spark, [(8, 1.5)], "id long, other double"), "create_or_replace")
    assert t.read().columns == ["id", "other"]
    assert t.vacuum(1) == 4 and rows(t.read()) == [(8, 1.5)]


def test_scoped_overwrite_leaves_other_rows(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    schema = "key string, val long"
    t.write(frame(spark, [("a", 1), ("b", 2), ("c", 3), (None, 4)], schema))
    t.write(frame(spark, [("a", 10)], schema), "overwrite", predicate=F.col("key").isin("a", "b"))
    assert rows(t.read()) == [("a", 10), ("c", 3), (None, 4)]
    with pytest.raises(ValueError, match="outside"):
        replace_where(t.read(), frame(spark, [("z", 1)], schema), F.col("key") == "a")


def test_only_folders_with_changed_rows_are_rewritten(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for k in "abc":
        t.write(frame(spark, [(k, 1), (k, 2)], "key string, val long"), "error" if k == "a" else "append")
    first = t.manifest()["parts"]
    t.write(frame(spark, [("b", 9)], "key string, val long"), "overwrite", predicate=F.col("key") == "b")
    assert t.manifest()["parts"][:2] == [first[0], first[2]] and rows(t.read()) == [("a", 1), ("a", 2), ("b", 9), ("c", 1), ("c", 2)]
    t.write(frame(spark, [("b", 7), ("d", 4)], "key string, val long"), "merge", keys=["key"])
    assert t.manifest()["parts"][:2] == [first[0], first[2]] and rows(t.read()) == [("a", 1), ("a", 2), ("b", 7), ("c", 1), ("c", 2), ("d", 4)]
    t.write(frame(spark, [("a", 1)], "key string, val long"), "merge", keys=["key"], clauses="replace_delete_unmatched")
    assert rows(t.read()) == [("a", 1), ("a", 1)] and len(t.manifest()["parts"]) == 1
    t.write(frame(spark, [("z", 1)], "key string, val long"), "append")
    t.compact()
    assert len(t.manifest()["parts"]) == 1 and t.read().count() == 3


def test_strict_schema(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(frame(spark, [(1, 1)]))
    with pytest.raises(Exception, match="schema_mode"):
        t.write(frame(spark, [(1, "x")], "id long, other string"), "append")
    t.write(frame(spark, [], "id long, val long"), "overwrite")
    assert t.read().count() == 0


def test_predicates(spark):
    df = frame(spark, [(r, e, v) for v, (r, e) in enumerate([("us", "dev"), ("us", "prod"), ("eu", "dev"), ("eu", "prod"), (None, "dev")])], "region string, env string, v int")
    columns = {"r": "region", "e": "env"}
    product = [{"r": "us", "e": ["dev", "prod"]}, {"r": "eu", "e": "dev"}, {"r": "eu", "e": "prod"}]
    assert rows(df.filter(partition_predicate(product, columns)), "v") == [(0,), (1,), (2,), (3,)]
    assert rows(df.filter(partition_predicate([{"r": "us", "e": "dev"}, {"r": "eu", "e": "prod"}], columns)), "v") == [(0,), (3,)]
    assert df.filter(partition_predicate([], columns)).count() == 0
    grid = daily(datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert windows_of(["2024-01-03", "2024-01-02", "2024-01-09"], grid) == [(datetime(2024, 1, 2), datetime(2024, 1, 4)), (datetime(2024, 1, 9), datetime(2024, 1, 10))]


def test_handlers(spark, tmp_path):
    table = TableHandler(spark, str(tmp_path))
    df = frame(spark, [("a", 1), ("b", 2)], "key string, val long")
    table.handle_output(Context("x"), df)
    part = Context("x", ["a"], "key")
    assert table.handle_output(part, frame(spark, [("a", 7)], "key string, val long"))["rows"] == 2
    assert rows(table.load_input(spark, part)) == [("a", 7)]
    assert rows(table.load_input(spark, Context("x", settings=AssetSettings(columns=["val"], version=0)))) == [(1,), (2,)]
    memory = MemoryHandler()
    memory.handle_output(Context("m", [{"b": "2", "a": "1"}]), df)
    assert memory.load_input(spark, Context("m", [{"a": "1", "b": "2"}])) is df and partition_suffix({"b": "2", "a": ["1", "3"]}) == "a=1,3|b=2"
    with pytest.raises(KeyError):
        memory.load_input(spark, Context("nothing"))
    with pytest.raises(KeyError):
        Handlers(memory).for_input("unknown", None)
    assert isinstance(convert(df, pd.DataFrame), pd.DataFrame) and convert(df, list)[0] == {"key": "a", "val": 1}
    with pytest.raises(TypeError):
        convert(df, int)


def test_schema_bytes_and_key_values(spark, tmp_path):
    from tidemark.sources.handlers import KeyValues, schema_from_bytes, schema_to_bytes

    schema = frame(spark, [], "a long, b array<struct<k:string,v:decimal(10,2)>>, c timestamp_ntz").schema
    assert schema_from_bytes(schema_to_bytes(schema)) == schema
    kv = KeyValues(spark, str(tmp_path / "kv"))
    assert kv.get("a") is None
    kv.set("a", b"1")
    kv.set("a", b"\x00\xff")
    assert kv.get("a") == b"\x00\xff" and kv.get("b") is None


def test_repository(spark, tmp_path):
    seen = []

    @asset(success=[lambda k, _: seen.append(k), lambda k, _: 1 / 0])
    def numbers(spark):
        return spark.range(10).withColumn("part", F.when(F.col("id") < 5, "a").otherwise("b"))

    @asset(outputs=("even", "odd"))
    def parity(numbers):
        return {"even": numbers.filter("id % 2 = 0"), "odd": numbers.filter("id % 2 = 1")}

    @asset()
    def total(even: pd.DataFrame, odd: DataFrame):
        return [{"n": int(len(even) + odd.count())}]

    @asset(failure=[lambda k, e: seen.append(str(e))])
    def broken(total):
        raise RuntimeError("no luck")

    @asset()
    def after(broken):
        return broken

    @asset()
    def running(running, numbers):
        fresh = numbers.select(F.count("*").alias("n"))
        return fresh if running is None else fresh.unionByName(running).agg(F.sum("n").alias("n"))

    repo = Repository(spark, [numbers, parity, total, broken, after, running], Handlers(TableHandler(spark, str(tmp_path))))
    assert repo.plan(["after"], upstream=True) == [["numbers"], ["parity"], ["total"], ["broken"], ["after"]]
    done = repo.materialize()
    assert done.status == "Failure" and set(done.failed) == {"broken", "after"} and "skipped" in done.failed["after"]
    assert rows(repo.load("total")) == [(10,)] and "no luck" in seen
    repo.materialize(["running"])
    assert rows(repo.load("running")) == [(20,)]
    events = done.frame(spark)
    assert events.filter("event_type = 'Materialization'").count() == 5 and events.filter("event_type = 'StepFailure'").count() == 1
    assert rows(repo.edges()) == [("after", "broken"), ("broken", "total"), ("parity", "numbers"), ("running", "numbers"), ("total", "parity")]


def test_partitioned_assets(spark, tmp_path):
    @asset(partition_columns="part")
    def source(spark, partition):
        return spark.createDataFrame([(partition, len(partition))], "part string, n int")

    @asset(partition_columns="part", mappings={"source": lambda key: None if key == "c" else [key, "a"]})
    def derived(source, partition):
        rows_in = 0 if source is None else source.count()
        return [{"part": partition, "rows_in": rows_in}]

    repo = Repository(spark, [source, derived], Handlers(TableHandler(spark, str(tmp_path))))
    assert {o.status for o in repo.backfill("source", ["a", "b"]).values()} == {"Success"}
    repo.backfill("derived", ["a", "b", "c"])
    assert rows(repo.load("derived"), "part", "rows_in") == [("a", 1), ("b", 2), ("c", 0)]


def test_bad_graphs(spark):
    @asset()
    def a(b):
        return b

    @asset()
    def b(a):
        return a

    handlers = Handlers(MemoryHandler())
    with pytest.raises(GraphError, match="cycle"):
        Repository(spark, [a, b], handlers)
    with pytest.raises(GraphError, match="no asset makes"):
        Repository(spark, [a], handlers)


def test_external_asset_and_tasks(spark):
    @asset(external=True)
    def outside(spark):
        return spark.range(3)

    repo = Repository(spark, [outside], Handlers(MemoryHandler()))
    assert repo.observe("outside")["rows"] == 3 and repo.plan() == []
    fan = Task(lambda row: [{"id": row["id"], "k": k} for k in range(row["id"])])
    mapped = fan.map(spark.range(4), "id long, k long")
    assert [(r["id"], [i["k"] for i in r["items"]]) for r in sorted(Task.collect(mapped, ["id"], ["k"]).collect())] == [(1, [0]), (2, [0, 1]), (3, [0, 1, 2])]
    assert len(list(Task.stream(mapped))) == 6 and Task(lambda x: x + 1)(1) == 2


def test_checks(spark):
    df = frame(spark, [(1, 5), (2, None)])
    assert check_schema(df, "id long, val string, z int") == ["val: expected string, found bigint", "z: expected int, found None"]
    assert [r["failed_checks"] for r in mark_failures(df, {"known": F.col("val").isNotNull(), "big": F.col("val") > 3}).orderBy("id").collect()] == [[], ["known", "big"]]
