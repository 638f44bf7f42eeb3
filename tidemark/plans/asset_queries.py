"""Queries that go through the IO handlers, the asset API, the table log and the automation loop."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.assets import Asset, Repository, Task, asset, check_schema, graph_asset, mark_failures
from tidemark.functions import partition_keys as K
from tidemark.functions.cron import first_instant
from tidemark.operators import conditions as C
from tidemark.operators import graph as G
from tidemark.operators.partitions import Multi, Static, TimeWindow, daily, hourly
from tidemark.operators.validation import Edge, MappingError, check_edge
from tidemark.plans.condition_queries import FACTS, IDS, facts
from tidemark.plans.registry import CORE
from tidemark.plans.stream_queries import gathered, stream
from tidemark.plans.table_queries import scratch
from tidemark.session import cut_lineage
from tidemark.sources.handlers import (
    AssetSettings, Context, Handlers, KeyValues, MemoryHandler, PickleHandler, RunFlags, TableHandler, convert, schema_from_bytes, schema_to_bytes, to_frame,
)
from tidemark.sources.tables import table
from tidemark.sources.versioned import TableExists, TableSet, VersionedTable, enqueue
from tidemark.streaming.automation import Automation, Request, Schedule, Sensor, Skip, preview
from tidemark.streaming.events import EventBuffer, sessions
from tidemark.streaming.standing import Standing

NATION = "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"
WANTED = AssetSettings(columns=["n_nationkey", "n_name"])


def stored_nation(spark: SparkSession, d: str) -> tuple[TableHandler, Context]:
    """The nations as an asset in a table, and a read of one region's, two columns."""
    handler, definition = TableHandler(spark, scratch(spark)), Static(tuple("01234"))
    nation = table(spark, d, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    handler.handle_output(Context("nation", None, "n_regionkey", definition), nation)
    return handler, Context("nation", ["1"], "n_regionkey", definition, WANTED)


def loaded_as(name: str, kind: type) -> None:
    """Register a query: a table loaded as a Python type, which the annotation of a function asks for, and stored again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        handler, context = stored_nation(spark, d)
        value = convert(handler.load_input(spark, context), kind)
        if not isinstance(value, kind):
            raise TypeError(type(value).__name__)
        return to_frame(spark, value)

    CORE.query(name, NATION)(run)


loaded_as("scan_as_arrow", pa.Table)
loaded_as("scan_as_record_batches", pa.RecordBatchReader)
loaded_as("scan_as_pandas", pd.DataFrame)
loaded_as("scan_as_rows", list)


@CORE.query("scan_as_polars", NATION)
def scan_as_polars(spark: SparkSession, d: str) -> DataFrame:
    """By way of Polars where it is installed, else by Arrow, which its handler goes through."""
    handler, context = stored_nation(spark, d)
    try:
        import polars
    except ImportError:
        return to_frame(spark, convert(handler.load_input(spark, context), pa.Table))
    return to_frame(spark, convert(handler.load_input(spark, context), polars.LazyFrame))


@CORE.query("type_dispatch", "SELECT * FROM (VALUES ('DataFrame', 'DataFrame'), ('Derived', 'DataFrame'), ('None', 'DataFrame'), ('Table', 'Table'), ('int', 'TypeError'), ('list', 'list')) v(wanted, given)")
def type_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """What each annotation is given; a subclass is served as its base, an unknown type is an error."""

    class Derived(pd.DataFrame):
        pass

    region = table(spark, d, "region")
    found = []
    for wanted in (None, pd.DataFrame, Derived, pa.Table, list, int):
        try:
            given = type(convert(region, wanted)).__name__
        except TypeError as error:
            given = type(error).__name__
        found.append(("None" if wanted is None else wanted.__name__, given))
    return spark.createDataFrame(found, "wanted string, given string")


@CORE.query(
    "write_mode_outcomes",
    """SELECT * FROM (SELECT 0 AS step, 'error' AS mode, 'version 0' AS outcome, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 1, 'error', 'TableExists', (SELECT count(*) FROM nation)
 UNION ALL SELECT 2, 'ignore', 'nothing', (SELECT count(*) FROM nation) UNION ALL SELECT 3, 'create_or_replace', 'version 1', (SELECT count(*) FROM region) UNION ALL SELECT 4, 'append', 'version 2', 2 * (SELECT count(*) FROM region))""",
)
def write_mode_outcomes(spark: SparkSession, d: str) -> DataFrame:
    target = VersionedTable(spark, scratch(spark))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    found = []
    for step, (mode, rows) in enumerate([("error", nation), ("error", region), ("ignore", region), ("create_or_replace", region), ("append", region)]):
        try:
            stats = target.write(rows, mode)
            outcome = "nothing" if stats is None else f"version {stats.version}"
        except TableExists as error:
            outcome = type(error).__name__
        found.append((step, mode, outcome, target.read().count()))
    return spark.createDataFrame(found, "step int, mode string, outcome string, n long")


@CORE.query("physical_partitions", "SELECT 'c_mktsegment=' || replace(c_mktsegment, ' ', '%20') AS folder, count(*) AS n FROM customer GROUP BY 1")
def physical_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The folders that a table by market segment has, from the paths of its files."""
    target = VersionedTable(spark, scratch(spark), ["c_mktsegment"])
    target.write(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    folder = F.regexp_extract(F.col("_metadata.file_path"), "(c_mktsegment=[^/]+)/", 1)
    place = target._place(target.manifest()["parts"][0])
    return spark.read.parquet(place).select(F.replace(F.replace(folder, F.lit("%2520"), F.lit("%20")), F.lit(" "), F.lit("%20")).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("root_name_override", "SELECT 'renamed' AS folder, count(*) AS n FROM region")
def root_name_override(spark: SparkSession, d: str) -> DataFrame:
    handler = TableHandler(spark, scratch(spark), "append")
    context = Context("region", settings=AssetSettings(root_name="renamed", mode="overwrite"))
    for _ in range(2):  # the asset's mode wins over the handler's
        handler.handle_output(context, table(spark, d, "region"))
    other = VersionedTable(spark, f"{handler.root}/renamed")
    return other.read().agg(F.lit(other.root.rsplit("/", 1)[1]).alias("folder"), F.count(F.lit(1)).alias("n"))


@CORE.query("memory_partitions", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def memory_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Three partitions stored at once, two of them loaded."""
    handler, definition = MemoryHandler(), Static(tuple("01234"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    handler.handle_output(Context("nation", ["0", "1", "3"], "n_regionkey", definition), nation)
    return handler.load_input(spark, Context("nation", ["1", "3"], "n_regionkey", definition))


@CORE.query("pickled_value", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def pickled_value(spark: SparkSession, d: str) -> DataFrame:
    """A Python value of one asset, stored by one handler object and read by another."""
    root, counts = scratch(spark), {r[0]: r[1] for r in table(spark, d, "nation").groupBy("n_regionkey").count().collect()}
    PickleHandler(spark, root).handle_output(Context("counts", ["2024"]), counts)
    found = PickleHandler(spark, root).load_input(spark, Context("counts", ["2024"]))
    return spark.createDataFrame(list(found.items()), "region long, n long").select(F.col("region").cast(table(spark, d, "nation").schema["n_regionkey"].dataType).alias("region"), "n")


@CORE.query("handler_chain", "SELECT * FROM (VALUES ('input', 'upstream', 'input'), ('-', 'upstream', 'upstream'), ('-', '-', 'default'), ('unknown', 'upstream', 'KeyError')) v(of_input, of_upstream, taken)")
def handler_chain(spark: SparkSession, d: str) -> DataFrame:
    """An input's own handler, else its upstream's, else the default."""
    named = {n: MemoryHandler() for n in ("input", "upstream")}
    handlers = Handlers(MemoryHandler(), named)
    name = {id(handlers.default): "default", **{id(h): n for n, h in named.items()}}
    found = []
    for of_input, of_upstream in (("input", "upstream"), (None, "upstream"), (None, None), ("unknown", "upstream")):
        try:
            taken = name[id(handlers.for_input(of_input, of_upstream))]
        except KeyError:
            taken = "KeyError"
        found.append((of_input or "-", of_upstream or "-", taken))
    return spark.createDataFrame(found, "of_input string, of_upstream string, taken string")


@CORE.query("schema_ipc", "SELECT CAST(ordinal_position - 1 AS INTEGER) AS place, column_name AS name FROM information_schema.columns WHERE table_name = 'lineitem'")
def schema_ipc(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a schema that went through an Arrow message."""
    schema = table(spark, d, "lineitem").schema
    back = schema_from_bytes(schema_to_bytes(schema))
    if [f.dataType for f in back] != [f.dataType for f in schema]:
        raise TypeError("the types differ")
    return spark.createDataFrame(list(enumerate(back.names)), "place int, name string")


@CORE.query("key_values", "SELECT * FROM (VALUES ('r1', 'Failure', false), ('r2', NULL, true)) v(run_id, outcome, cancelled)")
def key_values(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes and cancellations by run; a later value replaces an earlier one."""
    flags = RunFlags(KeyValues(spark, scratch(spark)))
    flags.finish("r1", "Success")
    flags.finish("r1", "Failure")
    flags.cancel("r2")
    return spark.createDataFrame([(r, flags.outcome(r), flags.cancelled(r)) for r in ("r1", "r2")], "run_id string, outcome string, cancelled boolean")


@CORE.query(
    "enqueue_runs",
    """SELECT run_id, 'Queued' AS status, 'RunQueued' AS event_type, CAST(CASE WHEN status = 'Queued' THEN 1 ELSE 2 END AS BIGINT) AS queued_at FROM runs WHERE status IN ('Queued', 'NotStarted')""",
)
def enqueue_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs and their events in one commit; the second call brings all waiting runs, and only new ones are added."""
    tables = TableSet(spark, scratch(spark))
    waiting = table(spark, d, "runs").filter("status IN ('Queued', 'NotStarted')").select("run_id", "code_location_id", "status")
    enqueue(tables, waiting.filter("status = 'Queued'").drop("status"), 1)
    enqueue(tables, waiting.drop("status"), 2)
    return tables.read("runs").join(tables.read("events"), "run_id").select("run_id", "status", "event_type", F.col("timestamp").alias("queued_at"))


@CORE.query("buffered_events", "SELECT count(*) AS n_events, CAST(ceil(count(*) / 64.0) AS BIGINT) AS n_commits FROM supplier")
def buffered_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of a program, appended 64 at a time and at the end."""
    events = VersionedTable(spark, scratch(spark))
    with EventBuffer(events, "event_type string, supplier long", wait_s=float("inf")) as buffer:
        for r in table(spark, d, "supplier").select("s_suppkey").toLocalIterator():
            buffer.add("StepStart", r[0])
    return events.read().agg(F.count(F.lit(1)).alias("n_events"), F.lit(len(events.versions())).cast("long").alias("n_commits"))


@CORE.query(
    "members_preview",
    "SELECT 'region=' || lower(r_name) || ',x|date=a,b' AS k, unnest(['date=a|region=' || lower(r_name), 'date=a|region=x', 'date=b|region=' || lower(r_name)]) AS member FROM region",
)
def members_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first three of the four concrete keys of a batch key."""
    keys = table(spark, d, "region").select(F.concat(F.lit("region="), F.lower("r_name"), F.lit(",x|date=a,b")).alias("k"))
    return keys.select("k", F.explode(K.members_preview(F.col("k"), 3)).alias("member"))


WALL = [("2024-03-10 01:30", 1710052200), ("2024-03-10 02:30", 1710054000), ("2024-03-10 03:00", 1710054000), ("2024-11-03 00:30", 1730608200), ("2024-11-03 01:30", 1730611800), ("2024-11-03 02:30", 1730619000)]


@CORE.query("wall_clock_instants", f"SELECT * FROM (VALUES {', '.join(f'({w!r}, CAST({s} AS BIGINT))' for w, s in WALL)}) v(wall, seconds)")
def wall_clock_instants(spark: SparkSession, d: str) -> DataFrame:
    """Instants of New York wall times: one in the gap counts at its end, one that comes twice at the first."""
    zone = ZoneInfo("America/New_York")
    return spark.createDataFrame([(w, int(first_instant(zone, datetime.fromisoformat(w)).timestamp())) for w, _ in WALL], "wall string, seconds long")


@CORE.query("condition_fingerprints", "SELECT * FROM (VALUES ('same tree', true), ('other tree', false), ('label swapped', false), ('swapped back', true), ('operand left out', true), ('named', false)) v(change, same)")
def condition_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Whether rewriting a tree leaves its fingerprint."""
    tree, was = C.eager(), C.eager().fingerprint()
    cases = {
        "same tree": tree, "other tree": C.on_missing(), "label swapped": tree.swap("any_deps_missing", C.FAILED), "swapped back": tree.swap(C.MISSING, C.REQUESTED).swap(C.REQUESTED, C.MISSING),
        "operand left out": (tree & C.MISSING).without(C.MISSING), "named": tree.named("mine"),
    }
    return spark.createDataFrame([(n, t.fingerprint() == was) for n, t in cases.items()], "change string, same boolean")


@CORE.query(
    "evaluation_trace",
    f"""WITH {FACTS}, c AS (SELECT tick, count(*) AS n, count(*) FILTER (failed AND NOT in_progress) AS a, count(*) FILTER (failed) AS b, count(*) FILTER (NOT in_progress) AS c, count(*) FILTER (in_progress) AS d FROM facts GROUP BY tick)
SELECT tick, unnest(['', '0', '1', '1.0']) AS path, unnest(['All', 'execution_failed', 'Not', 'in_progress']) AS node, unnest(['top', NULL, NULL, NULL]) AS label, unnest([a, b, c, d]) AS n_true, n AS n_cells FROM c""",
)
def evaluation_trace(spark: SparkSession, d: str) -> DataFrame:
    """How many assets fulfil each node of a tree, tick by tick."""
    return C.Evaluation(facts(spark, d), IDS).trace((C.FAILED & ~C.IN_PROGRESS).named("top"))


DAY = timedelta(days=1)
FORMATS = [(DAY, "%Y-%m-%d", True), (timedelta(hours=6), "%Y-%m-%d", False), (timedelta(hours=1), "%Y-%m-%dT%H:00", True), (DAY, "%Y|%m|%d", False), (DAY, "%d", False), (DAY, "%Y%j", True)]


@CORE.query("format_round_trips", f"SELECT * FROM (VALUES {', '.join(f'(CAST({int(e.total_seconds())} AS BIGINT), {f!r}, {str(ok).lower()})' for e, f, ok in FORMATS)}) v(every_s, fmt, valid)")
def format_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Whether the keys of a grid lead back to its windows and hold no reserved character."""
    found = []
    for every, fmt, _ in FORMATS:
        try:
            TimeWindow(datetime(2024, 1, 1), datetime(2026, 1, 1), every, fmt=fmt)
            found.append((int(every.total_seconds()), fmt, True))
        except ValueError:
            found.append((int(every.total_seconds()), fmt, False))
    return spark.createDataFrame(found, "every_s long, fmt string, valid boolean")


EDGES = ["identity", "finer", "narrower", "wider", "unpartitioned below", "all below", "mapping above", "by dimension", "unknown dimension", "known key", "unknown key"]
VALID = dict.fromkeys(("identity", "wider", "all below", "by dimension", "known key"), True)


@CORE.query("edge_validation", f"SELECT * FROM (VALUES {', '.join(f'({e!r}, {str(VALID.get(e, False)).lower()})' for e in EDGES)}) v(edge, valid)")
def edge_validation(spark: SparkSession, d: str) -> DataFrame:
    """Whether mappings connect the definitions at their ends."""
    day, hour = daily(datetime(2024, 1, 1), datetime(2024, 2, 1)), hourly(datetime(2024, 1, 1), datetime(2024, 2, 1))
    eu, world = Static(("eu",)), Static(("eu", "us"))
    both = Multi({"d": day, "r": world})
    edge = lambda *x: Edge("a", "b", *x)
    cases = [
        (edge(), day, day), (edge(), day, hour), (edge(), world, eu), (edge(), eu, world), (edge(), None, day), (edge("all"), None, day), (edge("all"), day, None),
        (edge("multi", (("d", "d"),)), both, both), (edge("multi", (("x", "d"),)), both, both), (edge("specific", (), ("us",)), day, world), (edge("specific", (), ("xx",)), day, world),
    ]
    found = []
    for name, case in zip(EDGES, cases, strict=True):
        try:
            check_edge(*case)
            found.append((name, True))
        except MappingError:
            found.append((name, False))
    return spark.createDataFrame(found, "edge string, valid boolean")


@CORE.query("sorted_items", "SELECT n_name AS item, n_nationkey AS place FROM nation")
def sorted_items(spark: SparkSession, d: str) -> DataFrame:
    """Items in any order, each needing the one before it, sorted."""
    names = [r[0] for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    needs = {n: [] if i == 0 else [names[i - 1], "no item"] for i, n in reversed(list(enumerate(names)))}
    kind = table(spark, d, "nation").schema["n_nationkey"].dataType
    placed = spark.createDataFrame([(n, i) for i, n in enumerate(G.sort_items(needs))], "item string, place long")
    return placed.select("item", F.col("place").cast(kind).alias("place"))


def repository(spark: SparkSession, *assets: Asset, **named: TableHandler) -> Repository:
    return Repository(spark, assets, Handlers(TableHandler(spark, scratch(spark)), named))


@CORE.query("asset_run", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def asset_run(spark: SparkSession, d: str) -> DataFrame:
    """Two sources and an asset that names them as parameters, each made in its place of the graph."""

    @asset("by_region")
    def by_region(nation: DataFrame, region: DataFrame) -> DataFrame:
        return nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))

    sources = [Asset(t, lambda t=t: table(spark, d, t), {}) for t in ("nation", "region")]
    made = repository(spark, by_region, *sources)
    outcome = made.materialize(["by_region"], upstream=True)
    if outcome.failed:
        raise RuntimeError(outcome.failed)
    return made.load("by_region")


@CORE.query("multi_output_asset", "SELECT 'low' AS part, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'high', n_name FROM nation WHERE n_nationkey >= 10")
def multi_output_asset(spark: SparkSession, d: str) -> DataFrame:
    """One function, two outputs, each stored and read as an asset of its own."""

    @asset("split", outputs=("low", "high"))
    def split(spark: SparkSession) -> dict[str, DataFrame]:
        nation = table(spark, d, "nation").select("n_nationkey", "n_name")
        return {"low": nation.filter("n_nationkey < 10"), "high": nation.filter("n_nationkey >= 10")}

    made = repository(spark, split)
    if made.materialize().failed:
        raise RuntimeError("the split failed")
    return made.load("low").select(F.lit("low").alias("part"), "n_name").unionByName(made.load("high").select(F.lit("high").alias("part"), "n_name"))


@CORE.query("external_asset", "SELECT count(*) AS n_rows, 3 AS n_columns FROM nation")
def external_asset(spark: SparkSession, d: str) -> DataFrame:
    """An asset that is only looked at: its rows and columns."""
    seen = Asset("nation", lambda spark: table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), {}, external=True)
    made = repository(spark, seen)
    if made.select() != []:
        raise RuntimeError("an external asset isn't made")
    found = made.observe("nation")
    return spark.createDataFrame([(found["rows"], len(schema_names(found["schema"])))], "n_rows long, n_columns int")


def schema_names(text: str) -> list[str]:
    import json

    return [f["name"] for f in json.loads(text)["fields"]]


@CORE.query("asset_events_of_a_run", "SELECT * FROM (VALUES ('good', 'StepStart'), ('good', 'Materialization'), ('good', 'StepSuccess'), ('bad', 'StepStart'), ('bad', 'StepFailure'), ('good', 'hook success'), ('bad', 'hook failure')) v(asset_key, event)")
def asset_events_of_a_run(spark: SparkSession, d: str) -> DataFrame:
    """A run with a failure: events of each step, hooks called (one of which fails itself), what depends on the failure skipped."""
    called = []

    def broken(key: str, _: object) -> None:
        called.append((key, "hook success"))
        raise ValueError("a hook's own fault is no failure of the run")

    good = Asset("good", lambda: table(spark, d, "region"), {}, success=[broken])
    bad = Asset("bad", lambda: 1 / 0, {}, failure=[lambda key, error: called.append((key, "hook failure"))])
    after = Asset("after", lambda bad: bad, {"bad": "bad"})
    outcome = repository(spark, good, bad, after).materialize()
    if set(outcome.failed) != {"bad", "after"}:
        raise RuntimeError(outcome.failed)
    return outcome.frame(spark).select("asset_key", F.col("event_type").alias("event")).unionByName(spark.createDataFrame(called, "asset_key string, event string"))


@CORE.query("return_type_check", "SELECT * FROM (VALUES ('c_mktsegment: expected None, found string'), ('extra: expected int, found None')) v(finding)")
def return_type_check(spark: SparkSession, d: str) -> DataFrame:
    """An output against the columns that its asset promises."""
    made = table(spark, d, "customer").select("c_name", "c_mktsegment")
    return spark.createDataFrame([(f,) for f in check_schema(made, "c_name string, extra int")], "finding string")


@CORE.query(
    "partition_failures",
    """SELECT n_nationkey, list_filter([CASE WHEN NOT (n_regionkey < 3) THEN 'low region' END, CASE WHEN NOT (length(n_name) > 5) THEN 'long name' END], lambda x: x IS NOT NULL) AS failed_checks FROM nation""",
)
def partition_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch that fail a check are marked; the others go on."""
    checks = {"low region": F.col("n_regionkey") < 3, "long name": F.length("n_name") > 5}
    return mark_failures(table(spark, d, "nation"), checks).select("n_nationkey", "failed_checks")


@CORE.query("graph_asset", "SELECT region, CAST(sum(length(n_name)) AS BIGINT) AS letters, count(*) AS n FROM (SELECT n_regionkey AS region, n_name FROM nation) GROUP BY region")
def graph_asset_run(spark: SparkSession, d: str) -> DataFrame:
    """An asset composed of tasks: a step, a fan-out over its rows, a barrier, and a step behind it."""
    schema = f"region {table(spark, d, 'nation').schema['n_regionkey'].dataType.simpleString()}, letters long"
    narrow = Task(lambda rows: rows.select(F.col("n_regionkey").alias("region"), "n_name"))
    count = Task(lambda row: {"region": row["region"], "letters": len(row["n_name"])})
    total = Task(lambda groups: groups.select("region", F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["letters"]).alias("letters"), F.size("items").cast("long").alias("n")))

    @graph_asset("letters")
    def letters(nation):
        return total(Task.collect(count.map(narrow(nation), schema), ["region"], ["letters"]))

    made = repository(spark, letters, Asset("nation", lambda: table(spark, d, "nation"), {}))
    outcome = made.materialize()
    if outcome.failed:
        raise RuntimeError(outcome.failed)
    return made.load("letters")


@CORE.query("composition_steps", "SELECT * FROM (VALUES ('narrow.0', 'nation'), ('count.0', 'narrow.0'), ('collect.0', 'count.0'), ('total.0', 'collect.0'), ('stream.0', 'count.0')) v(step, reads)")
def composition_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps that a graph asset's function records, and what each reads; nothing is run."""

    def named(name: str) -> Task:
        def run(*_: object) -> None:
            raise RuntimeError("composing runs nothing")

        run.__name__ = name
        return Task(run)

    @graph_asset("letters")
    def letters(nation):
        counted = named("count").map(named("narrow")(nation), "n long")
        Task.stream(counted)
        return named("total")(Task.collect(counted, ["region"], ["n"]))

    return spark.createDataFrame(letters.run.composition.edges(), "step string, reads string")


NS = 1_000_000_000
T0 = int(datetime(2024, 3, 10, tzinfo=UTC).timestamp())


@CORE.query(
    "automation_ticks",
    f"""WITH h AS (SELECT CAST(range AS BIGINT) AS i, ({T0} + 3600 * range) * {NS} AS t FROM range(0, 30)),
s AS (SELECT i, t, i // 3 AS n FROM h WHERE i % 3 = 0)
SELECT 'noon' AS automation, 'started' AS status, t AS at, CAST(0 AS BIGINT) AS n_requests, CAST(NULL AS VARCHAR) AS reason FROM h WHERE i = 0
UNION ALL SELECT 'noon', 'success', t, 1, NULL FROM h WHERE i = 12
UNION ALL SELECT 'files', CASE WHEN n % 3 = 1 THEN 'skipped' ELSE 'success' END, t, CASE WHEN n % 3 = 1 THEN 0 WHEN n = 0 THEN 2 ELSE 1 END, CASE WHEN n % 3 = 1 THEN 'nothing new' END FROM s""",
)
def automation_ticks(spark: SparkSession, d: str) -> DataFrame:
    """A daily schedule and a sensor every three hours, ticked each hour of 30; the sensor has a cursor and asks for one key again and again."""

    def sense(tick):
        n = int(tick.cursor or 0)
        tick.cursor = str(n + 1)
        return Skip("nothing new") if n % 3 == 1 else [Request("always"), Request(f"file-{n}")]

    loop = Automation(VersionedTable(spark, scratch(spark)), [Schedule("noon", "0 12 * * *", lambda t: [Request(str(t.now_ns))])], [Sensor("files", sense, every_s=3 * 3600)])
    for hour in range(30):
        loop.tick((T0 + 3600 * hour) * NS)
    return loop.table.read().select("automation", "status", F.col("timestamp").alias("at"), F.size("requests").cast("long").alias("n_requests"), "reason")


@CORE.query("cron_preview", f"SELECT * FROM (VALUES ('gap', CAST({T0 + 7 * 3600} AS BIGINT)), ('monthly', CAST({int(datetime(2024, 4, 1, tzinfo=UTC).timestamp())} AS BIGINT)), ('noon', CAST({T0 + 12 * 3600} AS BIGINT))) v(schedule, seconds)")
def cron_preview(spark: SparkSession, d: str) -> DataFrame:
    """The next tick of several schedules; one of them falls into a gap of the clock."""
    found = preview({"noon": ("0 12 * * *", None), "gap": ("30 2 * * *", "America/New_York"), "monthly": ("@monthly", None)}, T0 * NS)
    return spark.createDataFrame([(k, v // NS) for k, v in found.items()], "schedule string, seconds long")


@CORE.query(
    "stream_sessions",
    """WITH e AS (SELECT DISTINCT event_id, run_id, timestamp // 1000 AS t FROM asset_events WHERE run_id IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 3600000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY run_id ORDER BY t, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY t, event_id) AS session FROM g)
SELECT run_id, make_timestamp(min(t)) AS session_start, count(*) AS n FROM s GROUP BY run_id, session""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events of a run, as a stream: sessions close when the watermark has passed them."""
    bursts = gathered(spark, sessions(stream(spark, d).filter("run_id IS NOT NULL")), "complete")
    last = bursts.agg(F.max("batch_id")).first()[0]
    return bursts.filter(F.col("batch_id") == (last if last is not None else -1)).select("run_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@CORE.query(
    "standing_ticks",
    f"""WITH {FACTS}, w AS (SELECT *, lag(failed) OVER k AS was FROM facts WHERE tick BETWEEN 40 AND 42 WINDOW k AS (PARTITION BY key, code_location_id ORDER BY tick))
SELECT key, code_location_id, tick FROM w WHERE failed AND NOT coalesce(was, false)""",
)
def standing_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Three ticks, each begun and finished by itself: what the tick before left behind comes from tables."""
    root, found = scratch(spark), []
    state = cut_lineage(facts(spark, d).filter("tick BETWEEN 40 AND 42"))
    for tick in (40, 41, 42):
        standing = Standing(spark, root, C.FAILED.newly_true(), IDS)
        fired = standing.begin(state.filter(F.col("tick") == tick).drop("tick", "tick_ns", "handled_tick"), tick)
        standing.finish(fired)
        found.append(fired.withColumn("tick", F.lit(tick).cast("long")))
    return found[0].unionByName(found[1]).unionByName(found[2])
