"""Queries over automation conditions, replayed day by day from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import conditions as C
from tidemark.operators import runs as R
from tidemark.operators.graph import topological_levels
from tidemark.plans.graph_queries import ORDERED
from tidemark.plans.graph_queries import PAIRS as DAG_PAIRS
from tidemark.plans.graph_queries import edges as dag_edges
from tidemark.plans.graph_queries import nodes as dag_nodes
from tidemark.plans.registry import CORE
from tidemark.session import cut_lineage
from tidemark.sources.tables import table

IDS = ["key", "code_location_id"]
DAY0 = 20_045  # 2024-11-18 as days since 1970, which is tick 0; there is a tick at the end of each day
DAY_NS = 86_400_000_000_000


def facts(spark: SparkSession, d: str) -> DataFrame:
    """State of each asset at the end of each day: running maxima over the days, one row per asset and day.

    The days are those from the first to the last event of the log.
    """
    kind, at = F.col("event_type"), F.col("timestamp")
    day = (F.floor(at / F.lit(DAY_NS)) - DAY0).cast("int")
    span = table(spark, d, "asset_events").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    ticks = F.explode(F.sequence("first", "last")).alias("tick")
    grid = table(spark, d, "assets").crossJoin(F.broadcast(span)).select(F.col("asset_key").alias("key"), "code_location_id", "code_version", ticks)
    events = table(spark, d, "asset_events").filter(F.col("asset_key").isNotNull() & kind.isin("Materialization", "StepStart", "StepSuccess", "StepFailure"))
    daily = events.groupBy(F.col("asset_key").alias("key"), "code_location_id", day.alias("tick")).agg(
        F.max(F.when(kind == "Materialization", F.struct("timestamp", "event_id", "data_version", F.col("code_version").alias("made_with"), "run_id"))).alias("m"),
        F.max(F.when(kind == "StepFailure", at)).alias("f"),
        F.max(F.when(kind == "StepStart", at)).alias("s"),
        F.max(F.when(kind.isin("StepSuccess", "StepFailure"), at)).alias("e"),
    )
    so_far = W.partitionBy(*IDS).orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = grid.join(daily, [*IDS, "tick"], "left").withColumn("asked", F.when(F.col("s").isNotNull(), F.col("tick")))
    state = rows.select(*IDS, "tick", "code_version", *(F.max(c).over(so_far).alias(c) for c in ("m", "f", "s", "e")), F.max("asked").over(so_far).alias("handled_tick"))
    return state.select(
        *IDS, F.col("tick").cast("long").alias("tick"), "code_version",
        F.col("m.run_id").alias("last_run_id"), F.col("m.timestamp").alias("last_timestamp"), F.col("m.data_version").alias("data_version"), F.col("m.made_with").alias("made_with_code_version"), F.col("f").alias("failed_timestamp"),
        F.coalesce(F.col("f").isNotNull() & (F.col("m").isNull() | (F.col("m.timestamp") < F.col("f"))), F.lit(False)).alias("failed"),
        F.coalesce(F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") < F.col("s"))), F.lit(False)).alias("in_progress"),
        F.col("handled_tick").cast("long").alias("handled_tick"),
        ((F.col("tick") + DAY0 + 1).cast("long") * DAY_NS).alias("tick_ns"),
    )


FACTS = f"""days AS (SELECT unnest(range(min(timestamp // {DAY_NS}) - {DAY0}, max(timestamp // {DAY_NS}) - {DAY0} + 1)) AS tick FROM asset_events),
g AS (SELECT asset_key AS key, code_location_id, code_version, CAST(tick AS BIGINT) AS tick FROM assets, days),
v AS (SELECT asset_key AS key, code_location_id, timestamp // {DAY_NS} - {DAY0} AS tick, max(timestamp) FILTER (event_type = 'Materialization') AS m,
 max((timestamp, event_id, coalesce(data_version, ''), coalesce(code_version, ''))) FILTER (event_type = 'Materialization') AS ms,
 max(timestamp) FILTER (event_type = 'StepFailure') AS f, max(timestamp) FILTER (event_type = 'StepStart') AS s, max(timestamp) FILTER (event_type IN ('StepSuccess', 'StepFailure')) AS e
 FROM asset_events WHERE asset_key IS NOT NULL GROUP BY ALL),
r AS (SELECT g.*, max(m) OVER w AS m, max(f) OVER w AS f, max(s) OVER w AS s, max(e) OVER w AS e, max(CASE WHEN s IS NOT NULL THEN tick END) OVER w AS h, max(ms) OVER w AS ms
 FROM g LEFT JOIN v USING (key, code_location_id, tick) WINDOW w AS (PARTITION BY key, code_location_id ORDER BY tick)),
facts AS (SELECT *, m IS NULL AS missing, coalesce(f IS NOT NULL AND (m IS NULL OR m < f), false) AS failed, coalesce(s IS NOT NULL AND (e IS NULL OR e < s), false) AS in_progress,
 coalesce(CASE WHEN lag(m) OVER w IS NOT NULL THEN m > lag(m) OVER w ELSE m IS NOT NULL AND lag(tick) OVER w IS NOT NULL END, false) AS updated,
 lag(tick) OVER w AS prev FROM r WINDOW w AS (PARTITION BY key, code_location_id ORDER BY tick))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies as the assets' last runs consumed them; an asset's own previous output is none."""
    rows = table(spark, d, "assets").select("code_location_id", F.col("asset_key").alias("from_key"), F.explode("last_input_data_versions").alias("p"))
    return rows.select("code_location_id", "from_key", F.col("p.k").alias("to_key")).filter("from_key <> to_key").distinct()


EDGES = "edges AS (SELECT DISTINCT code_location_id, asset_key AS f, p.k AS t FROM (SELECT *, unnest(last_input_data_versions) AS p FROM assets) WHERE p.k <> asset_key)"
OUT = "SELECT key, code_location_id, tick FROM"


def replay(name: str, tree: C.Node, sql: str) -> None:
    """Register a query: the cells and ticks at which a tree fires."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.Evaluation(facts(spark, d), IDS, edges(spark, d)).run(tree).filter("fired").drop("fired")

    CORE.query(name, f"WITH {FACTS}, {EDGES} {sql}")(run)


replay("cond_missing", C.MISSING, f"{OUT} facts WHERE missing")
replay("cond_in_progress", C.IN_PROGRESS, f"{OUT} facts WHERE in_progress")
replay("newly_updated", C.UPDATED, f"{OUT} facts WHERE updated")
replay("newly_true", C.FAILED.newly_true(), f"{OUT} (SELECT *, lag(failed) OVER (PARTITION BY key, code_location_id ORDER BY tick) AS was FROM facts) WHERE failed AND NOT coalesce(was, false)")
replay("cond_newly_requested", C.REQUESTED, f"{OUT} facts WHERE h = prev")
replay(
    "since_latch",
    C.FAILED.since(C.UPDATED),
    f"{OUT} (SELECT *, coalesce(max(tick) FILTER (failed) OVER w, -1) AS a, coalesce(max(tick) FILTER (updated) OVER w, -1) AS b FROM facts WINDOW w AS (PARTITION BY key, code_location_id ORDER BY tick)) WHERE a > b",
)
replay("since_last_handled", C.UPDATED.since_last_handled(), f"{OUT} facts WHERE updated AND (h IS NULL OR coalesce(h < prev, true))")
replay(
    "data_version_changed",
    C.Fact("data_version_changed"),
    f"{OUT} (SELECT *, lag(ms) OVER (PARTITION BY key, code_location_id ORDER BY tick) AS was FROM facts) WHERE ms[3] <> '' AND CASE WHEN was[3] <> '' THEN ms[3] <> was[3] ELSE prev IS NOT NULL AND was[1] IS DISTINCT FROM ms[1] END",
)
replay(
    "code_version_changed",
    C.Fact("code_version_changed") | (C.Fact("initial_evaluation") & C.MISSING),
    f"{OUT} facts WHERE (code_version IS NOT NULL AND code_version IS DISTINCT FROM nullif(ms[4], '')) OR (prev IS NULL AND missing)",
)
DEPS = "FROM facts a JOIN edges x ON x.f = a.key AND x.code_location_id = a.code_location_id JOIN facts b ON b.key = x.t AND b.code_location_id = a.code_location_id AND b.tick = a.tick"
NEWER = "(b.m IS NOT NULL AND (greatest(a.m, a.f) IS NULL OR b.m > greatest(a.m, a.f)))"
replay("any_deps_match", C.Deps("any", C.FAILED), f"SELECT a.key, a.code_location_id, a.tick {DEPS} GROUP BY ALL HAVING bool_or(b.failed)")
# A dependency that is no asset fulfils nothing, so not all do.
WANTED = "w AS (SELECT f AS key, code_location_id, count(*) AS wanted FROM edges GROUP BY ALL)"
replay(
    "all_deps_match",
    C.Deps("all", C.UPDATED),
    f", {WANTED}, q AS (SELECT a.key, a.code_location_id, a.tick, bool_and({NEWER}) AS ok, count(*) AS seen {DEPS} GROUP BY ALL) {OUT} facts LEFT JOIN w USING (key, code_location_id) LEFT JOIN q USING (key, code_location_id, tick) WHERE coalesce(ok, true) AND coalesce(seen, 0) = coalesce(wanted, 0)",
)
replay(
    "asset_matches",
    C.AssetMatches(("raw_page_hits", "stg_page_hits"), C.IN_PROGRESS),
    f", q AS (SELECT code_location_id, tick, bool_or(in_progress) AS ok FROM facts WHERE key IN ('raw_page_hits', 'stg_page_hits') GROUP BY ALL) {OUT} facts JOIN q USING (code_location_id, tick) WHERE ok",
)
NT = "missing AND NOT coalesce(lag(missing) OVER (PARTITION BY key, code_location_id ORDER BY tick), false)"
UNHANDLED = "(h IS NULL OR coalesce(h < prev, true))"
replay(
    "cond_on_missing",
    C.on_missing(),
    f", q AS (SELECT a.key, a.code_location_id, a.tick, bool_or(b.missing) AS bad {DEPS} GROUP BY ALL), n AS (SELECT *, {NT} AS nt FROM facts) {OUT} n LEFT JOIN q USING (key, code_location_id, tick) WHERE nt AND {UNHANDLED} AND NOT coalesce(bad, false) AND NOT failed",
)
replay(
    "cond_eager",
    C.eager(),
    f""", q AS (SELECT a.key, a.code_location_id, a.tick, bool_or({NEWER}) AS newer, bool_or(b.missing) AS bad, bool_or(b.in_progress) AS busy {DEPS} GROUP BY ALL), n AS (SELECT *, {NT} AS nt FROM facts)
 {OUT} n LEFT JOIN q USING (key, code_location_id, tick) WHERE (nt OR coalesce(newer, false)) AND {UNHANDLED} AND NOT coalesce(bad, false) AND NOT coalesce(busy, false) AND NOT in_progress AND NOT failed""",
)


NAMED = ("raw_page_hits", "stg_page_hits")
IN_NAMED = "b.key IN ('raw_page_hits', 'stg_page_hits')"
replay(
    "asset_matches_updated",
    C.AssetMatches(NAMED, C.UPDATED),
    f""" SELECT DISTINCT a.key, a.code_location_id, a.tick FROM facts a JOIN facts b ON b.code_location_id = a.code_location_id AND b.tick = a.tick AND {IN_NAMED}
 WHERE CASE WHEN a.key = b.key THEN b.updated ELSE {NEWER} END""",
)
replay(
    "deps_asset_matches",
    C.Deps("any", C.AssetMatches(NAMED, C.UPDATED)),
    f""" SELECT DISTINCT a.key, a.code_location_id, a.tick FROM facts a JOIN edges x ON x.f = a.key AND x.code_location_id = a.code_location_id
 JOIN facts m ON m.key = x.t AND m.code_location_id = a.code_location_id AND m.tick = a.tick JOIN facts b ON b.code_location_id = a.code_location_id AND b.tick = a.tick AND {IN_NAMED}
 WHERE CASE WHEN a.key = b.key THEN b.updated ELSE {NEWER} END""",
)
replay(
    "deps_of_deps",
    C.Deps("any", C.Deps("any", C.UPDATED)),
    f""" SELECT DISTINCT a.key, a.code_location_id, a.tick FROM facts a JOIN edges x ON x.f = a.key AND x.code_location_id = a.code_location_id
 JOIN facts m ON m.key = x.t AND m.code_location_id = a.code_location_id AND m.tick = a.tick JOIN edges y ON y.f = m.key AND y.code_location_id = a.code_location_id
 JOIN facts b ON b.key = y.t AND b.code_location_id = a.code_location_id AND b.tick = a.tick WHERE CASE WHEN a.key = b.key THEN b.updated ELSE {NEWER} END""",
)
replay(
    "cond_newly_true_deps",
    C.Deps("any", C.UPDATED.newly_true()),
    f""", p AS (SELECT a.key, a.code_location_id, a.tick, b.key AS dep, {NEWER} AS nw {DEPS}),
n AS (SELECT *, nw AND NOT coalesce(lag(nw) OVER (PARTITION BY key, code_location_id, dep ORDER BY tick), false) AS rise FROM p) SELECT DISTINCT key, code_location_id, tick FROM n WHERE rise""",
)
# A tick ends a UTC day, so Monday noon in Berlin lies between the ticks of Sunday and of Monday.
MONDAY = f"isodow(DATE '1970-01-01' + CAST(tick + {DAY0} AS INTEGER)) = 1"
replay(
    "cond_on_cron",
    C.on_cron("0 12 * * 1", "Europe/Berlin"),
    f""", {WANTED}, c AS (SELECT *, prev IS NOT NULL AND {MONDAY} AS cr FROM facts),
o AS (SELECT *, max(tick) FILTER (cr) OVER k AS a, max(tick) FILTER ((coalesce(h = prev, false) OR updated) AND NOT cr) OVER k AS b FROM c WINDOW k AS (PARTITION BY key, code_location_id ORDER BY tick)),
p AS (SELECT a.key, a.code_location_id, a.tick, b.key AS dep, {NEWER} AS nw, a.cr {DEPS.replace("facts a", "c a")}),
l AS (SELECT *, max(tick) FILTER (nw) OVER k AS on_at, max(tick) FILTER (cr) OVER k AS off_at FROM p WINDOW k AS (PARTITION BY key, code_location_id, dep ORDER BY tick)),
q AS (SELECT key, code_location_id, tick, bool_and(coalesce(on_at > coalesce(off_at, -1000000), false)) AS ok, count(*) AS seen FROM l GROUP BY ALL)
{OUT} o LEFT JOIN w USING (key, code_location_id) LEFT JOIN q USING (key, code_location_id, tick)
WHERE coalesce(a > coalesce(b, -1000000), false) AND coalesce(ok, true) AND coalesce(seen, 0) = coalesce(wanted, 0) AND NOT in_progress""",
)


@CORE.query("cron_tick_passed", f"WITH {FACTS} SELECT DISTINCT tick FROM facts WHERE prev IS NOT NULL AND {MONDAY}")
def cron_tick_passed(spark: SparkSession, d: str) -> DataFrame:
    """Days with an occurrence of Mondays at noon, Berlin time, since the day before."""
    return C.Evaluation(facts(spark, d), IDS).run(C.CronTickPassed("0 12 * * 1", "Europe/Berlin")).filter("fired").select("tick").distinct()


def last_runs(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of each asset, from the node lists of the runs."""
    nodes = table(spark, d, "runs").select(F.explode("node_names").alias("key"), "code_location_id", "start_time", "run_id", "tags", "node_names")
    return R.latest_per(nodes, IDS, ["start_time", "run_id"], ["run_id", "tags", "node_names"]).select(*IDS, F.lit(0).cast("long").alias("tick"), F.col("tags").alias("last_run_tags"), F.col("node_names").alias("last_run_nodes"))


LAST = """l AS (SELECT key, code_location_id, tags, node_names FROM (SELECT *, unnest(node_names) AS key FROM runs) QUALIFY row_number() OVER (PARTITION BY key, code_location_id ORDER BY start_time DESC, run_id DESC) = 1)"""


@CORE.query("last_executed_with_tags", f"WITH {LAST} SELECT key, code_location_id FROM l WHERE len(list_filter(tags, lambda t: t.k = 'env' AND t.v = 'prod')) > 0")
def last_executed_with_tags(spark: SparkSession, d: str) -> DataFrame:
    tree = C.RunTags("last", pairs=(("env", "prod"),))
    return C.Evaluation(last_runs(spark, d), IDS).run(tree).filter("fired").select(*IDS)


@CORE.query("last_run_includes_target", f"WITH {LAST}, {EDGES} SELECT DISTINCT x.f AS key, x.code_location_id FROM edges x JOIN l b ON b.key = x.t AND b.code_location_id = x.code_location_id JOIN l a ON a.key = x.f AND a.code_location_id = x.code_location_id WHERE list_contains(b.node_names, x.f)")
def last_run_includes_target(spark: SparkSession, d: str) -> DataFrame:
    """Assets with a dependency whose last run made the asset too."""
    tree = C.Deps("any", C.SAME_RUN)
    return C.Evaluation(last_runs(spark, d), IDS, edges(spark, d)).run(tree).filter("fired").select(*IDS)


def tick_tags(spark: SparkSession, d: str) -> DataFrame:
    """Per asset and day the different tag lists of the runs that began; equal ones count once, before the shuffle."""
    day = (F.floor(F.col("start_time") / F.lit(DAY_NS)) - DAY0).cast("long")
    rows = table(spark, d, "runs").select(F.explode(F.array_distinct("node_names")).alias("key"), "code_location_id", day.alias("tick"), "tags")
    return rows.groupBy(*IDS, "tick").agg(F.collect_set("tags").alias("tick_run_tags"))


TICKS = f"t AS (SELECT unnest(list_distinct(node_names)) AS key, code_location_id, start_time // {DAY_NS} - {DAY0} AS tick, len(list_filter(tags, lambda t: t.k = 'team')) > 0 AS ok FROM runs)"


@CORE.query("has_run_with_tags", f"WITH {TICKS} SELECT key, code_location_id, tick FROM t GROUP BY ALL HAVING bool_or(ok)")
def has_run_with_tags(spark: SparkSession, d: str) -> DataFrame:
    return C.Evaluation(tick_tags(spark, d), IDS).run(C.RunTags("any", keys=("team",))).filter("fired").drop("fired")


@CORE.query("all_runs_have_tags", f"WITH {TICKS} SELECT key, code_location_id, tick FROM t GROUP BY ALL HAVING bool_and(ok)")
def all_runs_have_tags(spark: SparkSession, d: str) -> DataFrame:
    return C.Evaluation(tick_tags(spark, d), IDS).run(C.RunTags("all", keys=("team",))).filter("fired").drop("fired")


@CORE.query("backfill_in_progress", "SELECT DISTINCT code_location_id, asset_key FROM (SELECT code_location_id, asset_key, unnest(backfill_ids) AS b FROM pending_dispatch)")
def backfill_in_progress(spark: SparkSession, d: str) -> DataFrame:
    """Assets with a dispatch entry that names a backfill."""
    return table(spark, d, "pending_dispatch").filter(F.size("backfill_ids") > 0).select("code_location_id", "asset_key").distinct()


@CORE.query(
    "will_be_requested",
    f"""{DAG_PAIRS}, {ORDERED}, w AS (SELECT key FROM ordered JOIN nodes USING (key) WHERE last_data_version IS NULL UNION SELECT e.f FROM w JOIN edges e ON e.t = w.key JOIN ordered o ON o.key = e.f) SELECT key FROM w""",
)
def will_be_requested(spark: SparkSession, d: str) -> DataFrame:
    """Requests for assets without data run down the graph within one tick: level by level, each seeing what fired above."""
    state = dag_nodes(spark, d).select("key", F.lit(0).cast("long").alias("tick"), F.col("last_data_version").alias("last_run_id"))
    pairs = cut_lineage(dag_edges(spark, d))
    tree = C.MISSING | C.Deps("any", C.WILL_BE_REQUESTED)
    return C.evaluate_in_order(state, pairs, topological_levels(state, pairs), tree).filter("fired").select("key")


@CORE.query(
    "staleness_floor",
    f"WITH {FACTS}, {EDGES} SELECT x.t AS dep_key, CASE WHEN count(*) = count(m) THEN min(m) END AS floor, min(m) AS attempted_floor FROM edges x JOIN facts a ON a.key = x.f AND a.code_location_id = x.code_location_id WHERE a.tick = 40 GROUP BY x.t",
)
def staleness_floor(spark: SparkSession, d: str) -> DataFrame:
    state = facts(spark, d).filter("tick = 40").select(F.col("key").alias("from_key"), "code_location_id", F.col("last_timestamp").alias("at"))
    mapped = edges(spark, d).join(state, ["from_key", "code_location_id"]).select(F.col("to_key").alias("dep_key"), "at")
    return C.floor_over(mapped).join(C.floor_over(mapped, attempted_only=True).withColumnRenamed("floor", "attempted_floor"), "dep_key")
