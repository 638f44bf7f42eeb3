"""Queries over dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans.registry import CORE
from tidemark.sources.tables import table

# The graph of the stored assets: a node is an asset of a code location, an edge is an input that its last
# materialisation consumed. An asset that read its own previous output has no edge for that.
INPUTS = "inputs AS (SELECT DISTINCT code_location_id AS l, code_location_id || '/' || asset_key AS f, code_location_id || '/' || p.k AS t FROM (SELECT *, unnest(last_input_data_versions) AS p FROM assets))"
EDGES = f"""{INPUTS}, edges AS (SELECT * FROM inputs WHERE f <> t),
nodes AS (SELECT code_location_id || '/' || asset_key AS key, * FROM assets)"""
PAIRS = f"WITH RECURSIVE {EDGES}, r AS (SELECT f, t FROM edges UNION SELECT r.f, e.t FROM r JOIN edges e ON r.t = e.f)"
# Nodes on a cycle or behind one are in no order.
ORDERED = "ordered AS (SELECT key FROM nodes WHERE key NOT IN (SELECT f FROM r WHERE f = t) AND key NOT IN (SELECT a.f FROM r a JOIN r b ON a.t = b.f WHERE b.f = b.t))"


def node(name: str) -> F.Column:
    return F.concat_ws("/", "code_location_id", name)


def inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "assets").select("code_location_id", node("asset_key").alias("from_key"), F.explode("last_input_data_versions.k").alias("k"))
    return rows.select("from_key", node("k").alias("to_key")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).filter("from_key <> to_key")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assets").withColumn("key", node("asset_key"))


def named(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return nodes(spark, d).filter(F.col("asset_key").isin(*keys)).select("key")


@CORE.query(
    "reachable_pairs",
    f"""WITH RECURSIVE {EDGES}, most AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM assets GROUP BY code_location_id)),
r AS (SELECT f, t, 1 AS depth FROM edges UNION SELECT r.f, e.t, r.depth + 1 FROM r JOIN edges e ON r.t = e.f WHERE r.depth < (SELECT n FROM most))
SELECT f AS from_key, t AS to_key, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY f, t""",
)
def reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs: no asset reaches beyond its code location, so there are few for each."""
    return G.reachable_pairs(edges(spark, d))


@CORE.query("ancestors", f"{PAIRS} SELECT DISTINCT t AS key FROM r WHERE f LIKE '%/cart_updates' AND t NOT LIKE '%/cart_updates'")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(edges(spark, d), named(spark, d, "cart_updates"))


@CORE.query("descendants", f"{PAIRS} SELECT DISTINCT f AS key FROM r WHERE t LIKE '%/stg_page_hits' AND f NOT LIKE '%/stg_page_hits'")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(edges(spark, d), named(spark, d, "stg_page_hits"), downstream=True)


@CORE.query(
    "upstream_closure",
    f"{PAIRS}, s AS (SELECT key FROM nodes WHERE asset_key IN ('device_pings', 'feature_cache')) SELECT DISTINCT t AS key FROM r JOIN s ON f = key UNION SELECT key FROM s",
)
def upstream_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(edges(spark, d), named(spark, d, "device_pings", "feature_cache"), include_targets=True)


@CORE.query(
    "topo_levels",
    f"""{PAIRS}, {ORDERED}, p AS (SELECT f, t, 1 AS depth FROM edges JOIN ordered ON f = key UNION SELECT p.f, e.t, p.depth + 1 FROM p JOIN edges e ON p.t = e.f)
SELECT key, CAST(coalesce(max(depth), 0) AS INTEGER) AS level FROM ordered LEFT JOIN p ON key = f GROUP BY key""",
)
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.topological_levels(nodes(spark, d), edges(spark, d))


@CORE.query("cycle_members", f"{PAIRS} SELECT f AS key FROM r WHERE f = t")
def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    return G.cycle_members(nodes(spark, d), edges(spark, d))


@CORE.query(
    "unresolved_inputs",
    f"""WITH {EDGES}, live AS (SELECT key FROM nodes WHERE last_data_version IS NOT NULL)
SELECT f AS from_key, t AS to_key, 'unresolved' AS problem FROM inputs WHERE t NOT IN (SELECT key FROM live) UNION ALL SELECT f, t, 'self' FROM inputs WHERE f = t""",
)
def unresolved_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that have no data, and assets that name themselves."""
    return G.unresolved_inputs(nodes(spark, d).filter("last_data_version IS NOT NULL"), inputs(spark, d))


@CORE.query("subgraph_missing_deps", f"WITH {EDGES}, s AS (SELECT key FROM nodes WHERE asset_group IS NOT NULL) SELECT f AS from_key, t AS to_key FROM edges WHERE f IN (FROM s) AND t NOT IN (FROM s)")
def subgraph_missing_deps(spark: SparkSession, d: str) -> DataFrame:
    """What the assets that are in a group need from those in none."""
    return G.missing_dependencies(edges(spark, d), nodes(spark, d).filter("asset_group IS NOT NULL"))


@CORE.query(
    "grouped_plan_edges",
    f"""WITH {EDGES}, g AS (SELECT key, code_location_id || '/' || coalesce(asset_group, asset_key) AS step FROM nodes)
SELECT DISTINCT a.step AS from_step, b.step AS to_step FROM edges JOIN g a ON f = a.key JOIN g b ON t = b.key WHERE a.step <> b.step""",
)
def grouped_plan_edges(spark: SparkSession, d: str) -> DataFrame:
    """The assets of a group are one step, an asset without a group is one of its own."""
    groups = nodes(spark, d).withColumn("name", F.coalesce("asset_group", "asset_key")).withColumn("step", node("name"))
    return G.grouped_edges(edges(spark, d), groups)


@CORE.query(
    "synthetic_dag_degree",
    """WITH n AS (SELECT range AS n FROM range(10000)), e AS (SELECT n AS f, (n * 7 + k * 13) % n AS t FROM n, (SELECT unnest([1, 2, 3]) AS k) WHERE n > 0)
SELECT degree, count(*) AS n FROM (SELECT f, count(DISTINCT t) AS degree FROM e GROUP BY f) GROUP BY degree""",
)
def synthetic_dag_degree(spark: SparkSession, d: str) -> DataFrame:
    """A generated DAG of 10,000 nodes with up to three inputs each, by arithmetic on the node's number."""
    generated = spark.range(1, 10_000).select(F.col("id").alias("f"), F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))).alias("k"))
    pairs = generated.select("f", ((F.col("f") * 7 + F.col("k") * 13) % F.col("f")).alias("t")).distinct()
    degrees = pairs.groupBy("f").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


STALE = f"""{PAIRS}, {ORDERED}, records AS (SELECT key, last_data_version AS dv, code_version AS cv, last_materialization_code_version AS mv, code_location_id, last_input_data_versions AS used FROM nodes),
moves AS (SELECT f, t FROM edges JOIN ordered ON f = key),
versions AS (SELECT f, t, b.dv, list_filter(a.used, lambda p: a.code_location_id || '/' || p.k = t)[-1].v AS v, a.dv AS own FROM moves JOIN records a ON f = a.key JOIN records b ON t = b.key),
direct AS (SELECT key, 'code' AS category, CAST(NULL AS VARCHAR) AS dependency, 'code version changed' AS reason FROM records WHERE dv IS NOT NULL AND cv IS NOT NULL AND cv IS DISTINCT FROM mv
 UNION ALL SELECT f, 'data', t, CASE WHEN v IS NULL THEN 'upstream ''' || t || ''' has data not yet consumed' ELSE 'upstream ''' || t || ''' has new data version' END
 FROM versions WHERE own IS NOT NULL AND dv IS NOT NULL AND (v IS NULL OR v <> dv)),
bad AS (SELECT key FROM direct UNION SELECT key FROM records WHERE dv IS NULL UNION SELECT e.f FROM bad JOIN moves e ON e.t = bad.key),
above AS (SELECT e.f AS key, e.t AS dependency FROM moves e JOIN bad ON e.t = bad.key JOIN records a ON a.key = e.f WHERE a.dv IS NOT NULL),
causes AS (SELECT d.* FROM direct d LEFT JOIN above ON d.key = above.key AND d.dependency = above.dependency WHERE above.key IS NULL
 UNION ALL SELECT key, 'data', dependency, 'upstream ''' || dependency || ''' is stale' FROM above)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """What the store knows of each asset: its versions, and those of the inputs that it consumed."""
    consumed = F.transform("last_input_data_versions", lambda p: F.struct(F.concat_ws("/", "code_location_id", p["k"]).alias("k"), p["v"].alias("v")))
    return nodes(spark, d).select("key", F.col("last_data_version").alias("data_version"), "code_version", F.col("last_materialization_code_version").alias("made_with_code_version"), consumed.alias("consumed"))


@CORE.query(
    "stale_direct",
    f"""{PAIRS}, n AS (SELECT key, last_data_version AS dv, code_version AS cv, last_materialization_code_version AS mv, code_location_id, last_input_data_versions AS used FROM nodes),
v AS (SELECT f, t, b.dv, list_filter(a.used, lambda p: a.code_location_id || '/' || p.k = t)[-1].v AS v FROM edges JOIN n a ON f = a.key JOIN n b ON t = b.key WHERE a.dv IS NOT NULL AND b.dv IS NOT NULL)
SELECT key, 'code' AS category, CAST(NULL AS VARCHAR) AS dependency FROM n WHERE dv IS NOT NULL AND cv IS NOT NULL AND cv IS DISTINCT FROM mv UNION ALL SELECT f, 'data', t FROM v WHERE v IS NULL OR v <> dv""",
)
def stale_direct(spark: SparkSession, d: str) -> DataFrame:
    """Edge join: an asset against the versions of its inputs."""
    return G.direct_causes(records(spark, d), edges(spark, d)).drop("reason")


@CORE.query("staleness_status", f"{STALE} SELECT key, CASE WHEN dv IS NULL THEN 'Missing' WHEN key IN (SELECT key FROM causes) THEN 'Stale' ELSE 'UpToDate' END AS status FROM records")
def staleness_status(spark: SparkSession, d: str) -> DataFrame:
    return G.staleness(records(spark, d), edges(spark, d))


@CORE.query("stale_causes", f"{STALE} SELECT key, category, dependency, reason FROM causes")
def stale_causes(spark: SparkSession, d: str) -> DataFrame:
    return G.stale_causes(records(spark, d), edges(spark, d))


@CORE.query(
    "time_based_eval_set",
    f"""WITH RECURSIVE {EDGES}, judged AS (SELECT DISTINCT code_location_id || '/' || asset_key AS key FROM condition_evals),
r AS (SELECT key FROM nodes WHERE asset_key = 'stg_page_hits' UNION SELECT e.f FROM r JOIN edges e ON e.t = r.key JOIN judged j ON j.key = e.f) SELECT key FROM r""",
)
def time_based_eval_set(spark: SparkSession, d: str) -> DataFrame:
    """What a tick has to evaluate: downstream of the changed assets, through assets with a condition only."""
    judged = table(spark, d, "condition_evals").select("code_location_id", "asset_key").distinct().select(node("asset_key").alias("from_key"))
    return G.closure(edges(spark, d).join(judged, "from_key", "left_semi"), named(spark, d, "stg_page_hits"), downstream=True, include_targets=True)
