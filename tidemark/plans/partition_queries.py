"""Queries over partition universes, ranges, mappings and selections."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.formats import nanos_to_ntz
from tidemark.functions.partition_keys import is_valid_key
from tidemark.operators import mappings as M
from tidemark.operators import partitions as P
from tidemark.plans.registry import CORE
from tidemark.sources.tables import table

YEAR = P.daily(datetime(2024, 1, 1), datetime(2025, 1, 1))
QUARTER = P.daily(datetime(2024, 11, 17, 6), datetime(2025, 2, 16))
SIX_HOURS = P.TimeWindow(datetime(2024, 11, 18), datetime(2025, 2, 15), timedelta(hours=6), None, "%Y-%m-%dT%H:%M")
STATIC = P.Static(("eu", "us", "ap", "eu", "sa"))
YEAR_SQL = "(SELECT strftime(x, '%Y-%m-%d') AS key, x AS window_start, x + INTERVAL 1 DAY AS window_end, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS ordinal FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS x))"
SIX_SQL = "(SELECT strftime(x, '%Y-%m-%dT%H:%M') AS key, x AS window_start, x + INTERVAL 6 HOUR AS window_end FROM (SELECT unnest(generate_series(TIMESTAMP '2024-11-18', TIMESTAMP '2025-02-14 18:00:00', INTERVAL 6 HOUR)) AS x))"
STATIC_SQL = "(SELECT * FROM (VALUES (0, 'eu'), (1, 'us'), (2, 'ap'), (3, 'sa')) v(ordinal, key))"


@CORE.query("static_partitions", f"SELECT ordinal, key FROM {STATIC_SQL}")
def static_partitions(spark: SparkSession, d: str) -> DataFrame:
    return STATIC.universe(spark)


@CORE.query("time_window_keys_daily", f"SELECT ordinal, key, window_start, window_end FROM {YEAR_SQL}")
def time_window_keys_daily(spark: SparkSession, d: str) -> DataFrame:
    return YEAR.universe(spark)


@CORE.query(
    "time_window_keys_hourly",
    """SELECT strftime(x, '%Y-%m-%dT%H:00') AS key, x AS window_start FROM (SELECT unnest(generate_series(TIMESTAMP '2024-11-03 01:00:00', TIMESTAMP '2024-11-04 05:00:00', INTERVAL 1 HOUR)) AS x)""",
)
def time_window_keys_hourly(spark: SparkSession, d: str) -> DataFrame:
    """First full hour after the start; the grid is wall-clock, so a clock change repeats nothing."""
    return P.hourly(datetime(2024, 11, 3, 0, 20), datetime(2024, 11, 4, 6)).universe(spark).select("key", "window_start")


@CORE.query("time_window_keys_interval", f"SELECT key, window_start, window_end FROM {SIX_SQL}")
def time_window_keys_interval(spark: SparkSession, d: str) -> DataFrame:
    return SIX_HOURS.universe(spark).select("key", "window_start", "window_end")


@CORE.query("time_window_keys_capped", f"SELECT key FROM {YEAR_SQL} WHERE window_start < TIMESTAMP '2024-03-10 12:00:00'")
def time_window_keys_capped(spark: SparkSession, d: str) -> DataFrame:
    return YEAR.capped(datetime(2024, 3, 10, 12)).universe(spark).select("key")


@CORE.query(
    "cron_daily_keys",
    """SELECT strftime(x, '%Y-%m-%dT%H:%M') AS key, x AS window_start, coalesce(lead(x) OVER (ORDER BY x), TIMESTAMP '2025-02-17 06:30:00') AS window_end
 FROM (SELECT unnest(generate_series(TIMESTAMP '2024-11-18 06:30:00', TIMESTAMP '2025-02-14 06:30:00', INTERVAL 1 DAY)) AS x) WHERE isodow(x) <= 5""",
)
def cron_daily_keys(spark: SparkSession, d: str) -> DataFrame:
    """A cron grid: half past six on workdays."""
    grid = P.TimeWindow(datetime(2024, 11, 16), datetime(2025, 2, 16), None, "30 6 * * 1-5", "%Y-%m-%dT%H:%M")
    return grid.universe(spark).select("key", "window_start", "window_end")


@CORE.query("window_count", "SELECT 'year' AS grid, 366 AS n UNION ALL SELECT 'six_hours', 356 UNION ALL SELECT 'capped', 70")
def window_count(spark: SparkSession, d: str) -> DataFrame:
    """Counts by arithmetic, without enumerating."""
    grids = {"year": YEAR, "six_hours": SIX_HOURS, "capped": YEAR.capped(datetime(2024, 3, 10, 12))}
    return spark.createDataFrame([(n, g.count()) for n, g in grids.items()], "grid string, n int")


@CORE.query("window_bounds", f"SELECT key, window_start, window_end FROM {YEAR_SQL} WHERE key IN (SELECT DISTINCT strftime(ts, '%Y-%m-%d') FROM events)")
def window_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The window of each key that occurs: by parsing, not by a join with the universe."""
    keys = table(spark, d, "events").select(P.format_key(F.col("ts"), P.FMT_DAY).alias("key")).distinct()
    start = P.parse_key(F.col("key"), P.FMT_DAY)
    valid = P.validate_keys(keys, YEAR).filter("valid")
    return valid.select("key", start.alias("window_start"), (start + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("window_end"))


@CORE.query(
    "window_range_join",
    f"""SELECT w.key, count(DISTINCT e.event_id) AS n FROM asset_events e JOIN {SIX_SQL} w
 ON make_timestamp(e.timestamp // 1000) >= w.window_start AND make_timestamp(e.timestamp // 1000) < w.window_end GROUP BY w.key""",
)
def window_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Window containing a time: on an even grid the range join is an equi-join on the window's index."""
    at = table(spark, d, "asset_events").select("event_id", nanos_to_ntz(F.col("timestamp")).alias("at")).distinct()
    hits = at.select("event_id", P.window_index(F.col("at"), SIX_HOURS).cast("int").alias("ordinal")).filter("ordinal IS NOT NULL")
    counts = hits.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(SIX_HOURS.universe(spark).select("ordinal", "key"), "ordinal").select("key", "n")


@CORE.query(
    "window_alignment",
    """SELECT DISTINCT ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 86400000000 = 0 AS on_grid, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS BIGINT) AS ordinal FROM events""",
)
def window_alignment(spark: SparkSession, d: str) -> DataFrame:
    times = table(spark, d, "events").select("ts").distinct()
    return times.select("ts", P.aligned(F.col("ts"), YEAR).alias("on_grid"), P.window_index(F.col("ts"), YEAR).alias("ordinal"))


@CORE.query("validate_keys", f"SELECT DISTINCT partition_key.display AS key, partition_key.display IN (SELECT key FROM {YEAR_SQL}) AS valid FROM asset_events WHERE partition_key IS NOT NULL")
def validate_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "asset_events").filter("partition_key IS NOT NULL").select(F.col("partition_key.display").alias("key")).distinct()
    return P.validate_keys(keys, YEAR)


@CORE.query(
    "parse_partition_keys",
    """SELECT key, coalesce(try_strptime(key, '%Y-%m-%d'), try_strptime(key || '-01', '%Y-%m-%d')) AS at FROM (SELECT DISTINCT unnest([strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m')]) AS key FROM events)""",
)
def parse_partition_keys(spark: SparkSession, d: str) -> DataFrame:
    """Missing fields start their period: a month is its first day, a day its midnight."""
    both = F.array(P.format_key(F.col("ts"), "%Y-%m-%d"), P.format_key(F.col("ts"), "%Y-%m"))
    keys = table(spark, d, "events").select(F.explode(both).alias("key")).distinct()
    return keys.select("key", F.coalesce(P.parse_key(F.col("key"), "%Y-%m-%d"), P.parse_key(F.col("key"), "%Y-%m")).alias("at"))


@CORE.query("range_static_positional", f"SELECT key FROM {STATIC_SQL} WHERE ordinal BETWEEN 1 AND 3")
def range_static_positional(spark: SparkSession, d: str) -> DataFrame:
    """By place: from us to sa, although 'sa' sorts before 'us'."""
    return P.keys_in_range(STATIC.universe(spark), "us", "sa", STATIC).select("key")


@CORE.query("range_time", f"SELECT key FROM {YEAR_SQL} WHERE key BETWEEN '2024-02-27' AND '2024-03-02'")
def range_time(spark: SparkSession, d: str) -> DataFrame:
    return P.keys_in_range(YEAR.universe(spark), "2024-02-27", "2024-03-02", YEAR).select("key")


@CORE.query("range_multi", f"SELECT 'date=' || y.key || '|region=' || s.key AS key FROM {YEAR_SQL} y, {STATIC_SQL} s WHERE y.key BETWEEN '2024-02-27' AND '2024-03-02' AND s.ordinal <= 1")
def range_multi(spark: SparkSession, d: str) -> DataFrame:
    """A range in each dimension, then their product."""
    days = P.keys_in_range(YEAR.universe(spark), "2024-02-27", "2024-03-02", YEAR).select(F.col("key").alias("date"))
    regions = P.keys_in_range(STATIC.universe(spark), "eu", "us", STATIC).select(F.col("key").alias("region"))
    return days.crossJoin(F.broadcast(regions)).select(F.concat(F.lit("date="), "date", F.lit("|region="), "region").alias("key"))


@CORE.query("grid_keys_in_range", f"SELECT key FROM {SIX_SQL} WHERE window_start >= TIMESTAMP '2024-12-30 07:00:00' AND window_start <= TIMESTAMP '2025-01-02'")
def grid_keys_in_range(spark: SparkSession, d: str) -> DataFrame:
    start, end = (F.lit(datetime(*x)).cast("timestamp_ntz") for x in ((2024, 12, 30, 7), (2025, 1, 2)))
    return SIX_HOURS.universe(spark).filter((F.col("window_start") >= start) & (F.col("window_start") <= end)).select("key")


@CORE.query("window_starts_in", f"SELECT window_start FROM {SIX_SQL} WHERE window_start >= TIMESTAMP '2025-02-13 01:00:00' AND window_start < TIMESTAMP '2025-03-01'")
def window_starts_in(spark: SparkSession, d: str) -> DataFrame:
    """Half-open, and cut to the grid's own end."""
    start, end = (F.lit(datetime(*x)).cast("timestamp_ntz") for x in ((2025, 2, 13, 1), (2025, 3, 1)))
    return SIX_HOURS.universe(spark).filter((F.col("window_start") >= start) & (F.col("window_start") < end)).select("window_start")


@CORE.query(
    "dynamic_partitions",
    """SELECT DISTINCT o_orderpriority AS key FROM orders WHERE o_orderpriority NOT LIKE '%,%' AND o_orderpriority NOT LIKE '%|%' AND o_orderpriority <> '' AND o_orderpriority <> '5-LOW' UNION SELECT 'added'""",
)
def dynamic_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Registered keys: add (idempotent, valid keys only), then delete."""
    registered = table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"))
    added = spark.createDataFrame([("added",), ("added",), ("bad|key",), ("",)], "key string")
    deleted = spark.createDataFrame([("5-LOW",)], "key string")
    return registered.unionByName(added).filter(is_valid_key(F.col("key"))).distinct().join(F.broadcast(deleted), "key", "left_anti").orderBy("key")


@CORE.query("universe_delta", f"SELECT key FROM {YEAR_SQL} WHERE window_start >= TIMESTAMP '2024-06-01' AND window_start < TIMESTAMP '2024-06-03 10:00:00'")
def universe_delta(spark: SparkSession, d: str) -> DataFrame:
    """Windows that entered between two ticks."""
    before, after = (YEAR.capped(datetime(*x)).universe(spark).select("key") for x in ((2024, 6, 1), (2024, 6, 3, 10)))
    return after.join(before, "key", "left_anti")


@CORE.query("latest_window_lookback", f"SELECT key FROM {YEAR_SQL} WHERE window_start <= TIMESTAMP '2024-08-15 13:00:00' AND window_start >= TIMESTAMP '2024-08-12'")
def latest_window_lookback(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_windows(YEAR.universe(spark), F.lit(datetime(2024, 8, 15, 13)).cast("timestamp_ntz"), timedelta(days=3)).select("key")


@CORE.query("partition_key_index", f"SELECT key, ordinal FROM {YEAR_SQL} WHERE key LIKE '2024-02%'")
def partition_key_index(spark: SparkSession, d: str) -> DataFrame:
    return YEAR.universe(spark).filter(F.col("key").startswith("2024-02")).select("key", "ordinal")


@CORE.query(
    "nearest_window_keys",
    """SELECT DISTINCT event_id, strftime(ts, '%Y-%m-%d') AS previous, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next FROM events""",
)
def nearest_window_keys(spark: SparkSession, d: str) -> DataFrame:
    """The windows around each event's time, by arithmetic."""
    start = F.date_trunc("day", F.col("ts"))
    return table(spark, d, "events").select("event_id", P.format_key(start, P.FMT_DAY).alias("previous"), P.format_key(start + F.expr("INTERVAL 1 DAY"), P.FMT_DAY).alias("next"))


@CORE.query("time_window_shift", f"SELECT key, lag(key, 3) OVER (ORDER BY window_start) AS shifted FROM {SIX_SQL}")
def time_window_shift(spark: SparkSession, d: str) -> DataFrame:
    return P.shift_keys(SIX_HOURS.universe(spark), SIX_HOURS, -3).select("key", "shifted")


@CORE.query("partition_cartesian", f"SELECT 'date=' || y.key || '|nation=' || n_name AS key FROM {YEAR_SQL} y, nation")
def partition_cartesian(spark: SparkSession, d: str) -> DataFrame:
    names = tuple(r[0] for r in table(spark, d, "nation").select("n_name").orderBy("n_name").collect())  # a definition's 25 keys
    return P.Multi({"date": YEAR, "nation": P.Static(names)}).universe(spark).select("key")


@CORE.query(
    "partition_keys_window",
    f"""SELECT ordinal, key FROM (SELECT row_number() OVER (ORDER BY y.ordinal, s.ordinal) - 1 AS ordinal, 'date=' || y.key || '|region=' || s.key AS key
 FROM {YEAR_SQL} y, {STATIC_SQL} s) WHERE ordinal BETWEEN 1001 AND 1020""",
)
def partition_keys_window(spark: SparkSession, d: str) -> DataFrame:
    return P.Multi({"date": YEAR, "region": STATIC}).window(spark, 1001, 20)


@CORE.query("partition_key_search", f"SELECT key, count(*) OVER () AS total FROM {YEAR_SQL} WHERE contains(key, '-1') ORDER BY key LIMIT 15 OFFSET 5")
def partition_key_search(spark: SparkSession, d: str) -> DataFrame:
    found = YEAR.universe(spark).filter(F.contains(F.col("key"), F.lit("-1"))).select("key")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("key").offset(5).limit(15).crossJoin(F.broadcast(total))


@CORE.query("partition_def_intersect", "SELECT 'ap' AS key, 'static' AS kind UNION ALL SELECT 'eu', 'static' UNION ALL SELECT strftime(x, '%Y-%m-%d'), 'time' FROM (SELECT unnest(generate_series(TIMESTAMP '2024-11-18', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS x)")
def partition_def_intersect(spark: SparkSession, d: str) -> DataFrame:
    static = P.intersect_definitions(STATIC, P.Static(("ap", "eu", "xx"))).universe(spark).select("key", F.lit("static").alias("kind"))
    return static.unionByName(P.intersect_definitions(YEAR, QUARTER).universe(spark).select("key", F.lit("time").alias("kind")))


@CORE.query("picker_intersection", "SELECT code_location_id, list_sort(list_intersect(a, b)) AS shared FROM (SELECT code_location_id, list(DISTINCT asset_key) FILTER (list_contains(tags, 'daily')) AS a, list(DISTINCT asset_key) FILTER (list_contains(tags, 'gold')) AS b FROM assets GROUP BY 1) WHERE len(list_intersect(a, b)) > 0")
def picker_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Values that all of several sets share, per group."""
    sets = table(spark, d, "assets").groupBy("code_location_id").agg(
        *(F.collect_set(F.when(F.array_contains("tags", t), F.col("asset_key"))).alias(t) for t in ("daily", "gold"))
    )
    return sets.select("code_location_id", F.sort_array(F.array_intersect("daily", "gold")).alias("shared")).filter(F.size("shared") > 0)


PRODUCT = "(SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind FROM events)"


def day_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(P.format_key(F.col("ts"), P.FMT_DAY).alias("day"), F.col("event_type").alias("kind")).distinct()
    return rows.withColumn("key", F.concat(F.lit("day="), "day", F.lit("|kind="), "kind"))


@CORE.query("backfill_per_dimension", f"SELECT day, list_sort(list('day=' || day || '|kind=' || kind)) AS keys FROM {PRODUCT} GROUP BY day")
def backfill_per_dimension(spark: SparkSession, d: str) -> DataFrame:
    return P.group_by_dimensions(day_kinds(spark, d), ["day"])


@CORE.query(
    "bundle_keys",
    """SELECT code_location_id, len(a) AS n_assets, len(k) AS n_types, n AS n_keys, len(a) * len(k) = n AS exact FROM (SELECT code_location_id, list(DISTINCT asset_key) AS a, list(DISTINCT event_type) AS k, count(*) AS n
 FROM (SELECT DISTINCT code_location_id, asset_key, event_type FROM asset_events WHERE asset_key IS NOT NULL AND event_type IN ('StepStart', 'StepSuccess')) GROUP BY 1)""",
)
def bundle_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "asset_events").filter("asset_key IS NOT NULL AND event_type IN ('StepStart', 'StepSuccess')")
    found = P.bundle(keys, ["code_location_id"], ["asset_key", "event_type"])
    return found.select("code_location_id", F.size("asset_key").alias("n_assets"), F.size("event_type").alias("n_types"), "n_keys", "exact")


WEEK = f"(SELECT key FROM {YEAR_SQL} WHERE key BETWEEN '2024-03-01' AND '2024-03-07')"


def week(spark: SparkSession) -> DataFrame:
    return P.keys_in_range(YEAR.universe(spark), "2024-03-01", "2024-03-07", YEAR).select("key")


@CORE.query("map_identity", f"SELECT key, key AS upstream FROM {WEEK}")
def map_identity(spark: SparkSession, d: str) -> DataFrame:
    return M.map_identity(week(spark), YEAR.universe(spark))


@CORE.query("map_all_partitions", f"SELECT w.key, s.key AS upstream FROM {WEEK} w, {STATIC_SQL} s")
def map_all_partitions(spark: SparkSession, d: str) -> DataFrame:
    return M.map_all(week(spark), STATIC.universe(spark))


@CORE.query("map_static", f"SELECT key, CASE key WHEN 'eu' THEN 'europe' WHEN 'us' THEN 'america' ELSE key END AS upstream FROM {STATIC_SQL}")
def map_static(spark: SparkSession, d: str) -> DataFrame:
    return M.map_static(STATIC.universe(spark), {"eu": "europe", "us": "america"})


@CORE.query("map_static_downstream", "SELECT * FROM (VALUES ('eu', 'west'), ('us', 'west'), ('sa', 'sa'), ('west', 'west')) v(key, upstream)")
def map_static_downstream(spark: SparkSession, d: str) -> DataFrame:
    """The inverse may fan out; an upstream key that the table doesn't know as a key passes through."""
    upstream = spark.createDataFrame([("west",), ("sa",), ("eu",)], "key string")
    return M.map_static_down(upstream, {"eu": "west", "us": "west"})


@CORE.query("map_time_window_offset", f"SELECT key, shifted AS upstream FROM (SELECT key, lag(key, 2) OVER (ORDER BY window_start) AS shifted FROM {YEAR_SQL}) WHERE shifted IS NOT NULL")
def map_time_window_offset(spark: SparkSession, d: str) -> DataFrame:
    return M.map_window(YEAR.universe(spark), YEAR, -2)


def regions_by_day(spark: SparkSession, d: str) -> DataFrame:
    return P.Multi({"date": P.daily(datetime(2024, 3, 1), datetime(2024, 3, 8)), "region": STATIC}).universe(spark)


BY_DAY = f"(SELECT w.key AS date, s.key AS region, 'date=' || w.key || '|region=' || s.key AS key FROM {WEEK} w, {STATIC_SQL} s)"


@CORE.query("map_multi", f"SELECT a.key, b.key AS upstream FROM {BY_DAY} a JOIN {BY_DAY} b ON a.date = b.date")
def map_multi(spark: SparkSession, d: str) -> DataFrame:
    """The date maps to the date; the region fans out over the upstream's universe."""
    keys = regions_by_day(spark, d)
    return M.map_multi(keys, keys, {"date": "date"})


@CORE.query("map_multi_to_single", f"SELECT key, date AS upstream FROM {BY_DAY}")
def map_multi_to_single(spark: SparkSession, d: str) -> DataFrame:
    return M.map_multi_to_single(regions_by_day(spark, d), "date")


@CORE.query("map_single_to_multi", f"SELECT date AS key, key AS upstream FROM {BY_DAY}")
def map_single_to_multi(spark: SparkSession, d: str) -> DataFrame:
    return M.map_single_to_multi(week(spark), regions_by_day(spark, d), "date")


@CORE.query("map_specific", f"SELECT key, unnest(['eu', 'us']) AS upstream FROM {WEEK}")
def map_specific(spark: SparkSession, d: str) -> DataFrame:
    return M.map_specific(week(spark), ["eu", "us"])


@CORE.query("map_for_keys", f"SELECT key, CASE WHEN key = '2024-03-02' THEN key END AS upstream FROM {WEEK}")
def map_for_keys(spark: SparkSession, d: str) -> DataFrame:
    return M.map_for_keys(week(spark), ["2024-03-02"])


@CORE.query("map_subset", f"SELECT w.key, u.key AS upstream FROM {WEEK} w LEFT JOIN (SELECT DISTINCT strftime(ts + INTERVAL 55 DAY, '%Y-%m-%d') AS key FROM events) u ON w.key = u.key")
def map_subset(spark: SparkSession, d: str) -> DataFrame:
    universe = table(spark, d, "events").select(P.format_key(F.col("ts") + F.expr("INTERVAL 55 DAY"), P.FMT_DAY).alias("key")).distinct()
    return M.map_subset(week(spark), universe)


@CORE.query(
    "mapped_read",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE strftime(ts, '%Y-%m-%d') IN ('2024-01-04', '2024-01-05', '2024-01-06') GROUP BY 1""",
)
def mapped_read(spark: SparkSession, d: str) -> DataFrame:
    """Load upstream for keys of the downstream: the mapping gives the filter that reaches the scan."""
    wanted = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-07",)], "key string")
    keys = [r["upstream"] for r in M.map_window(wanted, YEAR, -1).collect()]  # the keys of one run
    days = [datetime.strptime(k, P.FMT_DAY) for k in keys]
    ts = F.col("ts")
    window = (ts >= F.lit(min(days)).cast("timestamp_ntz")) & (ts < F.lit(max(days) + timedelta(days=1)).cast("timestamp_ntz"))
    rows = table(spark, d, "events").filter(window & P.format_key(ts, P.FMT_DAY).isin(keys))
    return rows.groupBy(P.format_key(ts, P.FMT_DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def selections(spark: SparkSession) -> tuple[M.Selection, M.Selection]:
    universe = YEAR.universe(spark)
    return M.Selection(universe, universe.filter(F.col("key") < "2024-03-01")), M.Selection(universe, universe.filter(F.col("key").between("2024-02-10", "2024-05-01")))


A, B = "key < '2024-03-01'", "key BETWEEN '2024-02-10' AND '2024-05-01'"


@CORE.query("sel_union", f"SELECT key FROM {YEAR_SQL} WHERE ({A}) OR ({B})")
def sel_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = selections(spark)
    return a.union(b).keys()


@CORE.query("sel_intersect", f"SELECT key FROM {YEAR_SQL} WHERE ({A}) AND ({B})")
def sel_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = selections(spark)
    return a.intersect(b).keys()


@CORE.query("sel_complement", f"SELECT key FROM {YEAR_SQL} WHERE NOT ({A})")
def sel_complement(spark: SparkSession, d: str) -> DataFrame:
    return selections(spark)[0].complement().keys()


@CORE.query("sel_difference", f"SELECT key FROM {YEAR_SQL} WHERE ({A}) AND NOT ({B})")
def sel_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = selections(spark)
    return a.difference(b).keys()


@CORE.query("restrict_to_universe", f"SELECT DISTINCT partition_key.display AS key FROM asset_events WHERE partition_key.display IN (SELECT key FROM {YEAR_SQL})")
def restrict_to_universe(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "asset_events").select(F.col("partition_key.display").alias("key")).filter("key IS NOT NULL")
    return M.Selection(YEAR.universe(spark), keys).restrict().keys()


@CORE.query("sel_fires", "SELECT true AS fires")
def sel_fires(spark: SparkSession, d: str) -> DataFrame:
    return selections(spark)[0].fires()


@CORE.query("array_union_update", "SELECT entry_id, list_sort(list_distinct(list_concat(run_ids, backfill_ids))) AS merged FROM pending_dispatch")
def array_union_update(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pending_dispatch").select("entry_id", F.sort_array(F.array_union("run_ids", "backfill_ids")).alias("merged"))
