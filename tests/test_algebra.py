"""Partitions, mappings, selections, graphs, conditions, cron, queues, keys and streams."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import partition_keys as K
from tidemark.functions.cron import Cron, tick_passed
from tidemark.functions.formats import duration_text, nanos_to_micros
from tidemark.functions.retry import Backoff, RetryPolicy, delay, should_retry
from tidemark.operators import conditions as C
from tidemark.operators import graph as G
from tidemark.operators import mappings as M
from tidemark.operators import partitions as P
from tidemark.operators import runs as R
from tidemark.operators.backfill import backfill_outcome
from tidemark.operators.log_templates import lines_of
from tidemark.operators.pools import claims

FEW = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def test_partition_key_forms(spark):
    shown = ["b", "a,b", "z=1|a=x,y", None, ""]
    df = spark.createDataFrame([(s,) for s in shown], "k string")
    col = F.col("k")
    got = {r["k"]: r for r in df.select("k", K.display_members(col).alias("m"), K.member_count(col).alias("n"), K.to_display(K.dimensions(col)).alias("d"), K.key_json(col).alias("j"), K.path_suffix(col).alias("p"), K.is_valid_key(col).alias("v")).collect()}
    assert got["a,b"]["m"] == ["a", "b"] and got["a,b"]["n"] == 2 and got["a,b"]["j"] == '{"single":["a","b"]}' and not got["a,b"]["v"]
    assert got["z=1|a=x,y"]["m"] == ["a=x|z=1", "a=y|z=1"] and got["z=1|a=x,y"]["d"] == "a=x,y|z=1" and got["z=1|a=x,y"]["p"] == "a=x,y/z=1"
    assert got["z=1|a=x,y"]["j"] == '{"multi":{"a":["x","y"],"z":["1"]}}'
    assert got[None]["m"] is None and got[None]["v"] is False and got[""]["v"] is False and got["b"]["v"]


def test_grids(spark):
    grid = P.TimeWindow(datetime(2024, 2, 28), datetime(2024, 3, 2, 12), timedelta(days=1))
    assert grid.count() == 4 and [r.key for r in grid.universe(spark).orderBy("ordinal").collect()] == ["2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"]
    assert P.daily(datetime(2024, 1, 1, 5), datetime(2024, 1, 4)).count() == 2
    with pytest.raises(ValueError, match="reads as"):
        P.TimeWindow(datetime(2024, 1, 1), datetime(2024, 1, 3), timedelta(hours=1), None, "%Y-%m-%d")
    with pytest.raises(ValueError):
        P.TimeWindow(datetime(2024, 1, 1), datetime(2024, 1, 3))
    with pytest.raises(ValueError):
        P.Static(("a|b",))
    assert P.TimeWindow(datetime(2024, 1, 2), datetime(2024, 1, 1), timedelta(days=1)).universe(spark).count() == 0
    keys = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("2023-01-01",), (None,), ("x",)], "key string")
    assert [r.valid for r in P.validate_keys(keys, grid).collect()] == [True, False, False, False, False]
    assert rows(P.shift_keys(keys, grid, -1).filter("shifted IS NOT NULL")) == [("2024-02-29", "2024-02-28")]
    monthly = P.TimeWindow(datetime(2024, 1, 1), datetime(2024, 6, 1), None, "0 0 1 * *", "%Y-%m")
    assert [r.key for r in monthly.universe(spark).orderBy("ordinal").collect()] == [f"2024-0{m}" for m in range(1, 6)]
    assert rows(P.shift_keys(monthly.universe(spark).select("key"), monthly, 2).filter("key < '2024-03'"), "key", "shifted") == [("2024-01", "2024-03"), ("2024-02", "2024-04")]


def test_spark_patterns():
    assert P.spark_pattern("%Y-%m-%dT%H:00") == "yyyy-MM-dd'T'HH:00"
    with pytest.raises(ValueError):
        P.spark_pattern("%Q")


def test_intersections():
    a, b = P.daily(datetime(2024, 1, 1), datetime(2024, 2, 1)), P.daily(datetime(2024, 1, 20), datetime(2024, 3, 1))
    both = P.intersect_definitions(P.Multi({"d": a, "r": P.Static(("x", "y"))}), P.Multi({"d": b, "r": P.Static(("y", "z", "x"))}))
    assert both.dimensions["d"].count() == 12 and both.dimensions["r"].keys == ("y", "x")
    with pytest.raises(ValueError):
        P.intersect_definitions(a, P.Static(("x",)))
    with pytest.raises(ValueError):
        P.intersect_definitions(a, P.hourly(datetime(2024, 1, 1), datetime(2024, 2, 1)))


@FEW
@given(st.sets(st.sampled_from("abcdef")), st.sets(st.sampled_from("abcdefgh")), st.booleans())
def test_selections_are_sets(spark, a, b, everything):
    universe = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    frame = lambda s: spark.createDataFrame([(k,) for k in s], "key string")
    x = M.Selection(universe, everything=True) if everything else M.Selection(universe, frame(a))
    y = M.Selection(universe, frame(b))
    sa = set("abcdef") if everything else a
    keys = lambda s: {r.key for r in s.keys().collect()}
    assert keys(x.intersect(y)) == (b if everything else sa & b)
    assert keys(x.union(y)) == (sa if everything else sa | b)
    assert keys(x.complement()) == set("abcdef") - sa and keys(x.difference(y)) == sa - b
    assert keys(y.restrict()) == b & set("abcdef") and x.fires().first()[0] == bool(sa)


def test_mappings_with_unknown_keys(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert rows(M.map_static(keys, {"a": "x"})) == [("a", "x"), ("b", "b")]
    assert rows(M.map_static_down(spark.createDataFrame([("x",), ("q",)], "key string"), {"a": "x", "b": "x"})) == [("a", "x"), ("b", "x"), ("q", "q"), ("x", "x")]
    assert rows(M.map_subset(keys, keys.filter("key = 'a'"))) == [("a", "a"), ("b", None)]


def brute_reach(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=9))
def test_graphs_equal_brute_force(spark, edges):
    df = spark.createDataFrame([*edges, *edges, (None, 1)], "from_key int, to_key int")
    nodes = spark.createDataFrame([(i,) for i in range(7)], "key int")
    reach = brute_reach(edges)
    cyclic = {a for a, b in reach if a == b}
    assert {(r.from_key, r.to_key) for r in G.reachable_pairs(df).collect()} == reach
    assert {r.key for r in G.cycle_members(nodes, df).collect()} == cyclic
    levels = {r.key: r.level for r in G.topological_levels(nodes, df).collect()}
    assert set(levels) == {n for n in range(7) if n not in cyclic and not any(a == n and b in cyclic for a, b in reach)}
    assert all(levels[a] > levels[b] for a, b in edges if a in levels)


def test_cron():
    at = datetime(2024, 2, 28, 23, 59, 30)
    assert next(Cron.parse("*/15 * * * *").after(at)) == datetime(2024, 2, 29)
    assert next(Cron.parse("30 15 10 * * mon-fri").after(at)) == datetime(2024, 2, 29, 10, 15, 30)
    assert next(Cron.parse("0 0 13 * 5").after(at)) == datetime(2024, 3, 1)  # the 13th or a Friday
    assert next(Cron.parse("@yearly").before(at)) == datetime(2024, 1, 1)
    assert Cron.parse("0 6 * * 7").weekdays == frozenset({0})
    for bad in ("* * *", "61 * * * *", "* * * * mo", "*/0 * * * *"):
        with pytest.raises(ValueError):
            Cron.parse(bad)


def test_cron_and_clock_changes():
    ns = lambda *x: int(datetime(*x, tzinfo=UTC).timestamp()) * 1_000_000_000
    zone = "America/New_York"
    # 02:30 doesn't exist on 2024-03-10; it counts at the end of the gap, 07:00 UTC.
    assert not tick_passed("30 2 * * *", ns(2024, 3, 10, 6), ns(2024, 3, 10, 6, 59), zone)
    assert tick_passed("30 2 * * *", ns(2024, 3, 10, 6), ns(2024, 3, 10, 7), zone)
    # 01:30 comes twice on 2024-11-03 and counts once.
    assert tick_passed("30 1 * * *", ns(2024, 11, 3, 5), ns(2024, 11, 3, 5, 30), zone)
    assert not tick_passed("30 1 * * *", ns(2024, 11, 3, 5, 30), ns(2024, 11, 3, 8), zone)
    assert tick_passed("0 0 * * *", ns(2024, 1, 1, 23), ns(2024, 1, 2)) and not tick_passed("0 0 * * *", ns(2024, 1, 2), ns(2024, 1, 2, 12))


def test_condition_trees():
    tree = C.eager()
    assert tree.fingerprint() == C.eager().fingerprint() != C.on_missing().fingerprint()
    assert tree.without("nothing") == tree and C.any_deps_missing().label == "any_deps_missing"
    swapped = tree.swap("any_deps_updated", C.MISSING)
    assert not any(n.label == "any_deps_updated" for n in swapped.walk()) and any(n.label == "any_deps_missing" for n in swapped.walk())
    assert (C.MISSING & C.FAILED).without(C.FAILED) == C.MISSING
    assert C.on_cron("0 0 * * *").is_time_based() and not tree.is_time_based()
    with pytest.raises(ValueError):
        C.Fact("nonsense")


def test_latches_and_quantifiers(spark):
    flags = {"a": "0110100", "b": "0000000"}
    data = [(k, t, s == "1", t == 3, None if k == "b" else t // 2) for k, bits in flags.items() for t, s in enumerate(bits)]
    facts = spark.createDataFrame(data, "key string, tick long, failed boolean, in_progress boolean, last_timestamp long")
    edges = spark.createDataFrame([("b", "a"), ("c", "x")], "from_key string, to_key string")
    fired = lambda tree, key: [r.tick for r in C.Evaluation(facts, edges=edges).run(tree).filter(F.col("fired") & (F.col("key") == key)).orderBy("tick").collect()]
    assert fired(C.FAILED.newly_true(), "a") == [1, 4]
    assert fired(C.FAILED.since(C.IN_PROGRESS), "a") == [1, 2, 4, 5, 6]
    assert fired(C.UPDATED, "a") == [2, 4, 6] and fired(C.UPDATED, "b") == []
    assert fired(C.Deps("any", C.FAILED), "b") == [1, 2, 4] and fired(C.Deps("any", C.FAILED), "a") == []
    assert fired(C.Deps("all", C.FAILED), "a") == list(range(7))
    assert fired(C.Deps("any", C.UPDATED), "b") == list(range(7))
    assert fired(C.AssetMatches(("a",), C.FAILED), "b") == [1, 2, 4]
    with pytest.raises(ValueError):
        C.Evaluation(facts).run(C.Deps("any", C.FAILED))
    assert C.Evaluation(facts.limit(0), edges=edges).run(C.eager()).count() == 0


def test_trace_shows_every_node(spark):
    facts = spark.createDataFrame([("a", 0, True), ("b", 0, False)], "key string, tick long, failed boolean")
    shown = {r.path: (r.node, r.n_true, r.n_cells) for r in C.Evaluation(facts).trace((C.FAILED & ~C.IN_PROGRESS).named("top")).collect()}
    assert shown == {"": ("All", 1, 2), "0": ("execution_failed", 1, 2), "1": ("Not", 2, 2), "1.0": ("in_progress", 0, 2)}


def test_initials_and_hue(spark):
    from tidemark.functions.formats import hue, initials

    df = spark.createDataFrame([("John  van Doe",), ("admin",), ("--- !",), ("",), ("é",)], "s string")
    assert [tuple(r) for r in df.select(initials(F.col("s"))).collect()] == [("JD",), ("A",), ("?",), ("?",), ("É",)]

    def fnv(text):
        h = 2_166_136_261
        for b in text.encode():
            h = ((h ^ b) * 16_777_619) % (1 << 32)
        return h % 360

    assert [r[0] for r in df.select(hue(F.col("s"))).collect()] == [fnv(r.s) for r in df.collect()]


def test_floors(spark):
    df = spark.createDataFrame([("d", 5), ("d", None), ("e", 7), ("e", 3), ("f", None)], "dep_key string, at long")
    assert rows(C.floor_over(df)) == [("d", None), ("e", 3), ("f", None)] and rows(C.floor_over(df, True)) == [("d", 5), ("e", 3), ("f", None)]


TAGS = "array<struct<k:string,v:string>>"


def plain_dequeue(data, limits, most):
    """The queue of each code location in a plain loop; tags count as often as a run has them."""
    touched = lambda tags: [(i, v if m.per_value else None) for i, m in enumerate(limits) for k, v in tags or () if k == m.key and (m.value is None or v == m.value)]
    want = []
    for place in sorted({row[1] for row in data}):
        counts, busy = {}, 0
        for row in data:
            if row[1] == place and row[2] in ("Started", "NotStarted"):
                busy += 1
                for c in touched(row[5]):
                    counts[c] = counts.get(c, 0) + 1
        taken = []
        for row in sorted((x for x in data if x[1] == place and x[2] == "Queued"), key=lambda x: (-x[3], x[4], x[0])):
            if (most < 0 or busy + len(taken) < most) and all(counts.get(c, 0) < limits[c[0]].limit for c in touched(row[5])):
                taken.append((place, row[0], len(taken) + 1))
                for c in touched(row[5]):
                    counts[c] = counts.get(c, 0) + 1
        want += taken
    return want


@pytest.mark.parametrize("seed,most", [(0, 40), (1, 30), (2, -1), (3, 22), (4, 0)])
def test_dequeue_equals_a_plain_loop(spark, seed, most):
    """Tag keys and whole pairs repeat within a run, and each code location has a queue of its own."""
    r = random.Random(seed)
    tags = lambda: None if r.random() < 0.1 else [(r.choice(("env", "team", "zone")), r.choice("xyz")) for _ in range(r.randint(0, 4))]
    data = [(f"r{i:03}", r.choice("ab"), r.choice(["Queued", "Queued", "Started", "NotStarted", "Success"]), r.randint(0, 2), r.randint(0, 50), tags()) for i in range(150)]
    df = spark.createDataFrame(data, f"run_id string, code_location_id string, status string, priority int, start_time long, tags {TAGS}")
    limits = [R.TagLimit("env", 14, per_value=True), R.TagLimit("team", 33), R.TagLimit("zone", 12, value="x")]
    assert rows(R.dequeue(df, limits, most), "code_location_id", "run_id", "position") == sorted(plain_dequeue(data, limits, most), key=repr)
    one = [R.TagLimit("env", 16, per_value=True)]
    assert rows(R.dequeue_tag_limit(df, "env", 16, most), "code_location_id", "run_id", "position") == sorted(plain_dequeue(data, one, most), key=repr)
    assert rows(R.dequeue_global(df, most), "code_location_id", "run_id") == sorted((x[:2] for x in plain_dequeue(data, [], most)), key=repr)
    assert rows(R.dequeue(df, [], most), "code_location_id", "run_id", "position") == sorted(plain_dequeue(data, [], most), key=repr)
    assert R.dequeue(df.limit(0), limits, most).count() == 0


def test_places_in_a_hot_group(spark):
    r = random.Random(9)
    data = [(f"r{i:03}", r.choice([None, "x", "y"]) if i % 3 else "hot", r.randint(0, 3), r.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "run_id string, code_location_id string, priority int, start_time long")
    want = []
    for place in {x[1] for x in data}:
        group = sorted((x for x in data if x[1] == place), key=lambda x: (-x[2], x[3], x[0]))
        want += [(x[0], n, len(group)) for n, x in enumerate(group, 1)]
    assert rows(R.places(df, ["code_location_id"], R.queue_order()), "run_id", "place", "waiting") == sorted(want)
    assert R.places(df.limit(0), ["code_location_id"], R.queue_order()).count() == 0


def test_tags_and_filters_with_nulls(spark):
    df = spark.createDataFrame([([("a", "1"), ("a", "2")], ["Raw"]), ([], []), (None, None)], f"tags {TAGS}, names array<string>")
    t = F.col("tags")
    assert [x[0] for x in df.select(R.tags_match(t, ["a"], {"a": "2"})).collect()] == [True, False, False]
    assert [x[0] for x in df.select(R.any_contains(F.col("names"), "RA")).collect()] == [True, False, False]
    assert [x[0] for x in df.select(R.priority_of(t, "a")).collect()] == [1, 0, 0]


def test_retry(spark):
    one = spark.range(1)
    wait = lambda b, n, r=0.5: one.select(delay(b, F.lit(n), F.lit(r))).first()[0]
    assert wait(None, 1) == 0 and wait(Backoff("constant", 3.0), 9) == 3 and wait(Backoff("exponential", 1.0, factor=2.0), 4) == 8
    assert wait(Backoff("exponential", 1.0, factor=10.0), 400) == 1e10 and wait(Backoff("fixed"), 2) == 0 and wait(Backoff("constant", 10.0, jitter=0.5), 1, 7.0) == 15
    ask = lambda p, reason, n=1: one.select(should_retry(p, F.lit(reason), F.array(F.lit("OSError")), F.lit(n))).first()[0]
    assert ask(RetryPolicy(1), "UserCode") and not ask(RetryPolicy(1), "UserCode", 2) and not ask(RetryPolicy(9), "Cancelled")
    assert ask(RetryPolicy(1, "match", exceptions=["OSError"]), "X") and not ask(RetryPolicy(1, "match"), "X") and ask(RetryPolicy(1, "match", escalate=["X"]), "X")


def test_claims(spark):
    infos = spark.createDataFrame([("gpu", 4, 3), ("io", -1, 99), ("db", 2, 2)], "pool_key string, slot_limit int, claimed long")
    needs = spark.createDataFrame([("s1", "gpu", 1), ("s1", "io", 50), ("s2", "gpu", 2), ("s3", "db", 1), ("s3", "gpu", 2), ("s4", "none", 1)], "step_key string, pool_key string, slots int")
    assert rows(claims(needs, infos)) == [("s1", True, None), ("s2", False, "pool 'gpu' full (3/4)"), ("s3", False, "pools full: 'db' (2/2), 'gpu' (3/4)"), ("s4", False, "pool 'none' full (0/0)")]


def test_backfill_outcome(spark):
    runs = spark.createDataFrame([("g", "r1", "Success", "a,b"), ("g", "r2", "Canceled", "c"), ("h", "r3", "Success", None), ("i", "r4", "Queued", "d")], "group string, run_id string, status string, partition string")
    events = spark.createDataFrame([("StepFailure", "r1", ("single", "b")), ("StepFailure", "r3", None)], "event_type string, run_id string, partition_key struct<kind:string,display:string>")
    assert rows(backfill_outcome(runs, events)) == [("g", 1, 1, 1, 0, "CompletedFailed"), ("h", 0, 0, 0, 0, "CompletedSuccess"), ("i", 0, 0, 0, 1, "InProgress")]


def test_texts_and_times(spark):
    df = spark.createDataFrame([(0, 59_999_999_999), (0, 3_599_000_000_000), (0, 7_260_000_000_000), (0, None), (None, 5), (-1_001, -1)], "a long, b long")
    assert [x[0] for x in df.select(duration_text(F.col("a"), F.col("b"))).collect()][:5] == ["59s", "59m 59s", "2h 1m", "Running...", "-"]
    assert df.select(nanos_to_micros(F.col("a"))).collect()[-1][0] == -2
    assert lines_of("a\r\nb\n\nc\r") == ["a", "b", "", "c"]


def test_stream_is_idempotent_and_ignores_late_copies(spark, tmp_path):
    from tidemark.sources.versioned import VersionedTable
    from tidemark.streaming import events as S

    schema = "event_id long, code_location_id string, asset_key string, event_type string, run_id string, timestamp long, data_version string"
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    state = VersionedTable(spark, str(tmp_path / "state"))
    sink = S.asset_state_sink(state)
    go = lambda: S.run_available(S.event_stream(spark, src, spark.createDataFrame([], schema).schema), sink, check)
    spark.createDataFrame([(1, "l", "a", "Materialization", "r1", 10**15, "v1"), (2, "l", "a", "StepStart", "r1", 10**15, None)], schema).write.parquet(src)
    go()
    spark.createDataFrame([(1, "l", "a", "Materialization", "r1", 10**15, "v1"), (3, "l", "a", "Materialization", "r0", 9 * 10**14, "v0"), (4, "l", "b", "Materialization", "r2", 10**15, None)], schema).write.mode("append").parquet(src)
    go()
    assert rows(state.read(), "asset_key", "event_id", "data_version") == [("a", 1, "v1"), ("b", 4, None)]
    before = state.versions()
    sink(spark.createDataFrame([(9, "l", "a", "Materialization", "r9", 2 * 10**15, "v9")], schema), 0)
    assert state.versions() == before  # a batch that is there isn't applied again
