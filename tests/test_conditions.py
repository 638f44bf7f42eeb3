"""Condition trees against an evaluator that goes tick by tick, root by root; graph walks in memory and in rounds."""

import random
from datetime import UTC, datetime

import pytest
from conftest import rows

from tidemark.functions.cron import tick_passed
from tidemark.operators import conditions as C
from tidemark.operators import graph as G

HOUR = 3_600_000_000_000
START = int(datetime(2024, 3, 4, tzinfo=UTC).timestamp()) * 1_000_000_000
SCHEMA = "key string, tick long, tick_ns long, last_run_id string, last_timestamp long, failed_timestamp long, data_version string, code_version string, made_with_code_version string, in_progress boolean, failed boolean, handled_tick long, last_run_nodes array<string>"


class Stepper:
    """Judges a tree at one tick after another; latches belong to a root, the assets on the way and a node."""

    def __init__(self, facts, deps):
        self.facts, self.deps, self.latch = facts, deps, {}

    def run(self, tree, ticks):
        return sorted((root, t) for t in ticks for root in self.facts if self.judge(tree, (root,), t, ""))

    def judge(self, node, via, t, path):
        root, at = via[0], via[-1]
        f, before = self.facts[at][t], self.facts[at].get(t - 1)
        own, was = self.facts[root][t], self.facts[root].get(t - 1)
        child = lambda n, i=0: self.judge(n, via, t, f"{path}.{i}")
        match node:
            case C.Fact(name="missing"):
                return f["last_run_id"] is None
            case C.Fact(name="execution_failed"):
                return f["failed"]
            case C.Fact(name="in_progress"):
                return f["in_progress"]
            case C.Fact(name="backfill_in_progress" | "will_be_requested"):
                return False
            case C.Fact(name="initial_evaluation"):
                return was is None
            case C.Fact(name="newly_requested"):
                return before is not None and f["handled_tick"] == t - 1
            case C.Fact(name="last_run_includes_target"):
                return at != root and root in f["last_run_nodes"]
            case C.Fact(name="code_version_changed"):
                return f["code_version"] is not None and f["code_version"] != f["made_with_code_version"]
            case C.Fact(name="data_version_changed"):
                if f["data_version"] is None:
                    return False
                if before is not None and before["data_version"] is not None:
                    return f["data_version"] != before["data_version"]
                return was is not None and (before and before["last_timestamp"]) != f["last_timestamp"]
            case C.Fact(name="newly_updated"):
                now = f["last_timestamp"]
                if now is None:
                    return False
                if at != root:
                    tried = [x for x in (own["last_timestamp"], own["failed_timestamp"]) if x is not None]
                    return not tried or now > max(tried)
                return now > before["last_timestamp"] if before and before["last_timestamp"] is not None else was is not None
            case C.CronTickPassed(schedule=schedule, zone=zone):
                return was is not None and tick_passed(schedule, was["tick_ns"], own["tick_ns"], zone)
            case C.All(parts=parts):
                return all([child(p, i) for i, p in enumerate(parts)])
            case C.Any(parts=parts):
                return any([child(p, i) for i, p in enumerate(parts)])
            case C.Not(part=part):
                return not child(part)
            case C.NewlyTrue(part=part):
                now = child(part)
                held = self.latch.get((via, path), False)
                self.latch[via, path] = now
                return now and not held
            case C.Since(trigger=trigger, reset=reset):
                on, off = child(trigger, 0), child(reset, 1)
                self.latch[via, path] = (self.latch.get((via, path), False) or on) and not off
                return self.latch[via, path]
            case C.SinceLastHandled(part=part):
                handled = own["handled_tick"]
                return child(part) and (handled is None or was is None or handled < t - 1)
            case C.Deps(quantifier=quantifier, condition=condition):
                found = [d in self.facts and self.judge(condition, (*via, d), t, f"{path}.0") for d in sorted(self.deps.get(at, ()))]
                return any(found) if quantifier == "any" else all(found)
            case C.AssetMatches(keys=keys, condition=condition):
                return any([d in self.facts and self.judge(condition, (*via, d), t, f"{path}.0") for d in keys])
        raise TypeError(node)


def history(r, keys, ticks):
    """Facts of assets whose runs, failures and requests come at random."""
    facts = {}
    for key in keys:
        last = failed = handled = run = version = made = None
        nodes, facts[key] = [], {}
        for t in range(ticks):
            if r.random() < 0.3:
                last, run, version, made, nodes = 10 * t + r.randint(0, 3), f"r{t}", r.choice(("1", "2", None)), r.choice(("x", "y")), r.sample(keys, 2)
            if r.random() < 0.2:
                failed = 10 * t + r.randint(0, 9)
            if r.random() < 0.3:
                handled = t
            facts[key][t] = {
                "tick_ns": START + t * 7 * HOUR, "last_run_id": run, "last_timestamp": last, "failed_timestamp": failed, "data_version": version, "code_version": r.choice((None, "x")) if t == 0 else facts[key][0]["code_version"],
                "made_with_code_version": made, "in_progress": r.random() < 0.2, "failed": failed is not None and (last is None or last < failed), "handled_tick": handled, "last_run_nodes": nodes,
            }
    return facts


CRON = C.CronTickPassed("0 9 * * *", "Europe/Berlin")
LEAF = [C.MISSING, C.FAILED, C.IN_PROGRESS, C.UPDATED, C.REQUESTED, C.SAME_RUN, CRON, C.Fact("code_version_changed"), C.Fact("data_version_changed"), C.Fact("initial_evaluation")]


def random_tree(r, depth=3):
    if depth == 0 or r.random() < 0.15:
        return r.choice(LEAF)
    inner = lambda: random_tree(r, depth - 1)
    return r.choice([
        lambda: inner() & inner(), lambda: inner() | inner(), lambda: ~inner(), lambda: inner().newly_true(), lambda: inner().since(inner()), lambda: inner().since_last_handled(),
        lambda: C.Deps("any", inner()), lambda: C.Deps("all", inner()), lambda: C.AssetMatches(("a", "d"), inner()),
    ])()


FIXED = [
    C.eager(), C.on_missing(), C.on_cron("0 9 * * *", "Europe/Berlin"), C.AssetMatches(("a",), C.UPDATED), C.Deps("any", C.AssetMatches(("a", "c"), C.UPDATED.newly_true())),
    C.Deps("all", C.Deps("any", C.UPDATED.since(CRON))), C.Deps("any", CRON), C.Deps("any", C.UPDATED.since_last_handled()),
]


@pytest.mark.parametrize("seed", range(14))
def test_trees_equal_the_stepper(spark, seed):
    r = random.Random(seed)
    keys, deps = ["a", "b", "c", "d", "e"], {"b": ["a"], "c": ["a", "b"], "d": ["a", "c"], "e": ["ghost", "a"]}
    facts = history(r, keys, 9)
    tree = FIXED[seed] if seed < len(FIXED) else random_tree(r)
    frame = spark.createDataFrame([(k, t, *(x[c] for c in SCHEMA.replace(",", " ").split()[4::2])) for k, ticks in facts.items() for t, x in ticks.items()], SCHEMA)
    edges = spark.createDataFrame([(a, b) for a, found in deps.items() for b in found], "from_key string, to_key string")
    got = rows(C.Evaluation(frame, edges=edges).run(tree).filter("fired"), "key", "tick")
    assert got == Stepper(facts, deps).run(tree, range(9)), tree


def test_roots_restrict_what_is_evaluated_but_not_what_is_asked(spark):
    facts = spark.createDataFrame([("a", 0, True), ("b", 0, False)], "key string, tick long, failed boolean")
    edges = spark.createDataFrame([("b", "a")], "from_key string, to_key string")
    assert rows(C.Evaluation(facts, edges=edges).run(C.Deps("any", C.FAILED), spark.createDataFrame([("b",)], "key string"))) == [("b", 0, True)]


@pytest.fixture(params=["memory", "rounds"])
def walked(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(G, "LOCAL_EDGES", -1)
        monkeypatch.setattr(G, "COMPACT_AFTER", 2)
    return request.param


def dag(spark, n=50):
    """Each node depends on its half and on its third."""
    pairs = {(i, i // 2) for i in range(1, n)} | {(i, i // 3) for i in range(3, n)}
    return pairs, spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "from_key string, to_key string"), spark.createDataFrame([(str(i),) for i in range(n)], "key string")


def test_walks(spark, walked):
    pairs, edges, nodes = dag(spark)
    level = {}
    for i in range(50):
        level[i] = max((level[b] + 1 for a, b in pairs if a == i), default=0)
    assert rows(G.topological_levels(nodes, edges)) == sorted((str(k), v) for k, v in level.items())
    up = G.walk(pairs, [47])
    targets = spark.createDataFrame([("47",), (None,)], "key string")
    assert rows(G.closure(edges, targets)) == sorted((str(k),) for k in up)
    assert rows(G.closure(edges, spark.createDataFrame([("5",)], "key string"), downstream=True, include_targets=True)) == sorted((str(i),) for i in range(50) if i == 5 or 5 in G.walk(pairs, [i]))
    looped = edges.union(spark.createDataFrame([("3", "41"), ("7", "7")], edges.schema))
    all_pairs = {*pairs, (3, 41), (7, 7)}
    assert rows(G.cycle_members(nodes, looped)) == sorted((str(i),) for i in range(50) if i in G.walk(all_pairs, [i]))
    assert G.topological_levels(nodes, edges.limit(0)).filter("level = 0").count() == 50 and G.closure(edges.limit(0), targets).count() == 0


def test_staleness(spark, walked):
    pairs, edges, _ = dag(spark)
    version = lambda i: None if i % 17 == 13 else f"v{i % 5}"
    used = {(a, b): "older" if (a + b) % 19 == 4 else f"v{b % 5}" for a, b in pairs if (a + b) % 23 != 6}
    records = spark.createDataFrame(
        [(str(i), version(i), f"c{i % 3}", "old" if i % 11 == 7 else f"c{i % 3}", [(str(b), v) for (a, b), v in used.items() if a == i]) for i in range(50)],
        "key string, data_version string, code_version string, made_with_code_version string, consumed array<struct<k:string,v:string>>",
    )
    status, causes = {}, set()
    for i in range(50):
        if version(i) is None:
            status[i] = "Missing"
            continue
        mine = {("code", None, "code version changed")} if i % 11 == 7 else set()
        for b in sorted(b for a, b in pairs if a == i):
            if status[b] != "UpToDate":
                mine.add(("data", str(b), f"upstream '{b}' is stale"))
            elif (i, b) not in used:
                mine.add(("data", str(b), f"upstream '{b}' has data not yet consumed"))
            elif used[i, b] != version(b):
                mine.add(("data", str(b), f"upstream '{b}' has new data version"))
        status[i] = "Stale" if mine else "UpToDate"
        causes |= {(str(i), *m) for m in mine}
    assert rows(G.staleness(records, edges)) == sorted((str(k), v) for k, v in status.items())
    assert rows(G.stale_causes(records, edges)) == sorted(causes, key=repr)


def test_a_walk_that_runs_out_of_rounds_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(G, "LOCAL_EDGES", -1)
    monkeypatch.setattr(G, "MAX_ROUNDS", 5)
    chain = spark.createDataFrame([(i + 1, i) for i in range(12)], "from_key int, to_key int")
    nodes = spark.createDataFrame([(i,) for i in range(13)], "key int")
    for walk in (lambda: G.closure(chain, nodes.filter("key = 12")), lambda: G.topological_levels(nodes, chain), lambda: G.reachable_pairs(chain), lambda: G.cycle_members(nodes, chain)):
        with pytest.raises(RuntimeError):
            walk()


def test_any_items_are_sorted_after_what_they_need():
    assert G.sort_items({"c": ["b"], "a": [], "b": ["a", "elsewhere"]}) == ["a", "b", "c"] and G.sort_items({}) == []
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        G.sort_items({"x": ["y"], "y": ["x"], "z": ["x"]})
