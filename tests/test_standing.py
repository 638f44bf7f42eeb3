"""Conditions tick by tick: the same as the replay, through restarts, failed requests and changes of the tree."""

import random

import pytest
from conftest import rows
from test_conditions import CRON, FIXED, SCHEMA, history, random_tree

from tidemark.operators import conditions as C
from tidemark.streaming.standing import Standing

COLUMNS = SCHEMA.replace(",", " ").split()[::2]
DEPS = [("b", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "ghost"), ("e", "a")]
KEYS = ["a", "b", "c", "d", "e"]


def frame(spark, facts, ticks, handled=None):
    """Facts of some ticks; ``handled`` replaces when an asset was last requested, as known before each tick."""
    data = [(k, t, *(({**facts[k][t], "handled_tick": handled[k][t]} if handled else facts[k][t])[c] for c in COLUMNS[2:])) for k in facts for t in ticks]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("seed", [2, 5, 21])
def test_ticks_give_what_the_replay_gives(spark, tmp_path, seed):
    r = random.Random(seed)
    facts, tree = history(r, KEYS, 4), FIXED[seed] if seed < len(FIXED) else random_tree(r)
    edges = spark.createDataFrame(DEPS, "from_key string, to_key string")
    got, handled, last = [], {k: {} for k in KEYS}, dict.fromkeys(KEYS)
    for t in range(4):
        for k in KEYS:
            handled[k][t] = last[k]
        standing = Standing(spark, str(tmp_path / "s"), tree, edges=edges)  # each tick in a program of its own
        now = frame(spark, facts, [t]).drop("handled_tick", "tick", "tick_ns")
        fired = standing.begin(now, t, facts["a"][t]["tick_ns"])
        standing.finish(fired)
        for (k,) in rows(fired, "key"):
            got.append((k, t))
            last[k] = t
    want = C.Evaluation(frame(spark, facts, range(4), handled), edges=edges).run(tree).filter("fired")
    assert sorted(got) == rows(want, "key", "tick"), tree


def test_a_failed_request_fires_again_and_a_crash_is_recovered(spark, tmp_path):
    tree = C.FAILED.newly_true()
    make = lambda t=tree: Standing(spark, str(tmp_path / "s"), t)
    facts = lambda *failed: spark.createDataFrame([(k, k in failed) for k in "ab"], "key string, failed boolean")
    none = spark.createDataFrame([], "key string")
    one = make()
    assert one.recover() is None and rows(one.begin(facts(), 0)) == []
    one.finish(none)
    assert rows(make().begin(facts("a", "b"), 1)) == [("a",), ("b",)]
    with pytest.raises(RuntimeError, match="recover"):
        make().begin(facts("a", "b"), 2)
    again = make()  # after a crash: the intent is there, and only the request for a goes out
    assert rows(again.recover()) == [("a", 1), ("b", 1)]
    again.finish(again.recover().filter("key = 'a'"))
    assert make().recover() is None
    two = make()
    assert rows(two.begin(facts("a", "b"), 2)) == [("b",)]  # b keeps its old state
    two.finish(none.union(two.recover().select("key")))
    three = make()
    assert rows(three.begin(facts("a", "b"), 3)) == []
    three.finish(none)


def test_latches_begin_anew_with_another_tree(spark, tmp_path):
    facts = spark.createDataFrame([("a", True, True)], "key string, failed boolean, in_progress boolean")
    runs = [(C.FAILED.newly_true(), [("a",)]), (C.FAILED.newly_true(), []), (C.FAILED.newly_true() & C.IN_PROGRESS, [("a",)]), (C.FAILED.newly_true(), [("a",)]), (C.FAILED.newly_true() & ~CRON, [("a",)])]
    for t, (tree, want) in enumerate(runs):
        standing = Standing(spark, str(tmp_path / "s"), tree)
        assert rows(standing.begin(facts, t, t)) == want
        standing.finish(standing.recover().select("key"))
