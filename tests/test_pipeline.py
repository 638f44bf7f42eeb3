"""Edge cases of the general data-processing operators against brute force."""

from collections import defaultdict

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.features import activity_by_type, digits_total, event_types, feature_table, melt_features
from tidemark.operators.history import diff_snapshots, history_from_snapshots, version_history
from tidemark.operators.references import orphan_counts, orphan_references
from tidemark.operators.tree_aggregate import heavy_keys, key_activity, tree_aggregate

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def test_tree_aggregate_equals_plain_grouping_for_any_fan_in(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("v")).repartition(17)
    want = rows(df.groupBy("key").agg(F.count("*"), F.sum("v"), F.min("v"), F.max("v")))
    for fan_in in (2, 3, 16):
        states = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "a": ("min", F.col("v")), "z": ("max", F.col("v"))}
        assert rows(tree_aggregate(df, ["key"], states, fan_in=fan_in, chunks=17)) == want
    with pytest.raises(ValueError):
        tree_aggregate(df, ["key"], {}, fan_in=1)


def test_key_activity_counts_copies_once_and_keeps_nulls_and_blanks(spark):
    data = [(1, "r", "a", 5), (1, "r", "a", 5), (2, "r", None, 3), (3, "", "a", None), (4, None, "b", 9)]
    df = spark.createDataFrame(data, "event_id long, run_id string, asset_key string, timestamp long").withColumn("key_value", F.lit("clash"))
    got = {(r.key_field, r.key_value): (r.n_events, r.first_timestamp, r.last_timestamp) for r in key_activity(df).collect()}
    assert got == {
        ("run_id", "r"): (2, 3, 5), ("run_id", ""): (1, None, None), ("run_id", None): (1, 9, 9),
        ("asset_key", "a"): (2, 5, 5), ("asset_key", None): (1, 3, 3), ("asset_key", "b"): (1, 9, 9),
    }
    assert rows(heavy_keys(key_activity(df), 0.3)) == [("asset_key", "a"), ("run_id", "r")]
    assert key_activity(df.limit(0)).count() == 0 and heavy_keys(key_activity(df.limit(0))).count() == 0


def brute_history(updates):
    per = defaultdict(dict)
    for key, at, seq, dv, cv in updates:
        if key is not None and at is not None and (at not in per[key] or seq > per[key][at][0]):
            per[key][at] = (seq, dv, cv)
    out = []
    for key, times in per.items():
        state, periods = ("", ""), []
        for at in sorted(times):
            _, dv, cv = times[at]
            new = (state[0] if dv is None else dv, state[1] if cv is None else cv)
            if new != state and new != ("", ""):
                periods.append((at, *new))
            state = new
        out += [(key, at, periods[i + 1][0] if i + 1 < len(periods) else -1, dv, cv) for i, (at, dv, cv) in enumerate(periods)]
    return sorted(out, key=repr)


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", None]), st.integers(0, 30), st.integers(1, 60), st.sampled_from([None, "v1", "v2"]), st.sampled_from([None, "c1", "c2"])), max_size=60))
def test_version_history_equals_brute_force(spark, data):
    unique = {seq: (k, at, seq, dv, cv) for k, at, seq, dv, cv in data}.values()
    df = spark.createDataFrame([*unique, *list(unique)[:3]], "k string, timestamp long, event_id long, dv string, cv string").withColumn("valid_from", F.lit(1))
    got = version_history(df, ["k"], ["dv", "cv"])
    assert rows(got, "k", "valid_from", "valid_to", "dv", "cv") == brute_history(unique)


def test_version_history_of_a_hot_entity_over_many_slices(spark):
    data = [("hot", i, i, f"v{i // 7}" if i % 3 else None, "c" if i > 500 else None) for i in range(2_000)] + [("cold", 5, 9_999, "x", None)]
    df = spark.createDataFrame(data, "k string, timestamp long, event_id long, dv string, cv string").repartition(9)
    assert rows(version_history(df, ["k"], ["dv", "cv"]), "k", "valid_from", "valid_to", "dv", "cv") == brute_history(data)


def test_snapshot_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (None, "n")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None), (None, "n")], "id int, v string").withColumn("change", F.lit("clash"))
    assert rows(diff_snapshots(a, b, ["id"], ["v"])) == sorted([(1, "x", "same"), (2, "z", "changed"), (3, "y", "deleted"), (4, None, "inserted"), (None, "n", "same")], key=repr)


def test_history_from_snapshots_ends_deleted_keys_and_starts_returning_ones(spark):
    data = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (1, "b", "p"), (3, "b", "p"), (None, "b", "q")]
    got = history_from_snapshots(spark.createDataFrame(data, "day int, k string, v string"), "day", ["k"], ["v"])
    assert rows(got, "k", "v", "valid_from", "valid_to") == [("a", "x", 1, 3), ("a", "y", 3, None), ("b", "p", 1, 2), ("b", "p", 3, None)]


REFS = "source_table string, record_id long, run_id string, at long, ingested_at long"
DAY = 86_400_000_000_000


@pytest.mark.parametrize("shuffled", [False, True])
def test_orphans(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr("tidemark.operators.references.BROADCAST_BYTES", 0)
        monkeypatch.setattr("tidemark.operators.references.HOT_SHARE", 2)
    refs = [
        ("e", 1, " A\n", 0, 5), ("e", 2, "b", DAY, 5), ("e", 2, "b", DAY, 9), ("e", 3, "", 0, 5), ("e", 4, None, 0, 5), ("e", 5, "gone", -1, 5),
        ("e", 6, "C", 0, 1), ("e", 6, "C", 0, 9), ("p", 7, "c", 0, None), ("p", 8, "\t ", 0, 1), *[("e", 100 + i, "lost", i * DAY, 5) for i in range(50)],
    ]
    parents = spark.createDataFrame([("a", 5), ("c", 4), ("c", 8), (None, 1)], "run_id string, ingested_at long")
    deleted = spark.createDataFrame([("GONE",), ("a",)], "run_id string")
    found = orphan_references(spark.createDataFrame(refs, REFS), parents, deleted)
    want = [("e", 2, "b", "missing", "1970-01-02"), ("e", 5, "gone", "deleted", "1969-12-31"), ("e", 6, "C", "late", "1970-01-01")]
    assert [r for r in rows(found) if r[2] != "lost"] == want
    assert found.filter("run_id = 'lost' AND reason = 'missing'").count() == 50
    assert rows(orphan_counts(found).filter("period = '1970-01-02'")) == [("e", "1970-01-02", "missing", 2, 2)]
    empty = spark.createDataFrame([], REFS)
    assert orphan_references(empty, parents, deleted).count() == 0
    assert orphan_references(spark.createDataFrame(refs, REFS), parents.limit(0), deleted.limit(0)).filter("reason <> 'missing'").count() == 0


def test_features(spark):
    pairs = [("rows", "12"), ("rows", "x"), ("rows", "٣"), ("rows", ""), ("bytes", "9"), ("rows", "0030\n")]
    beyond = [("rows", "99999999999999999999"), ("rows", "5")]
    data = [
        (1, "l", "A.b", "k", 5, pairs), (1, "l", "A.b", "k", 5, pairs), (2, "l", "A.b", "k", 9, None), (3, "l", "A_b", "k", 7, []),
        (4, "l", None, "k", 1, []), (5, "l", "A.b", None, 1, []), (6, "m", "Z", "k", None, [("rows", "4")]), (7, "m", "Y", "k", 3, beyond), (8, "m", "Y", "k", 3, [("rows", "1")]),
    ]
    df = spark.createDataFrame(data, "event_id long, code_location_id string, event_type string, asset_key string, timestamp long, metadata array<struct<k:string,v:string>>")
    df = df.withColumn("n_events", F.lit("clash"))
    long = activity_by_type(df)
    assert rows(long) == [("l", "k", "A.b", 2, 9, 12), ("l", "k", "A_b", 1, 7, 0), ("m", "k", "Y", 2, 3, (1 << 63) - 1), ("m", "k", "Z", 1, None, 4)]
    types = event_types(long)
    wide = feature_table(long, types, F.lit(2_000_000_009))
    assert types == ["A.b", "A_b", "Y", "Z"] and len(wide.columns) == 2 + 12 and len(set(wide.columns)) == len(wide.columns)
    first = wide.filter("code_location_id = 'l'").first()
    melted = rows(melt_features(wide, types).filter("code_location_id = 'l'"), "event_type", "n", "age_s", "rows")
    assert melted == [("A.b", 2, 2.0, 12), ("A_b", 1, 2.000000002, 0), ("Y", 0, None, 0), ("Z", 0, None, 0)]
    assert (first["a_b_n"], first["a_b_age_s"], first["z_n"], first["z_age_s"]) == (2, 2.0, 0, None)
    assert activity_by_type(df.limit(0)).count() == 0 and feature_table(long.limit(0), types, F.lit(0)).count() == 0
    assert feature_table(long, [], F.lit(0)).columns == ["code_location_id", "asset_key"]
    assert spark.createDataFrame([(None,)], "m array<struct<k:string,v:string>>").select(digits_total(F.col("m"))).first()[0] == 0
