"""Queries take the whole of their input, also what lies outside the test data's usual span or shape."""

import pytest
from conftest import rows

from tidemark.plans import load

CORE = load()
DAY_NS = 86_400_000_000_000
DAY = lambda tick: (20_045 + tick) * DAY_NS  # noqa: E731  2024-11-18 is tick 0
ASSETS = "asset_key string, code_location_id string, code_version string, last_input_data_versions array<struct<k:string,v:string>>"
EVENTS = "event_id long, code_location_id string, event_type string, asset_key string, run_id string, timestamp long, data_version string, code_version string, partition_key struct<kind:string,display:string>"
RUNS = "run_id string, code_location_id string, status string, start_time long, node_names array<string>, partition_key struct<kind:string,display:string>"


@pytest.fixture
def late(spark, tmp_path):
    """Two assets whose log runs from tick -1 to tick 95."""
    spark.createDataFrame([("a", "x", "1", []), ("b", "x", "1", [("a", "1")])], ASSETS).write.parquet(str(tmp_path / "assets.parquet"))
    events = [
        (1, "x", "Materialization", "a", "r1", DAY(-1) + 5, "1", "1", ("single", "2024-11-17")),
        (2, "x", "Materialization", "a", "r2", DAY(93) + 5, "2", "0", ("single", "2025-02-19")),
        (3, "x", "StepFailure", "b", "r2", DAY(95) + 5, None, None, ("single", "2025-02-20")),
    ]
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "asset_events.parquet"))
    spark.createDataFrame([], RUNS).write.parquet(str(tmp_path / "runs.parquet"))
    return str(tmp_path)


def test_conditions_are_replayed_from_the_first_to_the_last_day(spark, late):
    run = lambda name: rows(CORE.queries[name](spark, late), "key", "tick")
    assert run("newly_updated") == [("a", 93)]
    assert run("newly_true") == [("b", 95)]
    assert run("any_deps_match") == []
    assert sorted(run("code_version_changed")) == sorted([("a", t) for t in (93, 94, 95)] + [("b", t) for t in range(-1, 96)])
    assert sorted(t for k, t in run("cond_missing") if k == "b") == list(range(-1, 96))


def test_daily_partitions_run_up_to_the_latest_event(spark, late):
    missing = rows(CORE.queries["missing_partitions"](spark, late), "asset_key", "partition")
    assert ("b", "2025-02-21") in missing and ("b", "2025-02-22") not in missing
    assert ("a", "2025-02-19") not in missing and ("b", "2025-02-19") in missing
    assert rows(CORE.queries["partition_heatmap"](spark, late), "asset_key", "total", "materialized", "failed", "missing") == [("a", 96, 1, 0, 95), ("b", 96, 0, 1, 95)]
