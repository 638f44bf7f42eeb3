"""Schedules, sensors, previews and the checks of mappings."""

from datetime import UTC, datetime, timedelta

import pytest
from conftest import rows

from tidemark.operators import partitions as P
from tidemark.operators.validation import Edge, MappingError, check_edge, check_graph, compatible_grids
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming.automation import Automation, Request, Schedule, Sensor, Skip, due, preview

NS = lambda *x: int(datetime(*x, tzinfo=UTC).timestamp()) * 1_000_000_000


def test_ticks_are_kept_and_keys_asked_for_once(spark, tmp_path):
    def sense(tick):
        n = int(tick.cursor or 0)
        tick.cursor = str(n + 1)
        if n == 1:
            return Skip("nothing new")
        if n == 3:
            raise RuntimeError("down")
        return [Request("k"), Request(f"k{n}")]

    make = lambda: Automation(
        VersionedTable(spark, str(tmp_path / "ticks")), [Schedule("noon", "0 12 * * *", lambda t: [Request(str(t.now_ns))])], [Sensor("files", sense, every_s=3600)]
    )
    first = make().tick(NS(2024, 1, 1, 11))
    assert [r.key for r in first["files"]] == ["k", "k0"] and "noon" not in first
    assert make().tick(NS(2024, 1, 1, 11, 30)) == {}
    second = make().tick(NS(2024, 1, 1, 12))
    assert [r.key for r in second["noon"]] == [str(NS(2024, 1, 1, 12))] and "files" not in second
    assert [r.key for r in make().tick(NS(2024, 1, 1, 13))["files"]] == ["k2"]
    assert make().tick(NS(2024, 1, 1, 14)) == {}
    ticks = make().table.read()
    assert rows(ticks.filter("automation = 'files'"), "timestamp", "status", "cursor")[-1] == (NS(2024, 1, 1, 14), "failure", "3")
    assert due(ticks).count() == 4


def test_preview():
    now = NS(2024, 3, 9, 12)
    got = preview({"utc": ("0 0 * * *", None), "gap": ("30 2 * * *", "America/New_York")}, now)
    assert got == {"utc": NS(2024, 3, 10), "gap": NS(2024, 3, 10, 7)}


def test_mapping_checks():
    day, hour = P.daily(datetime(2024, 1, 1), datetime(2024, 2, 1)), P.hourly(datetime(2024, 1, 1), datetime(2024, 2, 1))
    eu, world = P.Static(("eu",)), P.Static(("eu", "us"))
    both = P.Multi({"d": day, "r": world})
    good = [
        (Edge("a", "b"), day, day), (Edge("a", "b", "all"), None, day), (Edge("a", "b"), eu, world), (Edge("a", "b"), None, None), (Edge("a", "b"), day, None),
        (Edge("a", "b", "multi", (("d", "d"),)), both, both), (Edge("a", "b", "multi_to_single", (("d", "d"),)), both, day), (Edge("a", "b", "specific", keys=("us",)), day, world),
    ]
    bad = [
        (Edge("a", "b"), None, day), (Edge("a", "b", "all"), day, None), (Edge("a", "b"), day, hour), (Edge("a", "b"), world, eu), (Edge("a", "b"), day, eu),
        (Edge("a", "b", "window"), eu, eu), (Edge("a", "b", "multi", (("x", "d"),)), both, both), (Edge("a", "b", "multi_to_single"), day, hour), (Edge("a", "b", "specific", keys=("xx",)), day, world), (Edge("a", "b", "what"), day, day),
    ]
    for case in good:
        check_edge(*case)
    for case in bad:
        with pytest.raises(MappingError):
            check_edge(*case)
    fine, shifted = (P.TimeWindow(datetime(2024, 1, 1, h), datetime(2024, 2, 1), timedelta(days=1), fmt="%Y-%m-%dT%H") for h in (0, 6))
    assert compatible_grids(fine, shifted) == "their windows start at different offsets"
    assert len(check_graph([Edge("a", "b"), Edge("b", "c")], {"a": day, "b": day, "c": hour})) == 1


@pytest.mark.parametrize(("every", "fmt"), [(timedelta(hours=6), "%Y-%m-%d"), (timedelta(days=1), "%Y|%m|%d"), (timedelta(days=1), "%d"), (timedelta(days=1), "%j-%Y-x%%")])
def test_formats_must_lead_back_to_the_window(every, fmt):
    make = lambda: P.TimeWindow(datetime(2024, 1, 1), datetime(2024, 3, 1), every, fmt=fmt)
    if fmt.endswith("%%"):
        assert make().fmt == fmt
    else:
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError):
        P.TimeWindow(datetime(2024, 1, 1, 0, 0, 0, 5), datetime(2024, 3, 1), cron="0 0 * * *")


def test_events_are_appended_in_batches(spark, tmp_path):
    from tidemark.streaming.events import EventBuffer

    table, now = VersionedTable(spark, str(tmp_path / "events")), [0.0]
    with EventBuffer(table, "kind string, n long", size=4, wait_s=1.0, clock=lambda: now[0]) as buffer:
        for i in range(9):
            buffer.add("step", i)
        assert table.versions() == [0, 1] and len(buffer.held) == 1
        now[0] = 2.0
        buffer.add("late", 9)
        assert table.versions() == [0, 1, 2] and not buffer.held
        buffer.add("last", 10)
    assert rows(table.read(), "n") == sorted(((i,) for i in range(11)), key=repr) and len(table.versions()) == 4
