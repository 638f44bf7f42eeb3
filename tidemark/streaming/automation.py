"""Schedules and sensors: what asks for runs, tick by tick, and goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.cron import Cron, first_instant, tick_passed
from tidemark.sources.versioned import VersionedTable

TICKS = "automation string, kind string, status string, timestamp long, requests array<string>, reason string, cursor string"


@dataclass(frozen=True)
class Request:
    """A run that is wanted; one key is asked for once."""

    key: str
    assets: tuple[str, ...] = ()
    partition: str | None = None


@dataclass(frozen=True)
class Skip:
    reason: str


@dataclass
class Tick:
    """What an evaluation is told; it may set a new cursor."""

    now_ns: int
    cursor: str | None
    spark: SparkSession


@dataclass(frozen=True)
class Schedule:
    name: str
    cron: str
    make: Callable[[Tick], Sequence[Request] | Skip]
    zone: str | None = None


@dataclass(frozen=True)
class Sensor:
    name: str
    make: Callable[[Tick], Sequence[Request] | Skip]
    every_s: float = 30.0


@dataclass
class Automation:
    """Evaluates schedules and sensors; ticks are rows of a table, so a restart knows cursors and keys asked for."""

    table: VersionedTable
    schedules: Sequence[Schedule] = ()
    sensors: Sequence[Sensor] = ()

    def _state(self) -> dict[str, dict[str, Any]]:
        """Last tick and last cursor of each automation: one row each."""
        if not self.table.exists():
            return {}
        order = F.col("timestamp")
        rows = self.table.read().groupBy("automation").agg(F.max(order).alias("at"), F.max_by("cursor", F.when(F.col("cursor").isNotNull(), order)).alias("cursor"))
        return {r["automation"]: r.asDict() for r in rows.collect()}

    def _asked(self, wanted: Mapping[str, Sequence[Request]]) -> set[tuple[str, str]]:
        """Which of some requests were made before: looked up in the table, so only those come back."""
        keys = [(name, r.key) for name, found in wanted.items() for r in found]
        if not keys or not self.table.exists():
            return set()
        before = self.table.read().select("automation", F.explode("requests").alias("key"))
        return {tuple(r) for r in before.join(F.broadcast(self.table.spark.createDataFrame(keys, "automation string, key string")), ["automation", "key"]).distinct().collect()}

    def tick(self, now_ns: int) -> dict[str, list[Request]]:
        """Evaluate what is due and store the ticks in one commit; returns the new requests."""
        spark, state = self.table.spark, self._state()
        rows, wanted = [], {}
        for one in (*self.schedules, *self.sensors):
            known = state.get(one.name, {})
            before = known.get("at")
            if isinstance(one, Schedule):
                if before is None:
                    rows.append((one.name, "schedule", "started", now_ns, [], None, None))
                    continue
                if not tick_passed(one.cron, before, now_ns, one.zone):
                    continue
            elif before is not None and now_ns - before < one.every_s * 1e9:
                continue
            tick = Tick(now_ns, known.get("cursor"), spark)
            kind = "schedule" if isinstance(one, Schedule) else "sensor"
            try:
                found = one.make(tick)
            except Exception as error:  # noqa: BLE001 - a failing evaluation is a tick of its own kind
                rows.append((one.name, kind, "failure", now_ns, [], f"{type(error).__name__}: {error}", known.get("cursor")))
                continue
            if isinstance(found, Skip):
                rows.append((one.name, kind, "skipped", now_ns, [], found.reason, tick.cursor))
                continue
            wanted[one.name] = list(found)
            rows.append((one.name, kind, "success", now_ns, None, None, tick.cursor))
        asked = self._asked(wanted)
        wanted = {name: [r for r in found if (name, r.key) not in asked] for name, found in wanted.items()}
        rows = [(*row[:4], [r.key for r in wanted[row[0]]], *row[5:]) if row[2] == "success" else row for row in rows]
        if rows:
            self.table.write(spark.createDataFrame(rows, TICKS), "append")
        return wanted


def preview(schedules: Mapping[str, tuple[str, str | None]], now_ns: int) -> dict[str, int]:
    """The next occurrence of each schedule (cron, zone) after ``now_ns``, as nanoseconds."""
    from zoneinfo import ZoneInfo

    now = datetime.fromtimestamp(now_ns / 1e9, UTC)
    found = {}
    for name, (cron, zone) in schedules.items():
        place = ZoneInfo(zone or "UTC")
        for wall in Cron.parse(cron).after(now.astimezone(place).replace(tzinfo=None)):
            instant = first_instant(place, wall)
            if instant is not None and instant > now:
                found[name] = int(instant.timestamp()) * 1_000_000_000
                break
    return found


class Pulses(StreamingQueryListener):
    """Tells a callback when a stream's table changed: once for each micro-batch that had rows."""

    def __init__(self, changed: Callable[[str, int, int], None]) -> None:
        self.changed = changed

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802 - Spark's names
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self.changed(event.progress.name or str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass


def due(ticks: DataFrame) -> DataFrame:
    """The ticks that asked for something, one row for each request."""
    return ticks.select("automation", "timestamp", F.explode("requests").alias("request"))
