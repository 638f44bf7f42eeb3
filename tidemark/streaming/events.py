"""Event streams: late and repeated events, windows, state per asset, latches, and committed ticks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.formats import nanos_to_micros
from tidemark.operators.merge import Clause
from tidemark.operators.runs import latest_per
from tidemark.session import shared_dir
from tidemark.sources.versioned import VersionedTable

ASSET = ["code_location_id", "asset_key"]


def event_stream(spark: SparkSession, path: str, schema: StructType, files: int = 64, lateness: str = "3 days") -> DataFrame:
    """A stream of event files, each event once, with ``at`` as its time.

    Copies are dropped as long as they come within ``lateness`` of the newest event seen; later
    events and copies are dropped by the windows that follow.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    timed = rows.withColumn("at", F.timestamp_micros(nanos_to_micros(F.col("timestamp"))))
    return timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").alias("window_start"), "n")


def sliding_counts(events: DataFrame, size: str = "2 days", slide: str = "1 day") -> DataFrame:
    """The latest window with a look back: overlapping windows."""
    return events.groupBy(F.window("at", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Bursts of events of a run, ended by a pause."""
    return events.groupBy(F.session_window("at", gap), "run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def since_latch(events: DataFrame, trigger: str, reset: str) -> DataFrame:
    """A latch per asset: on while the last trigger event is later than the last reset event; a reset wins a tie.

    The state is two maxima, so order doesn't matter. In update mode it emits a row per asset and
    micro-batch that had events for it: code_location_id, asset_key, latched, changed_at.
    """
    wanted = events.filter(F.col("event_type").isin(trigger, reset) & F.col("asset_key").isNotNull())
    last = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("timestamp"))), F.lit(-1))
    maxima = wanted.groupBy(*ASSET).agg(last(trigger).alias("on"), last(reset).alias("off"))
    return maxima.select(*ASSET, (F.col("on") > F.col("off")).alias("latched"), F.greatest("on", "off").alias("changed_at"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Process what is there in micro-batches and stop; a restart with the same checkpoint goes on from there."""
    place = checkpoint or f"{shared_dir(df.sparkSession)}/streams/{uuid.uuid4().hex}"
    if isinstance(sink, CommittedSink):
        sink.stream = place
    query = df.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


class CommittedSink:
    """Applies each micro-batch to a table once, even if the stream repeats it after a crash.

    The stream (its checkpoint) and the batch's number are part of the commit that the batch made, also
    if it changed no row: a batch that is there is skipped. Another stream has numbers of its own.
    Batches are planned (``apply``) and committed in one step, the table's own commit.
    """

    def __init__(self, table: VersionedTable, apply: Callable[[DataFrame], DataFrame], keys: list[str], clauses: str | list[Clause] = "upsert", stream: str = "") -> None:
        self.table, self.apply, self.keys, self.clauses, self.stream = table, apply, keys, clauses, stream

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.table.batches().get(self.stream, -1) < number:
            self.table.write(self.apply(batch), "merge", keys=self.keys, clauses=self.clauses, batch=(self.stream, number))


class EventBuffer:
    """Collects events of a program and appends them to a table in batches: when ``size`` are held, when the
    oldest has waited ``wait_s``, and at the end. Events of a batch that can't be written stay in the buffer."""

    def __init__(self, table: VersionedTable, schema: str, size: int = 64, wait_s: float = 0.5, clock: Callable[[], float] = time.monotonic) -> None:
        self.table, self.schema, self.size, self.wait_s, self.clock = table, StructType.fromDDL(schema), size, wait_s, clock
        self.held: list[tuple] = []
        self.since = 0.0

    def add(self, *event: object) -> None:
        self.since = self.since if self.held else self.clock()
        self.held.append(event)
        if len(self.held) >= self.size or self.clock() - self.since >= self.wait_s:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.table.append_rows(self.held, self.schema)
            self.held = []

    def __enter__(self) -> EventBuffer:
        return self

    def __exit__(self, *failed: object) -> None:
        self.flush()


def asset_state_sink(table: VersionedTable) -> CommittedSink:
    """Keeps the newest materialisation of each asset; an older one that comes late changes nothing."""

    def newest(batch: DataFrame) -> DataFrame:
        made = batch.filter((F.col("event_type") == "Materialization") & F.col("asset_key").isNotNull())
        return latest_per(made, ASSET, ["timestamp", "event_id"], ["timestamp", "event_id", "run_id", "data_version"])

    later = "struct(s.timestamp, s.event_id) > struct(t.timestamp, t.event_id)"
    return CommittedSink(table, newest, ASSET, [Clause("update_all", later), Clause("insert_all")])
