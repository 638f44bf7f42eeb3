"""Partition definitions, their universes, ranges and checks.

A definition is a small driver-side value; its universe is a DataFrame built from arithmetic
(``sequence``), never by enumerating keys on the driver, except for cron grids, whose ticks are
computed by the schedule in a Pandas UDF over days.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.cron import Cron
from tidemark.functions.partition_keys import RESERVED

# Strftime fields and the datetime patterns of Spark for them.
PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM"}
FMT_DAY, FMT_HOUR = "%Y-%m-%d", "%Y-%m-%dT%H:00"


def spark_pattern(fmt: str) -> str:
    """A strftime format as a datetime pattern; other text is quoted."""
    out, i, text = [], 0, ""
    while i < len(fmt):
        if fmt[i : i + 2] in PATTERNS:
            if text:
                out.append("'" + text.replace("'", "''") + "'" if any(c.isalpha() for c in text) else text)
                text = ""
            out.append(PATTERNS[fmt[i : i + 2]])
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unknown field {fmt[i : i + 2]!r} in {fmt!r}")
        else:
            text += fmt[i]
            i += 1
    if text:
        out.append("'" + text.replace("'", "''") + "'" if any(c.isalpha() for c in text) else text)
    return "".join(out)


def parse_key(key: Column, fmt: str) -> Column:
    """The wall-clock time of a key, null if it doesn't parse; missing fields start their period."""
    return F.try_to_timestamp(key, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")


def format_key(at: Column, fmt: str) -> Column:
    return F.date_format(at, spark_pattern(fmt))


@dataclass(frozen=True)
class Static:
    keys: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.keys or any(not k or any(c in k for c in RESERVED) for k in self.keys):
            raise ValueError("static keys are one or more texts without reserved characters")

    def universe(self, spark: SparkSession) -> DataFrame:
        """ordinal, key; a repeated key stays at its first place."""
        return spark.createDataFrame(list(enumerate(dict.fromkeys(self.keys))), "ordinal int, key string")


@dataclass(frozen=True)
class TimeWindow:
    """A grid of windows [start, end): every ``every`` from start, or the ticks of a cron schedule."""

    start: datetime
    end: datetime
    every: timedelta | None = None
    cron: str | None = None
    fmt: str = FMT_DAY

    def __post_init__(self) -> None:
        if (self.every is None) == (self.cron is None):
            raise ValueError("give an interval or a cron schedule")
        if self.every is not None and self.every <= timedelta(0):
            raise ValueError("the interval must be above zero")
        if self.cron is not None:
            Cron.parse(self.cron)
        self.check_format()

    def check_format(self, ticks: int = 1024, days: int = 1461) -> None:
        """The key of a window must lead back to its start; the first ``ticks`` windows within ``days`` days are tried."""
        if self.cron is not None and self.start.microsecond:
            raise ValueError("a cron grid starts at a whole second")
        for at in islice(self.ticks(), ticks):
            if at > self.start + timedelta(days=days):
                break
            text = at.strftime(self.fmt)
            if any(c in text for c in RESERVED):
                raise ValueError(f"{self.fmt!r} gives the key {text!r} with a reserved character")
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", DeprecationWarning)  # a format without a year reads as 1900, so it fails below
                    back = datetime.strptime(text, self.fmt)
            except ValueError as error:
                raise ValueError(f"{self.fmt!r} gives the key {text!r}, which it can't read") from error
            if back != at:
                raise ValueError(f"{self.fmt!r} gives {at} the key {text!r}, which reads as {back}")

    def ticks(self) -> Iterator[datetime]:
        if self.every is not None:
            at = self.start
            while at < self.end:
                yield at
                at += self.every
        else:
            for at in Cron.parse(self.cron or "").after(self.start, inclusive=True):
                if at >= self.end:
                    return
                yield at

    def capped(self, as_of: datetime) -> TimeWindow:
        """The same grid without windows that start at or after ``as_of``."""
        return TimeWindow(self.start, min(self.end, as_of), self.every, self.cron, self.fmt)

    def count(self) -> int:
        """The number of windows, by arithmetic where the grid is even."""
        if self.every is None:
            return sum(1 for _ in self.ticks())
        return max(0, math.ceil((self.end - self.start) / self.every))

    def universe(self, spark: SparkSession) -> DataFrame:
        """ordinal, key, window_start, window_end of every window; the last may end after ``end``."""
        if self.every is not None:
            us = self.every // timedelta(microseconds=1)
            index = spark.range(self.count()).select(F.col("id").cast("int").alias("ordinal"))
            start = F.lit(self.start).cast("timestamp_ntz")
            at = (start + F.make_dt_interval(secs=(F.col("ordinal").cast("decimal(18,6)") * F.lit(us).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))).cast("timestamp_ntz")
            grid = index.select("ordinal", at.alias("window_start"))
            return grid.select("ordinal", format_key(F.col("window_start"), self.fmt).alias("key"), "window_start", (F.col("window_start") + F.make_dt_interval(secs=F.lit(us / 1e6))).cast("timestamp_ntz").alias("window_end"))
        return cron_universe(spark, self)


def cron_universe(spark: SparkSession, grid: TimeWindow) -> DataFrame:
    """The ticks of a schedule, found day by day in parallel; a window ends at the next tick."""
    schedule, first, last = grid.cron or "", grid.start, grid.end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cron = Cron.parse(schedule)
        for days in batches:
            out = []
            for offset in days["id"]:
                day = datetime(first.year, first.month, first.day) + timedelta(days=int(offset))
                for at in cron.between(max(day, first), min(day + timedelta(days=1), last)):
                    out.append((at, next(cron.after(at))))
            yield pd.DataFrame(out, columns=["window_start", "window_end"]).astype("datetime64[us]")

    days = (last.date() - first.date()).days + 1
    ticks = spark.range(max(0, days)).mapInPandas(run, "window_start timestamp_ntz, window_end timestamp_ntz")
    numbered = ticks.withColumn("ordinal", F.row_number().over(W.orderBy("window_start")) - 1)
    return numbered.select("ordinal", format_key(F.col("window_start"), grid.fmt).alias("key"), "window_start", "window_end")


def daily(start: datetime, end: datetime, fmt: str = FMT_DAY) -> TimeWindow:
    """Days from the first midnight at or after ``start``."""
    midnight = datetime(start.year, start.month, start.day)
    return TimeWindow(midnight if midnight == start else midnight + timedelta(days=1), end, timedelta(days=1), None, fmt)


def hourly(start: datetime, end: datetime, fmt: str = FMT_HOUR) -> TimeWindow:
    """Hours from the first full hour at or after ``start``."""
    hour = start.replace(minute=0, second=0, microsecond=0)
    return TimeWindow(hour if hour == start else hour + timedelta(hours=1), end, timedelta(hours=1), None, fmt)


@dataclass(frozen=True)
class Multi:
    """Named dimensions; the universe is their product."""

    dimensions: Mapping[str, Static | TimeWindow]

    def universe(self, spark: SparkSession) -> DataFrame:
        """One column for each dimension (in order of name) and ``key`` in display form."""
        names = sorted(self.dimensions)
        frames = [self.dimensions[n].universe(spark).select(F.col("key").alias(n)) for n in names]
        product = reduce(DataFrame.crossJoin, frames)
        return product.withColumn("key", F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.col(n)) for n in names)))

    def window(self, spark: SparkSession, offset: int, limit: int) -> DataFrame:
        """Keys [offset, offset + limit) of the product by stride arithmetic, without building it."""
        names = sorted(self.dimensions)
        sizes = [len(dict.fromkeys(d.keys)) if isinstance(d, Static) else d.count() for d in (self.dimensions[n] for n in names)]
        total = math.prod(sizes)
        rows = spark.range(min(offset, total), min(offset + limit, total)).withColumnRenamed("id", "ordinal")
        stride = total
        for name, size in zip(names, sizes, strict=True):
            stride //= max(size, 1)
            keys = self.dimensions[name].universe(spark).select(F.col("ordinal").alias(f"__{name}"), F.col("key").alias(name))
            rows = rows.withColumn(f"__{name}", (F.floor(F.col("ordinal") / stride) % size).cast("int")).join(keys, f"__{name}").drop(f"__{name}")
        return rows.select("ordinal", F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.col(n)) for n in names)).alias("key"))


def aligned(at: Column, grid: TimeWindow) -> Column:
    """True if a time is a window's start: inside the bounds and a whole number of intervals from the start."""
    if grid.every is None:
        raise ValueError("alignment is arithmetic on even grids; join the universe of a cron grid instead")
    us = grid.every // timedelta(microseconds=1)
    start = F.lit(grid.start).cast("timestamp_ntz")
    inside = (at >= start) & (at < F.lit(grid.end).cast("timestamp_ntz"))
    return F.coalesce(inside & (F.pmod(micros_between(start, at), F.lit(us)) == 0), F.lit(False))


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def window_index(at: Column, grid: TimeWindow) -> Column:
    """The ordinal of the window that holds a time, null outside the grid."""
    us = (grid.every or timedelta(days=1)) // timedelta(microseconds=1)
    start = F.lit(grid.start).cast("timestamp_ntz")
    inside = (at >= start) & (at < F.lit(grid.end).cast("timestamp_ntz"))
    return F.when(inside, F.call_function("div", micros_between(start, at), F.lit(us)))


def validate_keys(keys: DataFrame, definition: Static | TimeWindow, column: str = "key") -> DataFrame:
    """``keys`` with ``valid``: a member of the static keys, or a time on the grid that its format gives back."""
    if isinstance(definition, Static):
        return keys.withColumn("valid", F.coalesce(F.col(column).isin(list(definition.keys)), F.lit(False)))
    at = parse_key(F.col(column), definition.fmt)
    return keys.withColumn("valid", F.coalesce(aligned(at, definition) & (format_key(at, definition.fmt) == F.col(column)), F.lit(False)))


def keys_in_range(keys: DataFrame, first: str, last: str, definition: Static | TimeWindow | None = None) -> DataFrame:
    """Keys from first to last, both included: by place if static, by time on a grid, else by text.

    A static end that is no key gives no rows; so does an end that is no time of the grid's format.
    """
    if isinstance(definition, Static):
        places = {k: i for i, k in enumerate(dict.fromkeys(definition.keys))}
        if first not in places or last not in places:
            return keys.filter(F.lit(False))
        inside = [k for k, i in places.items() if places[first] <= i <= places[last]]
        return keys.filter(F.col("key").isin(inside))
    if isinstance(definition, TimeWindow):
        at = parse_key(F.col("key"), definition.fmt)
        ends = [parse_key(F.lit(x), definition.fmt) for x in (first, last)]
        return keys.filter((at >= ends[0]) & (at <= ends[1]))
    return keys.filter((F.col("key") >= first) & (F.col("key") <= last))


def shift_keys(keys: DataFrame, grid: TimeWindow, offset: int, column: str = "key", out: str = "shifted") -> DataFrame:
    """Each key moved by a number of windows; out of the grid is null. Even grids use arithmetic."""
    if grid.every is not None:
        at = parse_key(F.col(column), grid.fmt)
        moved = (at + F.make_dt_interval(secs=F.lit((grid.every * offset).total_seconds()))).cast("timestamp_ntz")
        inside = (moved >= F.lit(grid.start).cast("timestamp_ntz")) & (moved < F.lit(grid.end).cast("timestamp_ntz"))
        return keys.withColumn(out, F.when(inside, format_key(moved, grid.fmt)))
    universe = grid.universe(keys.sparkSession)
    here = universe.select(F.col("key").alias(column), (F.col("ordinal") + offset).alias("__to"))
    there = universe.select(F.col("ordinal").alias("__to"), F.col("key").alias(out))
    return keys.join(here, column, "left").join(there, "__to", "left").drop("__to")


def latest_windows(universe: DataFrame, as_of: Column, lookback: timedelta | None = None) -> DataFrame:
    """The latest window that started by ``as_of``, and those that started within ``lookback`` before it."""
    started = universe.filter(F.col("window_start") <= as_of)
    latest = started.agg(F.max("window_start").alias("__latest"))
    back = F.make_dt_interval(secs=F.lit((lookback or timedelta(0)).total_seconds()))
    return started.join(F.broadcast(latest), F.col("window_start") >= F.col("__latest") - back).drop("__latest")


def intersect_definitions(left: Static | TimeWindow | Multi, right: Static | TimeWindow | Multi) -> Static | TimeWindow | Multi:
    """What two definitions share: static keys in the right one's order, the common part of equal grids,
    each dimension of equal sets of dimensions. Anything else is an error."""
    if isinstance(left, Static) and isinstance(right, Static):
        return Static(tuple(k for k in right.keys if k in set(left.keys)))
    if isinstance(left, TimeWindow) and isinstance(right, TimeWindow):
        if (left.every, left.cron, left.fmt) != (right.every, right.cron, right.fmt):
            raise ValueError("the grids differ")
        return TimeWindow(max(left.start, right.start), min(left.end, right.end), left.every, left.cron, left.fmt)
    if isinstance(left, Multi) and isinstance(right, Multi) and set(left.dimensions) == set(right.dimensions):
        return Multi({n: intersect_definitions(left.dimensions[n], right.dimensions[n]) for n in left.dimensions})  # type: ignore[misc]
    raise ValueError("definitions of different kinds share nothing")


def group_by_dimensions(keys: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Runs of a backfill: the keys (array, sorted) of each combination of the given dimensions."""
    return keys.groupBy(*dimensions).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def bundle(keys: DataFrame, group: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """One batched key per group if its keys are exactly the product of their dimensions' values.

    Columns: group, one sorted array of values per dimension, n_keys, exact. Where ``exact`` is
    false the keys have to be listed one by one.
    """
    sizes = reduce(Column.__mul__, (F.size(d) for d in dimensions))
    return (
        keys.select(*group, *dimensions).distinct().groupBy(*group)
        .agg(*(F.sort_array(F.collect_set(d)).alias(d) for d in dimensions), F.count(F.lit(1)).alias("n_keys"))
        .withColumn("exact", sizes == F.col("n_keys"))
    )
