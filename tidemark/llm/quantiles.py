"""Percentiles with a guaranteed rank error from mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (v, g, d). The sum of g up to a tuple is the least
rank its value can have, and d is how much higher the true rank may be. With g + d <= 2 * e * n for
every tuple, each rank can be answered with an error of at most e * n ranks, always. Merging two
summaries keeps the bound (the larger of the two e); compressing joins neighbours as far as the
next, wider bound of the level permits. The error allowed grows from level to level: chunks of a
partition, rounds of chunks into a day, rounds of days into a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, ship_package

#: Stated rank error of the results, as a share of the number of values.
EPSILON = 0.005
#: Values that a task holds before it writes their summaries.
CHUNK_ROWS = 500_000
FAN_IN = 16
SUMMARY = "n long, v array<long>, g array<long>, d array<long>"
NO_DAY = -(1 << 31)


def compress(group: np.ndarray, v: np.ndarray, g: np.ndarray, d: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join tuples of a group (sorted by group and value) that lie within one band of ``width`` ranks.

    ``width`` has a band for each tuple, equal within a group. Joined tuples keep the last value, so
    g grows to at most the width; the least value of a group stays.
    """
    if not len(v):
        return group, v, g, d
    total = np.cumsum(g)
    first = np.r_[True, group[1:] != group[:-1]]
    base = np.maximum.accumulate(np.where(first, total - g, 0))
    high = total - base
    width = np.maximum(width, 1)
    low_band, high_band = (high - g) // width, (high - 1) // width
    whole = low_band == high_band
    after_first = np.r_[False, first[:-1]]
    start = first | after_first | ~whole | np.r_[True, ~whole[:-1]] | np.r_[True, high_band[1:] != high_band[:-1]]
    at = np.flatnonzero(start)
    last = np.r_[at[1:], len(v)] - 1
    return group[last], v[last], np.add.reduceat(g, at), d[last]


def merge_all(group: np.ndarray, source: np.ndarray, v: np.ndarray, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge the summaries of each group pairwise until one is left; sorted by group and value."""
    while True:
        pair, side = source // 2, source % 2
        order = np.lexsort((side, v, pair, group))
        group, pair, side, v, g, d = (x[order] for x in (group, pair, side, v, g, d))
        if not len(v):
            return group, v, g, d
        fresh = np.r_[True, (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])]
        number = np.cumsum(fresh)
        index, far = np.arange(len(v)), len(v)
        extra = np.zeros(len(v), dtype=np.int64)
        for mine in (0, 1):
            # The next tuple of the other summary of the pair, from the right.
            other = np.minimum.accumulate(np.where(side != mine, index, far)[::-1])[::-1]
            hit = (side == mine) & (other < far)
            hit[hit] = number[other[hit]] == number[hit]
            extra[hit] = g[other[hit]] + d[other[hit]] - 1
        d, source = d + extra, pair
        if not source.any():
            return group, v, g, d


def leaf_summaries(values: DataFrame, epsilon: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Summaries of the values that each task holds, by (key, day); ``values`` has key, day, value.

    A task that holds more than ``chunk_rows`` values makes several, numbered by ``part``.
    """

    def flush(parts: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        keys = pc.dictionary_encode(table.column(0).combine_chunks())
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        day = table.column(1).to_numpy().astype(np.int64)
        v = table.column(2).to_numpy().astype(np.int64)
        order = np.lexsort((v, day, code))
        code, day, v = code[order], day[order], v[order]
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (day[1:] != day[:-1])])
        sizes = np.diff(np.r_[start, len(v)])
        group = np.repeat(np.arange(len(start)), sizes)
        width = np.floor(2 * epsilon * sizes).astype(np.int64)
        ones, zeros = np.ones(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
        group, v, g, d = compress(group, v, ones, zeros, np.repeat(width, sizes))
        return batch(keys.dictionary.take(pa.array(code[start])), day[start], np.full(len(start), chunk), sizes, group, v, g, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, part, parts, held = TaskContext.get().partitionId(), 0, [], 0

        def numbered() -> pa.RecordBatch:
            one = flush(parts, chunk)
            return one.append_column("part", pa.array(np.full(one.num_rows, part, dtype=np.int32)))

        for one in batches:
            if one.num_rows:
                parts.append(one)
                held += one.num_rows
            if held >= chunk_rows:
                yield numbered()
                part, parts, held = part + 1, [], 0
        if held:
            yield numbered()

    return values.select("key", "day", "value").mapInArrow(run, f"key string, day int, chunk int, {SUMMARY}, part int")


def batch(keys: pa.Array, day: np.ndarray, chunk: np.ndarray, n: np.ndarray, group: np.ndarray, v: np.ndarray, g: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """One row for each group; ``group`` numbers the groups of the tuples from 0 in order."""
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(group, minlength=len(keys)))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (v, g, d)]
    names = ["key", "day", "chunk", "n", "v", "g", "d"]
    return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(day.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(n.astype(np.int64)), *lists], names)


def merge_round(summaries: DataFrame, day: Column, chunk: Column, before: float, after: float) -> DataFrame:
    """Merge the summaries of a key that share (day, chunk) as given; from error ``before`` to ``after``."""
    named = summaries.withColumns({"day": day.cast("int"), "chunk": chunk.cast("int")})

    def merged(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        keys = pc.dictionary_encode(table.column(0).combine_chunks())
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        days, chunks, n = (table.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (days[1:] != days[:-1]) | (chunks[1:] != chunks[:-1])])
        of_row = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(code)]))
        lists = [table.column(i).combine_chunks() for i in (4, 5, 6)]
        lengths = pc.list_value_length(lists[0]).to_numpy()
        v, g, d = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        row = np.repeat(np.arange(len(code)), lengths)
        group, v, g, d = merge_all(of_row[row], row - start[of_row[row]], v, g, d)
        total = np.add.reduceat(n, start)
        width = np.floor(2 * (after - before) * total).astype(np.int64)
        group, v, g, d = compress(group, v, g, d, width[group])
        return batch(keys.dictionary.take(pa.array(code[start])), days[start], chunks[start], total, group, v, g, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for one in batches:
            if not one.num_rows:
                continue
            table = pa.Table.from_batches([one]) if held is None else pa.concat_tables([held, pa.Table.from_batches([one])])
            # The last group may go on in the next batch; a group has at most FAN_IN chunks' summaries.
            same = np.ones(table.num_rows, dtype=bool)
            for i in range(3):
                column = table.column(i)
                same &= pc.equal(column, column[table.num_rows - 1]).to_numpy()
            cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield merged(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield merged(held)

    # Salting is by (day, chunk): a hot key's summaries spread over its days and groups of chunks.
    placed = named.repartition("key", "day", "chunk").sortWithinPartitions("key", "day", "chunk")
    return placed.select("key", "day", "chunk", "n", "v", "g", "d").mapInArrow(run, f"key string, day int, chunk int, {SUMMARY}")


def day_summaries(values: DataFrame, epsilon: float = EPSILON / 2, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One summary for each (key, day), to be kept and merged with those of other days.

    ``values`` has key (string), day (int, days since 1970) and value (long), none of them null. An
    empty table gives no rows.
    """
    leaves = cut_lineage(leaf_summaries(values, epsilon / 2, chunk_rows))
    tasks, parts = (1 + (x or 0) for x in leaves.agg(F.max("chunk"), F.max("part")).first())
    # First the parts of each task meet, then the tasks: a call gets at most ``fan_in`` summaries of a (key, day).
    found, error = leaves.withColumn("chunk", F.col("part") * tasks + F.col("chunk")), epsilon / 2
    steps = [F.floor(F.floor(F.col("chunk") / tasks) / fan_in) * tasks + F.col("chunk") % tasks] * rounds_of(parts, fan_in) + [F.floor(F.col("chunk") / fan_in)] * max(1, rounds_of(tasks, fan_in))
    for step, chunk in enumerate(steps, 1):
        wider = epsilon if step == len(steps) else error + epsilon / 2 / len(steps)
        found = merge_round(found, F.col("day"), chunk, error, wider)
        error = wider
    return found


def rounds_of(many: int, fan_in: int) -> int:
    """How often groups of ``fan_in`` are merged until one is left."""
    rounds = 0
    while many > 1:
        many, rounds = -(-many // fan_in), rounds + 1
    return rounds


def merge_days(days: DataFrame, before: float = EPSILON / 2, after: float = EPSILON, fan_in: int = FAN_IN) -> DataFrame:
    """Merge day summaries of error ``before`` into one for each key, of error ``after``.

    Days meet in rounds of ``fan_in`` neighbouring days, so no task gets all summaries of a key.
    """
    low, high = days.agg(F.min("day"), F.max("day")).first()
    rounds = max(1, rounds_of((high or 0) - (low or 0) + 1, fan_in))
    found, error = days.withColumn("day", F.col("day") - F.lit(low or 0)), before
    for step in range(rounds):
        last = step == rounds - 1
        wider = after if last else error + (after - before) / rounds
        found = merge_round(found, F.lit(NO_DAY) if last else F.floor(F.col("day") / fan_in), F.lit(0), error, wider)
        error = wider
    return found


def read_percentiles(summaries: DataFrame, percents: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """key, day, n, one column ``p<percent>`` for each, and max_rank_error.

    The value at rank ceil(n * percent / 100) is answered by the tuple whose rank interval is
    nearest; ``max_rank_error`` is how many ranks it can be off at most, 0 if the summary is exact.
    """
    names = [f"p{p}" for p in percents]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            n = one.column(2).to_numpy()
            lengths = pc.list_value_length(one.column(3)).to_numpy()
            v, g, d = (one.column(i).flatten().to_numpy() for i in (3, 4, 5))
            start = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
            row = np.repeat(np.arange(len(n)), lengths)
            low = np.cumsum(g) - np.r_[0, np.cumsum(g)][start][row] if len(g) else g
            found = []
            for percent in percents:
                target = -(-(n * percent) // 100)
                away = np.maximum(np.abs(target[row] - low), np.abs(low + d - target[row]))
                order = np.lexsort((away, row))
                found.append(pa.array(v[order[start]]))
            error = np.maximum.reduceat(g + d, start) // 2 if len(g) else n
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), *found, pa.array(error.astype(np.int64))], ["key", "day", "n", *names, "max_rank_error"])

    schema = f"key string, day int, n long, {', '.join(f'{x} long' for x in names)}, max_rank_error long"
    return summaries.select("key", "day", "n", "v", "g", "d").mapInArrow(run, schema)


def percentile_table(
    rows: DataFrame, record: str, key: str, timestamp: str, value: str, percents: Sequence[int] = (50, 90, 95, 99), epsilon: float = EPSILON
) -> DataFrame:
    """Percentiles of ``value`` per key and per key and UTC day, within ``epsilon`` of the ranks.

    Columns: <key>, period ('' for all days, else yyyy-MM-dd), n, p50 ..., max_rank_error. Rows that
    share ``record`` count once; null and negative values, null keys and null timestamps (int64 ns)
    are left out; repeated values count as often as they occur. An empty input gives no rows. The
    days' summaries are stored (checkpoint) and merged into those of the keys.
    """
    ship_package(rows.sparkSession)
    kept = rows.filter(F.col(value).isNotNull() & (F.col(value) >= 0) & F.col(key).isNotNull() & F.col(timestamp).isNotNull())
    day = F.floor(F.col(timestamp) / F.lit(86_400_000_000_000)).cast("int")
    values = kept.select(F.col(record), F.col(key).cast("string").alias("key"), day.alias("day"), F.col(value).cast("long").alias("value")).distinct()
    days = cut_lineage(day_summaries(values, epsilon / 2))
    both = read_percentiles(days, percents).unionByName(read_percentiles(merge_days(days, epsilon / 2, epsilon), percents))
    period = F.when(F.col("day") == NO_DAY, "").otherwise(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd"))
    return both.select(F.col("key").alias(key), period.alias("period"), "n", *(f"p{p}" for p in percents), "max_rank_error")


def rank_distances(answers: DataFrame, values: DataFrame, key: str, percents: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """How many ranks each answer of a percentile table is off, against all values: <key>, period, n, percent, distance.

    ``values`` has the key, period and value of every number that was summarised. The distance is 0 if
    the answer is the value at rank ceil(n * percent / 100).
    """
    long = answers.select(key, "period", "n", F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), F.col(f"p{p}").alias("answer")) for p in percents))).alias("a")).select(key, "period", "n", "a.*")
    # An answer is compared with all values of its key by counting, value by value, not row by row.
    counts = values.groupBy(key, "period", "value").agg(F.count(F.lit(1)).alias("__n"))
    ranks = counts.join(long, [key, "period"]).groupBy(key, "period", "n", "percent", "answer").agg(
        F.sum(F.when(F.col("value") < F.col("answer"), F.col("__n")).otherwise(0)).alias("__below"), F.sum(F.when(F.col("value") <= F.col("answer"), F.col("__n")).otherwise(0)).alias("__upto")
    )
    target = F.ceil(F.col("n") * F.col("percent") / 100)
    off = F.greatest(F.col("__below") + 1 - target, target - F.col("__upto"), F.lit(0))
    return ranks.select(key, "period", "n", "percent", off.alias("distance"))
