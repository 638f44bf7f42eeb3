"""Row predicates from partition keys, as Columns that reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.partitions import Static, TimeWindow

Key = str | Mapping[str, Sequence[str] | str]


def _literal(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def is_in(column: str, values: Sequence[str]) -> Column:
    """Equality for one value, else IN; literals are bound, so nothing needs quoting."""
    values = list(dict.fromkeys(values))
    return F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(values)


def in_window(column: str, start: datetime, end: datetime) -> Column:
    """Half-open: start <= column < end."""
    return (F.col(column) >= _literal(start)) & (F.col(column) < _literal(end))


def windows_of(keys: Sequence[str], grid: TimeWindow) -> list[tuple[datetime, datetime]]:
    """The windows of some keys, neighbouring ones joined, in order of time."""
    if grid.every is None:
        from tidemark.functions.cron import Cron

        ends = lambda at: next(Cron.parse(grid.cron or "").after(at))
    else:
        ends = lambda at: at + grid.every
    spans: list[tuple[datetime, datetime]] = []
    for start in sorted(datetime.strptime(k, grid.fmt) for k in set(keys)):
        if spans and spans[-1][1] == start:
            spans[-1] = (spans[-1][0], ends(start))
        else:
            spans.append((start, ends(start)))
    return spans


def for_dimension(column: str, values: Sequence[str], definition: Static | TimeWindow | None) -> Column:
    """Values of one dimension: ranges on a time grid (one for each run of windows), else equality or IN."""
    if isinstance(definition, TimeWindow):
        return reduce(Column.__or__, (in_window(column, s, e) for s, e in windows_of(values, definition)))
    return is_in(column, values)


def _values(key: Mapping[str, Sequence[str] | str]) -> dict[str, list[str]]:
    return {d: [v] if isinstance(v, str) else list(v) for d, v in key.items()}


def partition_predicate(keys: Sequence[Key], columns: str | Mapping[str, str], definitions: Mapping[str, Static | TimeWindow] | Static | TimeWindow | None = None) -> Column:
    """One predicate for a set of partition keys.

    Single keys give an IN or ranges on ``columns``. Keys of several dimensions give the AND of one
    predicate per dimension if they are exactly the product of their values, else the OR of each
    key's own, with no row selected that no key covers. No keys select nothing.
    """
    if not keys:
        return F.lit(False)
    if isinstance(columns, str):
        return for_dimension(columns, [str(k) for k in keys], definitions)  # type: ignore[arg-type]
    kinds = definitions if isinstance(definitions, Mapping) else {}
    parsed = [_values(k) for k in keys if isinstance(k, Mapping)]
    dims = sorted(parsed[0])
    union = {d: list(dict.fromkeys(v for k in parsed for v in k[d])) for d in dims}
    product = 1
    for d in dims:
        product *= len(union[d])
    members = {tuple(m) for k in parsed for m in _members([k[d] for d in dims])}

    def conjunction(values: Mapping[str, Sequence[str]]) -> Column:
        return reduce(Column.__and__, (for_dimension(columns[d], values[d], kinds.get(d)) for d in dims))

    return conjunction(union) if product == len(members) else reduce(Column.__or__, (conjunction(k) for k in parsed))


def _members(lists: Sequence[Sequence[str]]) -> list[list[str]]:
    return reduce(lambda done, values: [[*d, v] for d in done for v in values], lists, [[]])
