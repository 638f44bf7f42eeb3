"""Cron schedules of five or six fields: occurrences, and ticks passed under a zone's clock changes."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

# Names and ranges of the fields (second, minute, hour, day, month, weekday) and the nicknames.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
NICKNAMES = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
#: How far the search for an occurrence goes.
HORIZON_DAYS = 366 * 28
#: The longest gap in a zone's clock that is stepped over.
GAP_MINUTES = 240


def _number(text: str, names: tuple[str, ...], first: int) -> int:
    return names.index(text) + first if text in names else int(text)


def _field(text: str, low: int, high: int, names: tuple[str, ...] = (), first: int = 0) -> frozenset[int]:
    found: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            start, end = low, high
        elif "-" in span:
            start, end = (_number(x, names, first) for x in span.split("-"))
        else:
            start = _number(span, names, first)
            end = high if step else start
        if not (low <= start <= end <= high) or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        found |= set(range(start, end + 1, int(step or 1)))
    return frozenset(found)


@dataclass(frozen=True)
class Cron:
    seconds: tuple[int, ...]
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    #: Both day fields restricted: a day matches if either does.
    either: bool

    @classmethod
    @lru_cache(maxsize=1024)
    def parse(cls, text: str) -> Cron:
        fields = NICKNAMES.get(text.strip().lower(), text).split()
        if len(fields) == 5:
            fields = ["0", *fields]
        if len(fields) != 6:
            raise ValueError(f"a cron schedule has 5 or 6 fields, not {len(fields)}")
        names = ((), (), (), (), MONTHS, WEEKDAYS)
        sets = [_field(f, *r, n, i == 4) for i, (f, r, n) in enumerate(zip(fields, RANGES, names, strict=True))]
        weekdays = frozenset(d % 7 for d in sets[5])
        either = not any(fields[i][0] in "*?" for i in (3, 5))
        return cls(tuple(sorted(sets[0])), tuple(sorted(sets[1])), tuple(sorted(sets[2])), sets[3], sets[4], weekdays, either)

    def _day(self, at: datetime) -> bool:
        if at.month not in self.months:
            return False
        of_month, of_week = at.day in self.days, at.isoweekday() % 7 in self.weekdays
        return of_month or of_week if self.either else of_month and of_week

    def _clocks(self) -> list[tuple[int, int, int]]:
        return [(h, m, s) for h in self.hours for m in self.minutes for s in self.seconds]

    def after(self, at: datetime, inclusive: bool = False) -> Iterator[datetime]:
        """Occurrences after a wall-clock time, in order."""
        clocks = self._clocks()
        day = datetime(at.year, at.month, at.day)
        key = (at.hour, at.minute, at.second)
        exact = inclusive and at.microsecond == 0
        i = (bisect.bisect_left if exact else bisect.bisect_right)(clocks, key)
        for _ in range(HORIZON_DAYS):
            if self._day(day):
                for h, m, s in clocks[i:]:
                    yield day.replace(hour=h, minute=m, second=s)
            i, day = 0, day + timedelta(days=1)

    def before(self, at: datetime, inclusive: bool = False) -> Iterator[datetime]:
        """Occurrences before a wall-clock time, latest first."""
        clocks = self._clocks()
        day = datetime(at.year, at.month, at.day)
        key = (at.hour, at.minute, at.second)
        i = (bisect.bisect_right if inclusive or at.microsecond else bisect.bisect_left)(clocks, key)
        for _ in range(HORIZON_DAYS):
            if self._day(day):
                for h, m, s in reversed(clocks[:i]):
                    yield day.replace(hour=h, minute=m, second=s)
            i, day = len(clocks), day - timedelta(days=1)

    def between(self, start: datetime, end: datetime) -> list[datetime]:
        """Occurrences in [start, end)."""
        found = []
        for at in self.after(start, inclusive=True):
            if at >= end:
                break
            found.append(at)
        return found


def first_instant(zone: ZoneInfo, wall: datetime) -> datetime | None:
    """The first UTC instant at which a zone's clock shows ``wall``, or after the gap that skips it."""
    for minutes in range(GAP_MINUTES + 1):
        shown = wall + timedelta(minutes=minutes)
        instant = shown.replace(tzinfo=zone, fold=0).astimezone(UTC)
        if instant.astimezone(zone).replace(tzinfo=None) == shown:
            return instant
    return None


def tick_passed(schedule: str, previous_ns: int, now_ns: int, zone: str | None = None) -> bool:
    """True if an occurrence falls in (previous, now]; whole seconds count.

    In a zone, a wall time that the clock skips counts at the end of the gap, and one that it shows
    twice counts once, at its first instant.
    """
    cron = Cron.parse(schedule)
    previous = datetime.fromtimestamp(previous_ns // 1_000_000_000, UTC)
    now = datetime.fromtimestamp(now_ns // 1_000_000_000, UTC)
    if zone is None:
        return next(cron.after(previous.replace(tzinfo=None)), datetime.max) <= now.replace(tzinfo=None)
    place = ZoneInfo(zone)
    for wall in cron.after(previous.astimezone(place).replace(tzinfo=None)):
        instant = first_instant(place, wall)
        if instant is not None and instant > previous:
            return instant <= now
    return False
