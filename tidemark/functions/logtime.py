"""Times and levels as programs write them in their logs."""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache

# Level words and letters by severity, month names, and the layouts of written times.
LEVELS = {
    "debug": ("trace", "debug", "verbose", "t", "d", "v"),
    "info": ("info", "information", "notice", "i", "n"),
    "warn": ("warn", "warning", "w"),
    "error": ("err", "error", "critical", "crit", "fatal", "severe", "alert", "emerg", "panic", "e", "c", "f"),
}
LEVEL_OF = {word: level for level, words in LEVELS.items() for word in words}
LEVEL_LETTERS = "".join(sorted(w.upper() for w in LEVEL_OF if len(w) == 1))
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MONTH = "|".join(MONTHS)
_CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d{1,9})?"
_ZONE = r"(?:Z|[ ]?[+-]\d\d:?\d\d|[ ](?:UTC|GMT)\b)"
TIME = (
    rf"\d{{4}}[-/]\d\d[-/]\d\d[T ]{_CLOCK}{_ZONE}?"
    rf"|\d\d/(?:{_MONTH})/\d{{4}}[: ]{_CLOCK}{_ZONE}?"
    rf"|\d\d/\d\d/\d\d[ ]{_CLOCK}{_ZONE}?"
    rf"|(?:{_MONTH})[ ]{{1,2}}\d{{1,2}}[ ]{_CLOCK}"
    r"|[12]\d{9}(?:\.\d{1,9}|\d{9}|\d{6}|\d{3})?(?![\w.])"
)
#: A time without a year right after a level letter: I1118 03:54:33.083017
LETTER_TIME = rf"\d{{4}}[ ]{_CLOCK}"

_PARTS = (
    re.compile(r"(?P<y>\d{4})[-/](?P<m>\d\d)[-/](?P<d>\d\d)[T ](?P<rest>.*)"),
    re.compile(rf"(?P<d>\d\d)/(?P<m>{_MONTH})/(?P<y>\d{{4}})[: ](?P<rest>.*)"),
    re.compile(r"(?P<y>\d\d)/(?P<m>\d\d)/(?P<d>\d\d)[ ](?P<rest>.*)"),
    re.compile(rf"(?P<m>{_MONTH})[ ]+(?P<d>\d{{1,2}})[ ](?P<rest>.*)"),
    re.compile(r"(?P<m>\d\d)(?P<d>\d\d)[ ](?P<rest>.*)"),
)
_REST = re.compile(r"(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?\s*(?:(Z|UTC|GMT)|([+-])(\d\d):?(\d\d))?$")
_NUMBER = re.compile(r"([12]\d{9})(?:\.(\d{1,9})|(\d{9}|\d{6}|\d{3}))?$")
_EPOCH = date(1970, 1, 1).toordinal()
DAY_US = 86_400_000_000


def _day(text: str) -> tuple[int | None, int, int, str] | None:
    """(year or None, month, day, what follows) of the start of a written time."""
    if (y := text[:4]).isdigit() and text[4:5] in ("-", "/") and text[10:11] in ("T", " ") and (m := text[5:7]).isdigit() and (d := text[8:10]).isdigit():
        return int(y), int(m), int(d), text[11:]
    for pattern in _PARTS:
        if found := pattern.match(text):
            parts = found.groupdict()
            month = parts["m"]
            year = parts.get("y")
            return (
                int(year) + 2000 * (len(year) == 2) if year else None,
                int(month) if month.isdigit() else MONTHS.index(month) + 1,
                int(parts["d"]),
                parts["rest"],
            )
    return None


@lru_cache(maxsize=4_096)
def _ordinal(year: int, month: int, day: int) -> int | None:
    try:
        return date(year, month, day).toordinal() - _EPOCH
    except ValueError:
        return None


def parse_time(text: str, near_ns: int | None) -> int | None:
    """Microseconds since 1970 UTC of a written time, or None if it is none.

    Digits beyond a microsecond are cut. No zone means UTC. Without a year, the year is taken that
    brings the time closest to ``near_ns``; with no such hint there is no time.
    """
    if text[:10].isdigit() and (number := _NUMBER.match(text)):
        whole, fraction, more = number.groups()
        return int(whole) * 1_000_000 + int(((fraction or more or "") + "000000")[:6])
    start = _day(text)
    clock = _REST.match(start[3]) if start else None
    if clock is None:
        return None
    year, month, day, _ = start
    h, m, s, fraction, _, sign, zh, zm = clock.groups()
    us = (int(h) * 3600 + int(m) * 60 + int(s)) * 1_000_000 + int(((fraction or "") + "000000")[:6])
    if sign:
        us -= (1 if sign == "+" else -1) * (int(zh) * 60 + int(zm)) * 60_000_000
    if year is not None:
        days = _ordinal(year, month, day)
        return None if days is None else days * DAY_US + us
    if near_ns is None:
        return None
    near = near_ns // 1000
    middle = date.fromordinal(min(max(near // DAY_US + _EPOCH, 400), 3_600_000)).year
    found = [d * DAY_US + us for y in (middle - 1, middle, middle + 1) if (d := _ordinal(y, month, day)) is not None]
    return min(found, key=lambda t: abs(t - near), default=None)
