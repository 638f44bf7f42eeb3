"""Texts and times from int64 nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nanos_to_ntz(nanos: Column) -> Column:
    """The UTC wall clock of nanoseconds since 1970, cut to microseconds, without a zone."""
    return F.timestamp_micros(nanos_to_micros(nanos)).cast("timestamp_ntz")


def nanos_to_micros(nanos: Column) -> Column:
    """Whole microseconds, rounded down, without going through a double."""
    return F.call_function("div", nanos - F.pmod(nanos, F.lit(1000).cast("long")), F.lit(1000).cast("long"))


def seconds_text(seconds: Column) -> Column:
    """A compact duration: 42s, 3m 5s, 2h 7m."""
    def part(divisor: int, modulus: int | None = None) -> Column:
        whole = F.floor(seconds / divisor)
        return (whole if modulus is None else whole % modulus).cast("long").cast("string")

    return (
        F.when(seconds < 60, F.concat(seconds.cast("long").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(part(60), F.lit("m "), part(1, 60), F.lit("s")))
        .otherwise(F.concat(part(3600), F.lit("h "), part(60, 60), F.lit("m")))
    )


def duration_text(start: Column, end: Column) -> Column:
    """The duration between two times in nanoseconds; 'Running...' without an end, '-' without a start."""
    whole = F.floor((end - start) / F.lit(1_000_000_000))
    return F.when(start.isNull(), "-").when(end.isNull(), "Running...").otherwise(seconds_text(whole))


def elapsed_text(start: Column, now: Column) -> Column:
    """hh:mm:ss from ``start`` to ``now`` (ns), never below zero."""
    s = F.floor(F.greatest(now - start, F.lit(0)) / F.lit(1_000_000_000)).cast("long")
    two = [F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0")]
    return F.concat_ws(":", *two)


def initials(name: Column) -> Column:
    """Up to two capitals: the first letters or digits of the first and the last word; '?' if there are none."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    first = lambda w: F.upper(F.regexp_extract(w, r"([\p{L}\p{N}])", 1))
    last = F.when(F.size(words) > 1, first(F.element_at(words, -1))).otherwise("")
    return F.when(F.size(words) < 1, "?").otherwise(F.concat(first(F.try_element_at(words, F.lit(1))), last))


#: Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 2_166_136_261, 16_777_619


def hue(seed: Column) -> Column:
    """A colour angle from 0 to 359 that only depends on the text: FNV-1a of its UTF-8 bytes, modulo 360."""
    digits = F.hex(F.encode(seed, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(digits) > 0, codes).otherwise(F.array().cast("array<long>"))
    mixed = F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(FNV_FACTOR).cast("long"), F.lit(1 << 32)))
    return F.pmod(mixed, F.lit(360)).cast("int")


def relative_text(at: Column, now_s: Column) -> Column:
    """How long ago a time (ns) was: 5s ago, 3m ago, 2h ago, 4d ago; just now for the future; a date after 30 days."""
    ago = now_s - F.floor(at / F.lit(1_000_000_000))
    part = lambda n, unit: F.concat(F.floor(ago / n).cast("long").cast("string"), F.lit(unit))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / F.lit(86_400_000_000_000)).cast("int")), "yyyy-MM-dd")
    return (
        F.when(ago < 0, "just now").when(ago < 60, part(1, "s ago")).when(ago < 3600, part(60, "m ago"))
        .when(ago < 86_400, part(3600, "h ago")).when(ago < 86_400 * 30, part(86_400, "d ago")).otherwise(date)
    )
