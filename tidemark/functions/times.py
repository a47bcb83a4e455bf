"""Timestamps from numbers and text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date, "T", time, optional fraction, then Z or a numeric offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)? ?(Z|[+-]\d{2}:?\d{2})?$"
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? "
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
_ZONE = r"([+-]\d{4}|[A-Za-z][A-Za-z/_]*)"
# "2 Jan 2006 15:04:05 -0700", dashes between words as well as blanks; and "Jan 2 15:04:05 2006" or "Jan 2, 2006".
_DAY_FIRST = rf"(?i)^(\d{{1,2}})[- ]{_MONTH}[- ](\d{{4}}|\d{{2}})(?: {_CLOCK}(?: ?{_ZONE})?)?$"
_MONTH_FIRST = rf"(?i)^{_MONTH} (\d{{1,2}})(?:, (\d{{4}})| {_CLOCK}(?: {_ZONE})? (\d{{4}}))$"
_MONTH_NAMES = "janfebmaraprmayjunjulaugsepoctnovdec"
# Hours from UTC of the zones that mail dates name by letters.
_MAIL_ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

# Seconds beyond this do not fit a timestamp, either way.
_LAST_SECOND = 9_223_372_036_854


def timestamp_literal(value: str | dt.datetime) -> Column:
    """A constant timestamp; naive values are UTC. Folds, so it still reaches the scan."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        value = value.isoformat()
    return F.lit(value).cast("timestamp")


def epoch_micros(value: dt.datetime) -> int:
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def unix_to_time(n: Column) -> Column:
    """Epoch number to timestamp, its unit read off its size: above 1e15 micros, above
    1e12 millis, else seconds. Values no timestamp can hold give NULL, not a failed job."""
    n = n.cast("bigint")
    seconds = F.when(n > 10**15, F.floor(n / 10**6)).when(n > 10**12, F.floor(n / 1000)).otherwise(n)
    within = seconds.between(-_LAST_SECOND, _LAST_SECOND)
    return F.when(
        within,
        F.when(n > 10**15, F.timestamp_micros(n))
        .when(n > 10**12, F.timestamp_millis(n))
        .otherwise(F.timestamp_seconds(n)),
    )


def rfc3339(text: Column) -> Column:
    """Timestamp of RFC 3339 text, NULL for anything else (a bare date included)."""
    return F.when(text.rlike(RFC3339), F.translate(text, ",", ".").try_cast("timestamp"))


def _zone(name: Column) -> Column:
    """A zone as a cast reads it. None means UTC; letters that mail dates do not know are left to the cast."""
    upper = F.upper(name)
    known = F.create_map(*[F.lit(x) for k, h in _MAIL_ZONES.items() for x in (k, f"{h:+03d}:00")])
    return (
        F.when(name == "", "Z")
        .when(name.rlike(r"^[+-]"), F.concat(name.substr(1, 3), F.lit(":"), name.substr(4, 2)))
        .otherwise(F.coalesce(F.try_element_at(known, upper), F.concat(F.lit(" "), name)))
    )


def feed_date(text: Column) -> Column:
    """Publication date as feeds write it: RFC 1123, 850 and 822 with or without weekday, full month
    names, asctime, RFC 3339, and ISO dates without zone or time, which are UTC.

    A date's parts are taken out by shape and written one way, so that a single cast reads all of them: no chain
    of formats is tried, and the expression stays small enough to be compiled.
    """
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    bare = F.regexp_replace(one_line, _WEEKDAY, "")
    # One pass puts either shape's parts in the same order: year, month, day, clock, zone.
    parts = F.when(bare.rlike(_DAY_FIRST), F.regexp_replace(bare, _DAY_FIRST, "$3|$2|$1|$4|$5|$6|$7")).when(
        bare.rlike(_MONTH_FIRST), F.regexp_replace(bare, _MONTH_FIRST, "$3$8|$1|$2|$4|$5|$6|$7")
    )

    # Generated code works the split out once for all of its parts.
    split = F.split(parts, r"\|", -1)
    year, month, day, hour, minute, second, zone = (F.get(split, i) for i in range(7))
    # Two digits from 69 on are of the last century.
    century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
    number = (F.position(F.lower(month), F.lit(_MONTH_NAMES)) + 2) / 3
    padded = lambda x: F.lpad(x, 2, "0")
    shaped = F.concat(
        century, year, F.lit("-"), padded(number.cast("int").cast("string")), F.lit("-"), padded(day), F.lit("T"), padded(hour), F.lit(":"),
        padded(minute), F.lit(":"), padded(second), _zone(zone),
    )
    iso = F.when(one_line.rlike(_ISO), F.translate(one_line, ",", "."))
    return F.coalesce(shaped, iso).try_cast("timestamp")
