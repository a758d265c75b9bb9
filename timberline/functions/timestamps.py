"""Timestamps in log text. All results are TIMESTAMP in a UTC session; NULL = absent."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default formats, tried in this order.
ISO = "yyyy-MM-dd'T'HH:mm:ssXXX"
DATETIME = "yyyy-MM-dd HH:mm:ss"
SYSLOG = "MMM dd HH:mm:ss"
CLF = "dd/MMM/yyyy:HH:mm:ss Z"
DEFAULT_FORMATS = (ISO, DATETIME, SYSLOG, CLF)

# Timestamps searched for anywhere in a generic line, in this order.
FIND_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})"
FIND_ISO_UTC = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z"
FIND_DATETIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
FIND_US = r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}"

# Month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_FRACTION = r"(?:[.,]\d+)?"
_WHOLE_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}T\d{{1,2}}:\d{{2}}:\d{{2}}{_FRACTION}(?:Z|[+-]\d{{2}}:\d{{2}})\z"
_WHOLE_DATETIME = rf"^\d{{4}}-\d{{2}}-\d{{2}} +\d{{1,2}}:\d{{2}}:\d{{2}}{_FRACTION}\z"
_WHOLE_SYSLOG = rf"^[A-Za-z]{{3}} +\d{{2}} +\d{{1,2}}:\d{{2}}:\d{{2}}{_FRACTION}\z"
_CLF_PARTS = (
    rf"^(\d{{2}})/([A-Za-z]{{3}})/(\d{{4}}):(\d{{1,2}}:\d{{2}}:\d{{2}}{_FRACTION}) +([+-]\d{{2}})(\d{{2}})\z"
)


def _month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def _cast(text: Column) -> Column:
    return text.try_cast("timestamp")


def parse_iso(text: Column) -> Column:
    return F.when(text.rlike(_WHOLE_ISO), _cast(F.translate(text, ",", ".")))


def parse_datetime(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, ",", "."), " +", " ")
    return F.when(text.rlike(_WHOLE_DATETIME), _cast(plain))


def from_parts(year: Column, month_name: Column, day: Column, clock: Column) -> Column:
    return _cast(
        F.concat(
            year.cast("string"), F.lit("-"), _month_number(month_name), F.lit("-"),
            F.lpad(day, 2, "0"), F.lit(" "), clock,
        )
    )


def parse_month_day(text: Column, year: Column) -> Column:
    """``Jan 26 10:00:01`` / ``Jan  6 10:00:01`` (blanks only) in the given year."""
    clock_at = F.instr(text, ":") - 2
    day = F.trim(F.substr(text, F.lit(4), clock_at - 4))
    clock = F.translate(F.substr(text, clock_at), ",", ".")
    return from_parts(year, F.substring(text, 1, 3), day, clock)


def parse_clf(text: Column) -> Column:
    """``26/Jan/2025:10:00:01 -0500``."""

    def build(year, month, day, clock, zone_h, zone_m):
        return _cast(
            F.concat(
                year, F.lit("-"), _month_number(month), F.lit("-"), day, F.lit(" "),
                clock, zone_h, F.lit(":"), zone_m,
            )
        )

    def part(start, length):
        return F.substring(text, start, length)

    usual = build(part(8, 4), part(4, 3), part(1, 2), part(13, 8), part(22, 3), part(25, 2))
    shape = F.concat(part(3, 1), part(7, 1), part(12, 1), part(21, 1)) == "//: "
    pieces = F.split(F.regexp_replace(text, _CLF_PARTS, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    rare = F.when(
        F.size(pieces) == 6,
        build(pieces[2], pieces[1], pieces[0], F.translate(pieces[3], ",", "."), pieces[4], pieces[5]),
    )
    return F.when(
        part(3, 1) == "/", F.when((F.length(text) == 26) & shape, usual).otherwise(rare)
    )


def pattern_width(fmt: str) -> int:
    """Characters that a timestamp written in the Spark pattern ``fmt`` takes."""
    zone_widths = {"XXX": 6, "xxx": 6, "XX": 5, "xx": 5, "Z": 5}
    width = 0
    for part in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|.", fmt):
        quoted, run = part.group(1), part.group(2)
        if quoted is not None:
            width += max(1, len(quoted))
        else:
            width += zone_widths.get(run, len(run)) if run else 1
    return width


def parse_with_formats(text: Column, formats: Sequence[str], year: Column) -> Column:
    """A whole string against each format; the first success."""
    known = {
        ISO: parse_iso,
        DATETIME: parse_datetime,
        SYSLOG: lambda t: F.when(t.rlike(_WHOLE_SYSLOG), parse_month_day(t, year)),
        CLF: parse_clf,
    }
    attempts = [
        known[fmt](text) if fmt in known else F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats
    ]
    return F.coalesce(*attempts) if attempts else F.lit(None).cast("timestamp")


def find_timestamp(line: Column, formats: Sequence[str], year: Column) -> Column:
    """First timestamp in a generic line; then each format against the line's prefix."""
    iso = F.regexp_extract(line, FIND_ISO, 0)
    iso_utc = F.regexp_extract(line, FIND_ISO_UTC, 0)
    date_time = F.regexp_extract(line, FIND_DATETIME, 0)
    us = F.regexp_extract(line, FIND_US, 0)
    us_iso = F.concat(
        F.substring(us, 7, 4), F.lit("-"), F.substring(us, 1, 2), F.lit("-"),
        F.substring(us, 4, 2), F.substring(us, 11, 9),
    )
    # plain substring tests spare most lines the searches that cannot succeed; the UTC
    # form is a special case of the first, so it is only worth a look after it
    attempts = [
        F.when(
            line.contains("T") & (iso != ""),
            F.coalesce(_cast(iso), F.when(iso_utc != "", _cast(iso_utc))),
        ),
        F.when(line.contains("-") & (date_time != ""), _cast(date_time)),
        F.when(line.contains("/") & (us != ""), _cast(us_iso)),
    ]
    for fmt in formats:
        # ISO and DATETIME prefixes are always found by the searches above
        if fmt in (ISO, DATETIME):
            continue
        prefix = F.substring(line, 1, pattern_width(fmt))
        attempts.append(
            F.when(F.length(line) >= pattern_width(fmt), parse_with_formats(prefix, [fmt], year))
        )
    return F.coalesce(*attempts)
