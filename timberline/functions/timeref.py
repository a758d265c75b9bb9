"""Time references and durations given as parameters (driver side)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Unit lengths in microseconds.
UNIT_MICROS = {
    "ns": 0.001,
    "us": 1,
    "µs": 1,
    "μs": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
}
DAY_MICROS = 86_400_000_000

_STANDARD = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+", re.ASCII)
_STANDARD_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", re.ASCII)
_EXTENDED = re.compile(r"(?:\d+[dhms])+", re.ASCII)
_EXTENDED_PART = re.compile(r"(\d+)([dhms])", re.ASCII)
_ABSOLUTE = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})"
    r"(?:(T| +)(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})?)?",
    re.ASCII,
)


def parse_duration(text: str) -> timedelta:
    """``5m``, ``1h30m``, ``1.5h``, ``100ms`` and day forms such as ``2d`` or ``1d2h``."""
    if text in ("0", "+0", "-0"):
        return timedelta(0)
    if _STANDARD.fullmatch(text):
        micros = sum(float(n) * UNIT_MICROS[u] for n, u in _STANDARD_PART.findall(text))
        return timedelta(microseconds=-micros if text.startswith("-") else micros)
    if _EXTENDED.fullmatch(text):
        micros = 0
        for number, unit in _EXTENDED_PART.findall(text):
            micros += int(number) * (DAY_MICROS if unit == "d" else UNIT_MICROS[unit])
        return timedelta(microseconds=micros)
    raise ValueError(f"invalid duration: {text!r}")


def _parse_absolute(text: str) -> datetime | None:
    found = _ABSOLUTE.fullmatch(text)
    if not found:
        return None
    year, month, day, sep, hour, minute, second, fraction, zone = found.groups()
    # a 'T' needs a zone, a blank must not have one
    if sep and (sep == "T") != (zone is not None):
        return None
    try:
        moment = datetime(
            int(year), int(month), int(day),
            int(hour or 0), int(minute or 0), int(second or 0),
            int((fraction or "0")[:6].ljust(6, "0")),
            tzinfo=timezone.utc,
        )
    except ValueError:
        return None
    if zone and zone != "Z":
        offset = timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
        moment += offset if zone[0] == "-" else -offset
    return moment


def parse_time_ref(value: str | datetime, now: datetime | None = None) -> datetime:
    """Absolute time (UTC unless it carries a zone), or ``now`` minus a duration."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    text = value.strip()
    if not text:
        raise ValueError("time reference is empty")
    moment = _parse_absolute(text)
    if moment is not None:
        return moment
    return (now or datetime.now(timezone.utc)) - parse_duration(text)


def micros(delta: timedelta) -> int:
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def epoch_micros(moment: datetime) -> int:
    return micros(moment - datetime(1970, 1, 1, tzinfo=timezone.utc))
