"""Predicates over entries. Each returns a Column, so they compose in one ``where``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from timberline.functions import levels
from timberline.functions.timeref import epoch_micros, parse_time_ref


def check_pattern(pattern: str) -> str:
    """Refuse an invalid (Java) regular expression before any job starts."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            # folded into a local relation: no job runs
            spark.sql("SELECT '' RLIKE :p", args={"p": pattern}).collect()
        except Exception as error:
            raise ValueError(f"invalid pattern: {pattern!r}") from error
    return pattern


def check_level(name: str, allow_unknown: bool = False) -> str:
    level = levels.normalize_level(name)
    if level == levels.UNKNOWN and not (allow_unknown and name == "unknown"):
        raise ValueError(f"invalid level: {name!r} (debug, info, warn, error or fatal)")
    return level


def matches(pattern: str, invert: bool = False) -> Column:
    """Regular expression anywhere in the raw line, or in none of it."""
    if not pattern:
        raise ValueError("a pattern is required")
    hit = F.col("raw").rlike(check_pattern(pattern))
    return ~hit if invert else hit


def has_level(name: str, allow_unknown: bool = False) -> Column:
    return F.col("level") == check_level(name, allow_unknown)


def at_least(name: str) -> Column:
    """Minimum severity; entries of unknown level always pass, ``unknown`` turns it off."""
    level = levels.normalize_level(name)
    if level == levels.UNKNOWN:
        return F.lit(True)
    return F.col("level").isin(*levels.LEVELS[levels.LEVELS.index(level):])


def in_time_range(
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    now: datetime | None = None,
) -> Column:
    """Both ends inclusive; entries without a time always pass."""
    ts = F.col("ts")
    inside = F.lit(True)
    if since is not None:
        inside = inside & (ts >= F.timestamp_micros(F.lit(epoch_micros(parse_time_ref(since, now)))))
    if until is not None:
        inside = inside & (ts <= F.timestamp_micros(F.lit(epoch_micros(parse_time_ref(until, now)))))
    return ts.isNull() | inside


def search_filter(
    pattern: str | None = None,
    invert: bool = False,
    level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    now: datetime | None = None,
    allow_unknown: bool = False,
) -> Column:
    """Exact level AND time range AND (inverted) pattern; what is absent does not filter."""
    if invert and not pattern:
        raise ValueError("invert needs a pattern")
    keep = F.lit(True)
    if level:
        keep = keep & has_level(level, allow_unknown)
    if since is not None or until is not None:
        keep = keep & in_time_range(since, until, now)
    if pattern:
        keep = keep & matches(pattern, invert)
    return keep


def entry_filter(
    pattern: str | None = None,
    invert: bool = False,
    min_level: str | None = None,
    exact_level: bool = False,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    now: datetime | None = None,
) -> Column:
    """Minimum or exact level AND time range AND (inverted) pattern."""
    keep = F.lit(True)
    if min_level and levels.normalize_level(min_level) != levels.UNKNOWN:
        keep = keep & (has_level(min_level) if exact_level else at_least(min_level))
    if since is not None or until is not None:
        keep = keep & in_time_range(since, until, now)
    if pattern:
        keep = keep & matches(pattern, invert)
    return keep


def tail_filter(min_level: str | None = None, pattern: str | None = None) -> Column:
    """Minimum level (unknown always passes) AND pattern."""
    keep = at_least(min_level) if min_level else F.lit(True)
    if pattern:
        keep = keep & matches(pattern)
    return keep
