"""Severity levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names in ordinal order, and the accepted spellings.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
SPELLINGS = {
    "DEBUG": ("debug", "dbg"),
    "INFO": ("info", "inf"),
    "WARN": ("warn", "warning"),
    "ERROR": ("error", "err"),
    "FATAL": ("fatal", "critical", "crit"),
}
UNKNOWN = "UNKNOWN"
DISPLAY_ORDER = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG", "UNKNOWN")

# First level word of a line. ASCII word boundaries are spelled out because the
# JVM's \b is Unicode-aware.
LEVEL_WORD = r"(?i)(?<![0-9A-Za-z_])(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)(?![0-9A-Za-z_])"


def parse_level(text: Column) -> Column:
    """Level name for a spelling, any case; anything else is UNKNOWN."""
    # a literal map looks the word up once, where a CASE would repeat the expression
    names = F.create_map(
        *[F.lit(item) for level, words in SPELLINGS.items() for w in words for item in (w, level)]
    )
    return F.coalesce(F.element_at(names, F.lower(text)), F.lit(UNKNOWN))


def level_ordinal(level: Column) -> Column:
    """DEBUG=0 .. FATAL=4, UNKNOWN=5."""
    out = None
    for ordinal, name in enumerate(LEVELS[:-1]):
        out = (F if out is None else out).when(level == name, ordinal)
    return out.otherwise(len(LEVELS) - 1)


def level_name(ordinal: Column) -> Column:
    out = None
    for i, name in enumerate(LEVELS[:-1]):
        out = (F if out is None else out).when(ordinal == i, name)
    return out.otherwise(UNKNOWN)


def extract_level_word(text: Column) -> Column:
    """The first level word in the text as written, or ''."""
    return F.regexp_extract(text, LEVEL_WORD, 0)


def normalize_level(name: str) -> str:
    """Driver-side counterpart of ``parse_level`` for parameters."""
    word = name.lower()
    for level, spellings in SPELLINGS.items():
        if word in spellings:
            return level
    return UNKNOWN
