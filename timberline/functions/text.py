"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with the Unicode White_Space property.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x85\xa0 "
    "           "
    "    　"
)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    # left trim only: it stops at the first other character
    return F.ltrim(text, F.lit(WHITE_SPACE)) == ""


def estimate_tokens(text: Column) -> Column:
    """One token per four bytes, rounded down."""
    return F.floor(F.octet_length(text) / F.lit(4)).cast("bigint")


def truncate(text: Column, width: int) -> Column:
    """Text longer than ``width`` bytes is cut to ``width - 3`` characters and '...'."""
    return F.when(
        F.octet_length(text) > width,
        F.concat(F.substring(text, 1, width - 3), F.lit("...")),
    ).otherwise(text)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body(value)``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
