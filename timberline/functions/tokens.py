"""Message tokens: variable parts, masking, similarity and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
# Stands for a variable token inside a message key. Tokens never contain a tab, and
# unlike a literal '<*>' it equals no template token.
VARIABLE = "\t"

_BLANKS = r"[\t\n\f\r ]+"

# What counts as a variable token.
NUMBER = r"-?\d+(?:\.\d+)?"
HEX = r"0[xX][0-9a-fA-F]+"
DOTTED_QUAD = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ISO_PREFIX = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
LONG_PATH_BYTES = 20
# A redaction placeholder, optionally variable too.
PLACEHOLDER = r"\[[A-Z0-9_]+:[0-9a-f]+\]"


def tokenize(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"[^\t\n\f\r ]+"), F.lit(0))


def _variable_shapes(placeholders: bool) -> str:
    shapes = [NUMBER, HEX, DOTTED_QUAD, UUID, ISO_PREFIX + r"[^ ]*", r"/[^ ]{20,}"]
    return "|".join(shapes + ([PLACEHOLDER] if placeholders else []))


def is_variable(token: Column, placeholders: bool = False) -> Column:
    """Number, hex, dotted quad, UUID, ISO time prefix, or a path longer than 20 bytes."""
    long_path = token.startswith("/") & (F.octet_length(token) > LONG_PATH_BYTES)
    return token.rlike(rf"^(?:{_variable_shapes(placeholders)})\z") | long_path


def normalize_blanks(message: Column) -> Column:
    """Tokens joined by single blanks."""
    return F.trim(F.regexp_replace(message, _BLANKS, " "))


def _mask(message: Column, mark: str, placeholders: bool) -> Column:
    plain = normalize_blanks(message)
    masked = F.regexp_replace(
        plain, rf"(?<![^ ])(?:{_variable_shapes(placeholders)})(?![^ ])", mark
    )
    # the 20-byte rule for paths counts bytes, which only differs beyond ASCII
    by_token = F.array_join(
        F.transform(
            F.split(plain, " "),
            lambda t: F.when(is_variable(t, placeholders), mark).otherwise(t),
        ),
        " ",
    )
    return F.when(plain.rlike(r"(?<![^ ])/[^ ]*[^\x00-\x7f]"), by_token).otherwise(masked)


def mask_message(message: Column, placeholders: bool = False) -> Column:
    """The message with ``<*>`` for its variable tokens."""
    return _mask(message, WILDCARD, placeholders)


def message_key(message: Column, placeholders: bool = False) -> Column:
    """Messages with equal keys are interchangeable for template mining; '' has no tokens."""
    return _mask(message, VARIABLE, placeholders)


def similarity(a: Column, b: Column) -> Column:
    """Position-wise matches (a wildcard on either side counts) over the longer length."""

    def same(x: Column, y: Column) -> Column:
        both = x.isNotNull() & y.isNotNull()
        return both & ((x == y) | (x == WILDCARD) | (y == WILDCARD))

    matches = F.size(F.filter(F.zip_with(a, b, same), lambda hit: hit))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(matches / longest)


def merge(existing: Column, new: Column) -> Column:
    """Positions that differ, or that only one side has, become wildcards."""
    return F.zip_with(
        existing, new, lambda x, y: F.when(x == y, x).otherwise(F.lit(WILDCARD))
    )


def matches_template(message: Column, template_tokens: Column, threshold: float = 0.5) -> Column:
    return similarity(tokenize(message), template_tokens) >= threshold


def fits_template(tokens: Column, template_tokens: Column) -> Column:
    """Same length, and every template token is the message's or a wildcard."""
    fits = F.zip_with(
        template_tokens, tokens, lambda t, m: (t == WILDCARD) | (t == m)
    )
    return (F.size(tokens) == F.size(template_tokens)) & F.forall(
        fits, lambda ok: F.coalesce(ok, F.lit(False))
    )
