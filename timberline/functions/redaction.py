"""Sensitive values: the pattern catalogue, and redaction as Column expressions.

Placeholders are a function of the value alone (``[TYPE:hash]``), so equal values get
equal placeholders on every executor without any shared state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.text import bind


@dataclass(frozen=True)
class Pattern:
    name: str
    type: str
    regex: str
    # cheap necessary condition; the regex runs only on text that passes
    may_match: Callable[[Column], Column]


# Word boundaries in ASCII, as the JVM's \b is Unicode-aware.
_B = r"(?<![0-9A-Za-z_])"
_E = r"(?![0-9A-Za-z_])"
_EDGE = rf"(?:(?<=[0-9A-Za-z_]){_E}|{_B}(?=[0-9A-Za-z_]))"

# The patterns.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_H = r"[0-9a-fA-F]{1,4}"
IPV4 = _B + r"\.".join([_OCTET] * 4) + _E
IPV6 = "|".join(
    [
        rf"(?:{_H}:){{7}}{_H}",
        rf"(?:{_H}:){{1,7}}:",
        rf"(?:{_H}:){{1,6}}:{_H}",
        rf"(?:{_H}:){{1,5}}(?::{_H}){{1,2}}",
        rf"(?:{_H}:){{1,4}}(?::{_H}){{1,3}}",
        rf"(?:{_H}:){{1,3}}(?::{_H}){{1,4}}",
        rf"(?:{_H}:){{1,2}}(?::{_H}){{1,5}}",
        rf"{_H}:(?::{_H}){{1,6}}",
        rf":(?::{_H}){{1,7}}",
        rf"::(?:[fF]{{4}}(?::0{{1,4}}){{0,1}}:){{0,1}}(?:{_OCTET}\.){{3}}{_OCTET}",
        rf"(?:{_H}:){{1,4}}:(?:{_OCTET}\.){{3}}{_OCTET}",
    ]
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# case folding also takes the long s and the Kelvin sign for s and k
API_KEY = (
    r"(?i)(?:api[_-]?[kK]ey|api[kK]ey|to[kK]en|[sſ]ecret"
    r"|pa[sſ][sſ]word|pa[sſ][sſ]wd|pwd)"
    r'["\t\n\f\r ]*[:=]["\t\n\f\r ]*[a-zA-Z0-9_\-ſK]{8,}'
)
AWS_KEY = _B + r"AKIA[0-9A-Z]{16}" + _E
JWT = _B + r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*" + _EDGE
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
MAC_ADDRESS = _B + r"(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})" + _E
CREDIT_CARD = _B + r"(?:\d{4}[-\t\n\f\r ]?){3}\d{4}" + _E
UUID = _B + r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + _E


def _has(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        out = text.contains(parts[0])
        for part in parts[1:]:
            out = out | text.contains(part)
        return out

    return test


def _names_a_secret(text: Column) -> Column:
    """A separator, and a part of each key word that case folding leaves alone."""
    folded = F.lower(text)
    word = _has("api", "token", "ecret", "word", "wd")(folded)
    return (text.contains(":") | text.contains("=")) & word


CATALOGUE = {
    p.name: p
    for p in (
        Pattern("ipv4", "IPV4", IPV4, _has(".")),
        Pattern(
            "ipv6", "IPV6", IPV6,
            lambda t: t.contains("::") | (t.contains(":") & t.rlike(rf"(?:{_H}:){{7}}")),
        ),
        Pattern("email", "EMAIL", EMAIL, _has("@")),
        Pattern("api_key", "SECRET", API_KEY, _names_a_secret),
        Pattern("aws_key", "AWS_KEY", AWS_KEY, _has("AKIA")),
        Pattern("jwt", "JWT", JWT, _has("eyJ")),
        Pattern("private_key", "PRIVATE_KEY", PRIVATE_KEY, _has("-----BEGIN")),
        Pattern("mac_address", "MAC", MAC_ADDRESS, _has(":", "-")),
        Pattern("credit_card", "CC", CREDIT_CARD, lambda t: F.length(t) >= 16),
        Pattern("uuid", "UUID", UUID, _has("-")),
    )
}
# The default selection, in the order of application.
DEFAULT_NAMES = ("ipv4", "ipv6", "email", "api_key", "aws_key", "jwt", "private_key")


# Stands for a match where a text is cut.
_CUT = "\x00"


def select_patterns(names: Sequence[str] | None = None) -> list[Pattern]:
    """Patterns by name, in the given order; unknown names are ignored, none = the defaults."""
    chosen = [CATALOGUE[n] for n in names or () if n in CATALOGUE]
    return chosen or [CATALOGUE[n] for n in DEFAULT_NAMES]


def short_hash(value: Column, length: int = 4) -> Column:
    """First hex digits of the SHA-256."""
    return F.substring(F.sha2(value, 256), 1, length)


def normalize_value(value: Column, kind: str) -> Column:
    """Spelling-independent form of e-mail and IP addresses."""
    return F.lower(value) if kind in ("EMAIL", "IPV4", "IPV6") else value


def placeholder(value: Column, kind: str, hash_len: int = 4, normalize: bool = False) -> Column:
    key = normalize_value(value, kind) if normalize else value
    return F.concat(F.lit(f"[{kind}:"), short_hash(key, hash_len), F.lit("]"))


def find_all(text: Column, pattern: Pattern) -> Column:
    return F.when(
        pattern.may_match(text), F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def _between(text: Column, regex: str) -> Column:
    """What stands before, between and behind the matches.

    ``split`` compiles its expression for every text, ``regexp_replace`` once; a text with the mark itself is rare.
    """
    marked = F.split(F.regexp_replace(text, regex, _CUT), _CUT, -1)
    return F.when(text.contains(_CUT), F.split(text, regex, -1)).otherwise(marked)


def redact_and_count(
    text: Column,
    names: Sequence[str] | None = None,
    hash_len: int = 4,
    normalize: bool = False,
    keep_found: bool = False,
) -> Column:
    """STRUCT<text, count>: patterns applied in order, replacements counted along the way.

    ``keep_found`` adds ``found``, the replaced values as ARRAY<STRUCT<nth, type, value>>
    where ``nth`` is the place of the pattern in the selection.
    """

    def step(nth: int, pattern: Pattern):
        def apply(state: Column) -> Column:
            def rebuild(found: Column) -> Column:
                marks = F.transform(
                    found, lambda v: placeholder(v, pattern.type, hash_len, normalize)
                )
                around = _between(state["text"], pattern.regex)
                pieces = F.zip_with(
                    around, F.concat(marks, F.array(F.lit(""))), lambda a, b: F.concat(a, b)
                )
                changed = [
                    F.array_join(pieces, "").alias("text"),
                    (state["count"] + F.size(found)).alias("count"),
                ]
                if keep_found:
                    values = F.transform(
                        found,
                        lambda v: F.struct(
                            F.lit(nth).alias("nth"), F.lit(pattern.type).alias("type"), v.alias("value")
                        ),
                    )
                    changed.append(F.concat(state["found"], values).alias("found"))
                return F.when(F.size(found) > 0, F.struct(*changed)).otherwise(state)

            found = F.regexp_extract_all(state["text"], F.lit(pattern.regex), F.lit(0))
            return F.when(pattern.may_match(state["text"]), bind(found, rebuild)).otherwise(state)

        return apply

    start = [text.alias("text"), F.lit(0).cast("bigint").alias("count")]
    if keep_found:
        none = F.array().cast("array<struct<nth:int,type:string,value:string>>")
        start.append(none.alias("found"))
    state = F.struct(*start)
    for nth, pattern in enumerate(select_patterns(names)):
        state = bind(state, step(nth, pattern))
    return state


def redact(text: Column, names: Sequence[str] | None = None, **options) -> Column:
    return redact_and_count(text, names, **options)["text"]


def is_sensitive(text: Column, names: Sequence[str] | None = None) -> Column:
    out = F.lit(False)
    for pattern in select_patterns(names):
        out = out | (pattern.may_match(text) & text.rlike(pattern.regex))
    return out


def count_sensitive(text: Column, names: Sequence[str] | None = None) -> Column:
    """Distinct sensitive values in the original text, over all patterns."""
    found = F.array(*[find_all(text, p) for p in select_patterns(names)])
    return F.size(F.array_distinct(F.flatten(found))).cast("bigint")
