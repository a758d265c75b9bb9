"""Personal data: expressions propose spans, checksums confirm them, context words move the score.

Kinds: email, ip (four parts up to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits),
iban (mod 97), ssn (needs a context word). Every proposal is leftmost and does not overlap another
of its kind; one that fails its check is dropped and its text is used up (of an iban, the head). The score is the kind's
prior, raised if a context word of the kind stands within ``CONTEXT`` characters before or after
the span; spans below ``threshold`` are dropped. email, ip, card and phone start at or above it.

Defined cases: a null text is an empty one and has no spans; repeated rows and overlapping spans of
different kinds are all reported; order is by kind as listed, then by start. Spans count code
points, the end is exclusive. Only the text column is read, so other columns may have any name.
All scans are linear in the text, so very long runs of one class do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 48
THRESHOLD = 0.5
RAISE = 0.35

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a start inside a run of digits fails where the start of the run does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
        22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_IBAN_REST = {n: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(_IBAN_LENGTHS.values())}
_IBAN_REST[None] = re.compile(r"(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Proposed by the domain; the local part is what stands before the sign, up to the previous match."""
    used = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            used = m.end()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As long as the country code prescribes; of an unknown code, as far as it goes. A wrong one only uses up its head."""
    at = 0
    while head := _IBAN_HEAD.search(text, at):
        at = head.end()
        rest = _IBAN_REST[_IBAN_LENGTHS.get(head[0][:2])].match(text, at)
        if rest and is_iban(text[head.start() : rest.end()]):
            at = rest.end()
            yield head.start(), at


def _by(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def is_ip(match: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in match.split(".")))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def is_card(match: str) -> bool:
    digits = _NOT_DIGIT.sub("", match)
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_phone(match: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", match)) <= 15


def is_iban(match: str) -> bool:
    code = match.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def is_ssn(match: str) -> bool:
    return match[:3] not in ("000", "666") and match[0] != "9" and match[4:6] != "00" and match[7:] != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    prior: float
    context: re.Pattern


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?i)\b(?:" + "|".join(words) + r")\b")


KINDS = (
    Kind("email", emails, lambda m: True, 0.6, _words("e-?mail", "mail", "contact", "write", "correo")),
    Kind("ip", _by(_IP), is_ip, 0.5, _words("ip", "host", "server", "address", "client", "from")),
    Kind("card", _by(_CARD), is_card, 0.6, _words("card", "visa", "mastercard", "credit", "debit", "karte", "carte")),
    Kind("phone", _by(_PHONE), is_phone, 0.5, _words("phone", "tel", "call", "mobile", "fax", "telefon")),
    Kind("iban", ibans, is_iban, 0.6, _words("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", _by(_SSN), is_ssn, 0.2, _words("ssn", "social security")),
)


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    found = []
    for kind in KINDS if text else ():
        for start, end in kind.propose(text):
            if kind.confirm(text[start:end]):
                near = kind.context.search(text[max(0, start - CONTEXT) : start]) or kind.context.search(text[end : end + CONTEXT])
                score = round(kind.prior + RAISE * bool(near), 2)
                if score >= threshold:
                    found.append((kind.name, start, end, score))
    return found


def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([
            [{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t)] for t in texts
        ], dtype=object)


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end, score) of the personal data in ``text``."""
    return F.pandas_udf(_spans, "array<struct<kind: string, start: bigint, end: bigint, score: double>>")(text)
