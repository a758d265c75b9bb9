"""Secret scans with one combined deterministic automaton.

All rules are compiled into one transition array (see ``automata``). A text is read once, byte by
byte; where a rule accepts, the run of accepting bytes gives the end of a match, and the rule's
reversed automaton, run back from there, its leftmost start that is not inside the previous match
of that rule. That yields the leftmost non-overlapping matches of every rule. A rule therefore has
to end in a repeated class or in fixed text; its length limits are checked afterwards, without
retries, so that a match that is too short still uses up its text.

Defined cases: a null text is an empty one; an empty text has no spans; repeated rows and ties
between rules are all reported, ordered by start and then in the order of the rules. Spans count
code points, the end is exclusive. Only the text column is read, so other columns may have any
name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from timberline.llm.automata import Automaton, compile_rules


@dataclass(frozen=True)
class Rule:
    """``tail``: the class that the value ends with; ``least`` and ``most``: bytes of value or, without, match."""

    kind: str
    pattern: str
    least: int = 0
    most: int | None = None
    value: str | None = None


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?"

RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 12, value=_ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    # all shorter runs fail, so the length can be part of the automaton
    Rule("hex", "[0-9a-f]{16,}", 16),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    forward: Automaton
    backward: tuple[Automaton, ...]

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        back = tuple(compile_rules([r.pattern], anywhere=False, backwards=True) for r in rules)
        return cls(rules, compile_rules([r.pattern for r in rules], anywhere=True), back)

    def _runs(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(rule, end) of every run of bytes at which a rule accepts, in order of the ends."""
        own = self.forward
        table, masks, first, state, width = own.table, own.masks, own.first, own.start, own.width
        open_mask, last = 0, -1
        for at, kind in enumerate(data.translate(own.kinds)):
            state = table[state + kind]
            if state >= first:
                mask = masks[state // width]
                if at == last + 1:
                    closed = open_mask & ~mask
                else:
                    closed = open_mask
                if closed:
                    for k in range(len(self.rules)):
                        if closed >> k & 1:
                            yield k, last + 1
                open_mask, last = mask, at
        for k in range(len(self.rules)):
            if open_mask >> k & 1:
                yield k, last + 1

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes."""
        used = [0] * len(self.rules)
        found = []
        for k, end in self._runs(data):
            back, low, start = self.backward[k], used[k], -1
            table, kinds, first, dead, state, at = back.table, back.kinds, back.first, back.dead, back.start, end
            while at > low:
                at -= 1
                state = table[state + kinds[data[at]]]
                if state >= first:
                    start = at
                elif state == dead:
                    break
            if start < 0:
                continue
            used[k] = end
            rule = self.rules[k]
            size = end - start
            if rule.value is not None:
                size -= _value_start(rule.value, data[start:end])
            if size >= rule.least and (rule.most is None or size <= rule.most):
                found.append((k, start, end))
        return sorted(found, key=lambda x: (x[1], x[0]))


_VALUES: dict[str, re.Pattern] = {}


def _value_start(pattern: str, match: bytes) -> int:
    if pattern not in _VALUES:
        _VALUES[pattern] = re.compile(pattern.encode())
    return _VALUES[pattern].match(match).end()


def code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """Byte offsets -> numbers of code points before them."""
    if data.isascii():
        return {p: p for p in places}
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return dict(zip(places, np.searchsorted(starts, places).tolist(), strict=True))


def find(scanner: Scanner, text: str | None) -> list[tuple[str, int, int]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scanner.spans(data)
    at = code_points(data, sorted({p for _, s, e in found for p in (s, e)})) if found else {}
    return [(scanner.rules[k].kind, at[s], at[e]) for k, s, e in found]


def secret_spans(spark: SparkSession, text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of (kind, start, end) of all secrets in ``text``; the automata are broadcast (a few MB)."""
    shared = spark.sparkContext.broadcast(Scanner.of(rules))

    @F.pandas_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = shared.value
        for texts in batches:
            yield pd.Series([
                [{"kind": k, "start": s, "end": e} for k, s, e in find(scanner, t)] for t in texts
            ], dtype=object)

    return spans(text)
