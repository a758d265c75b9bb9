"""Small byte regular expressions compiled to minimal deterministic automata.

Syntax: literals, ``\\`` escapes (``\\xHH`` too), ``[...]`` classes with ranges and ``^``, groups,
``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}`` and ``{n,m}``. Everything is bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Regular expression -> tree of ("set", bytes), ("cat", parts), ("alt", parts), ("star", part)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def tree(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._next()
            parts.append(self._sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def _sequence(self):
        parts = []
        while self._peek() and self._peek() not in "|)":
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self):
        part = self._atom()
        while self._peek() and self._peek() in "?*+{":
            sign = self._next()
            if sign == "{":
                low, _, high = self.text[self.at : self.text.index("}", self.at)].partition(",")
                counted = "," in self.text[self.at : self.text.index("}", self.at)]
                self.at = self.text.index("}", self.at) + 1
                most = int(low) if not counted else int(high) if high else None
                least = int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            more = [("star", part)] if most is None else [("alt", [part, ("cat", [])])] * (most - least)
            part = ("cat", [part] * least + more)
        return part

    def _code(self) -> int:
        sign = self._next()
        if sign != "\\":
            return ord(sign)
        sign = self._next()
        if sign == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(sign)

    def _atom(self):
        if self._peek() == "(":
            self._next()
            tree = self.tree()
            self._next()
            return tree
        if self._peek() != "[":
            return ("set", frozenset([self._code()]))
        self._next()
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]":
            low = self._code()
            high = low
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._next()
                high = self._code()
            found.update(range(low, high + 1))
        self._next()
        return ("set", frozenset(set(range(256)) - found if negated else found))


def _reverse(tree):
    kind, value = tree
    if kind == "cat":
        return (kind, [_reverse(x) for x in reversed(value)])
    if kind == "alt":
        return (kind, [_reverse(x) for x in value])
    return (kind, _reverse(value)) if kind == "star" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves that read nothing
        self.reads: list[tuple[frozenset, int] | None] = []

    def _state(self) -> int:
        self.free.append([])
        self.reads.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Add ``tree`` after ``start``; returns its end."""
        kind, value = tree
        if kind == "set":
            own, end = self._state(), self._state()
            self.free[start].append(own)
            self.reads[own] = (value, end)
            return end
        if kind == "cat":
            for part in value:
                start = self.add(part, start)
            return start
        end = self._state()
        if kind == "alt":
            for part in value:
                self.free[self.add(part, start)].append(end)
            return end
        inner = self._state()
        self.free[start] += [inner, end]
        self.free[self.add(value, inner)] += [inner, end]
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[row + kinds[byte]]`` is the row of the next state; rows are ``width`` apart.

    States whose rows are at ``first`` or later accept; ``masks[row // width]`` has bit k set where
    rule k does. ``dead`` is the row that nothing leaves and nothing accepts in, -1 without one.
    """

    kinds: bytes
    width: int
    table: list[int]
    masks: list[int]
    first: int
    start: int
    dead: int


def compile_rules(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """Subset construction over all patterns at once, then minimisation by partition refinement.

    ``anywhere``: a match may start at any byte. ``backwards``: the language of reversed words.
    """
    nfa = _Nfa()
    begin = nfa._state()
    ends = {}
    for k, pattern in enumerate(patterns):
        tree = _Parser(pattern).tree()
        ends[nfa.add(_reverse(tree) if backwards else tree, begin)] = 1 << k
    entry = nfa.closure([begin])
    # bytes that no set tells apart move alike
    sets = {x[0] for x in nfa.reads if x}
    kinds: dict[tuple, list[int]] = {}
    for byte in range(256):
        kinds.setdefault(tuple(byte in x for x in sets), []).append(byte)
    numbers, order, moves = {entry: 0}, [entry], []
    for states in order:  # grows while it is read
        reads = [nfa.reads[s] for s in states if nfa.reads[s]]
        row, known = [], {}
        for alike in kinds.values():
            to = frozenset(end for accepted, end in reads if alike[0] in accepted)
            if to not in known:
                target = nfa.closure(to) | entry if anywhere else nfa.closure(to)
                known[to] = numbers.setdefault(target, len(order))
                if known[to] == len(order):
                    order.append(target)
            row.append(known[to])
        moves.append(row)
    mask = np.array([sum(ends.get(s, 0) for s in states) for states in order])
    table = np.array(moves)
    _, block = np.unique(mask, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # accepting states last, so that one comparison tells them
    n, width = block.max() + 1, len(kinds)
    one = np.zeros(n, int)
    one[block] = np.arange(len(block))
    rank = np.argsort(np.lexsort([np.arange(n), mask[one] != 0]))
    final = np.zeros((n, width), int)
    final[rank] = rank[block[table[one]]]
    masks = np.zeros(n, int)
    masks[rank] = mask[one]
    dead = [s for s in range(n) if not masks[s] and (final[s] == s).all()]
    rows = [s * width for s in range(n)]  # one object for each
    kind_of = bytearray(256)
    for k, alike in enumerate(kinds.values()):
        for byte in alike:
            kind_of[byte] = k
    return Automaton(
        bytes(kind_of), width, [rows[s] for s in final.reshape(-1)], masks.tolist(), int((masks == 0).sum()) * width,
        int(rank[block[0]]) * width, rows[dead[0]] if dead else -1,
    )
