"""The in-task part of template mining; uses nothing but numpy and pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

WILDCARD = "<*>"
VARIABLE = "\t"
NEVER = (1 << 63) - 1
ROWS_PER_BATCH = 10_000
# keys times templates that are compared at a time
PRODUCT = 1 << 19


class Leaf:
    """Templates of one leaf while its keys are folded in; tokens as small integers."""

    WILD, VARIABLE, OTHER = -1, -2, -3

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.ids: dict[str, int] = {WILDCARD: self.WILD, VARIABLE: self.VARIABLE}
        self.count = 0
        self.tokens: np.ndarray | None = None
        self.born: list[int] = []
        self.init: list[list[str]] = []
        self.wild: list[np.ndarray] = []
        # how often a template got wildcards after it was founded
        self.merges = 0

    @classmethod
    def restored(cls, threshold: float, patterns: list[str]) -> Leaf:
        """A leaf with these templates; when they were founded is not known to it."""
        leaf = cls(threshold)
        for pattern in patterns:
            words = pattern.split(" ")
            coded = [leaf.ids.setdefault(w, len(leaf.ids)) for w in words]
            if leaf.tokens is None:
                leaf.tokens = np.empty((max(8, len(patterns)), len(words)), dtype=np.int64)
            leaf.tokens[leaf.count] = coded
            leaf.count += 1
            leaf.born.append(0)
            leaf.init.append(words)
            leaf.wild.append(np.where(np.array(coded) == cls.WILD, 0, NEVER))
        return leaf

    def patterns(self) -> list[str]:
        shown = [np.where(wild < NEVER, WILDCARD, np.array(init, dtype=object)) for init, wild in zip(self.init, self.wild)]
        return [" ".join(words) for words in shown]

    def add(self, words: list[str], seq: int) -> int:
        """Add a message; the place of its template."""
        ids = self.ids
        coded = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
        if self.tokens is None:
            self.tokens = np.empty((8, len(words)), dtype=np.int64)
        known = self.tokens[: self.count]
        hits = ((known == self.WILD) | (known == coded) | (coded == self.WILD)).sum(axis=1)
        near = np.flatnonzero(hits / len(words) >= self.threshold)
        if len(near):
            at = near[0]
            differs = (known[at] != self.WILD) & (known[at] != coded)
            if differs.any():
                known[at][differs] = self.WILD
                self.wild[at][differs] = seq
                self.merges += 1
            return int(at)
        if self.count == len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.empty_like(self.tokens)])
        masked = np.where(coded == self.VARIABLE, self.WILD, coded)
        self.tokens[self.count] = masked
        self.count += 1
        self.born.append(seq)
        self.init.append([WILDCARD if m == self.WILD else w for w, m in zip(words, masked)])
        self.wild.append(np.where(masked == self.WILD, seq, NEVER))
        return self.count - 1

    def add_all(self, words: list[list[str]], order: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Add ``words[i]`` for every i in ``order``: the places of their templates, and where in ``order`` one was founded.

        As long as no template gets wildcards, equal messages go where the last one went and change nothing.
        """
        places, founded, known, merges = [], [], {}, self.merges
        for nth, i in enumerate(order.tolist()):
            at = known.get(i)
            if at is None:
                before = self.count
                at = self.add(words[i], 0)
                if self.count > before:
                    founded.append(nth)
                if self.merges > merges:
                    known, merges = {}, self.merges
                known[i] = at
            places.append(at)
        return np.array(places, dtype=np.int64), founded

    def rows(self, values: tuple) -> Iterator[tuple]:
        for i in range(self.count):
            yield (*values, i, self.born[i], self.init[i], self.wild[i].tolist())


def folder(
    group: tuple[str, ...], threshold: float
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` function over keys sorted by leaf and position."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*group, "idx", "born", "init", "wild"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # only the current leaf is held
        current, state, done = None, None, []
        for batch in batches:
            leaves = zip(*[batch[c].tolist() for c in group])
            for leaf, key, seq in zip(leaves, batch["key"], batch["first_seq"]):
                if leaf != current:
                    if state is not None:
                        done.extend(state.rows(current))
                    current, state = leaf, Leaf(threshold)
                state.add(key.split(" "), int(seq))
            if len(done) > ROWS_PER_BATCH:
                yield frame(done)
                done = []
        if state is not None:
            done.extend(state.rows(current))
        yield frame(done)

    return run


class Templates:
    """A block of one leaf's templates, in the order of their creation, with when each position became a wildcard."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.ids: dict[str, int] = {WILDCARD: Leaf.WILD, VARIABLE: Leaf.VARIABLE}
        self.idx: list[int] = []
        self.born: list[int] = []
        self.init: list[list[int]] = []
        self.wild: list[list[int]] = []

    def add(self, idx: int, born: int, init: list[str], wild: list[int]) -> None:
        self.idx.append(idx)
        self.born.append(born)
        self.init.append(self.coded(init))
        self.wild.append(wild)

    def coded(self, words: list[str]) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids)) for w in words]

    def check(self, keys: list[str], first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For the keys that are near a template: their places, the first near one at their first line (or -1), whether
        that covers them, and when one before it came near up to their last line (or NEVER)."""
        if not self.idx:
            return
        idx, born = np.array(self.idx), np.array(self.born, dtype=np.int64)
        init, wild = np.array(self.init, dtype=np.int64), np.array(self.wild, dtype=np.int64)
        # a token that no template has is like no other
        place = self.ids.get
        codes = np.array([[place(w, Leaf.OTHER) for w in column] for column in zip(*(k.split(" ") for k in keys), strict=True)], dtype=np.int64).T
        width = init.shape[1]
        step = max(1, PRODUCT // len(idx))
        for at in range(0, len(keys), step):
            part, one, end = codes[at : at + step], first[at : at + step, None], last[at : at + step, None]
            early, late, fit = (np.zeros((len(part), len(idx)), dtype=np.int32) for _ in range(3))
            for j in range(width):
                same = init[:, j] == part[:, j, None]
                free = (part[:, j] == Leaf.WILD)[:, None]
                now = same | (wild[:, j] <= one)
                fit += now
                early += now | free
                late += same | free | (wild[:, j] <= end)
            near = (born <= one) & (early / width >= self.threshold)
            soon = (born <= end) & (late / width >= self.threshold)
            found = near.any(axis=1)
            chosen = np.where(found, near.argmax(axis=1), len(idx))
            before = soon & (np.arange(len(idx)) < chosen[:, None])
            moments = np.full(len(part), NEVER, dtype=np.int64)
            for i in np.flatnonzero(before.any(axis=1)).tolist():
                moment = NEVER
                for t in np.flatnonzero(before[i]).tolist():
                    matched = (init[t] == part[i]) | (part[i] == Leaf.WILD)
                    times = np.sort(np.where(matched, -1, wild[t]))
                    # as many matches as are needed, counted as above
                    enough = np.flatnonzero(np.arange(1, width + 1) / width >= self.threshold)[0]
                    moment = min(moment, max(int(times[enough]), self.born[t]))
                moments[i] = moment
            said = np.flatnonzero(found | (moments < NEVER))
            # (the last template stands in for none)
            at_most = np.minimum(chosen, len(idx) - 1)
            covers = found & (fit[np.arange(len(part)), at_most] == width)
            if len(said):
                yield at + said, np.where(found, idx[at_most], -1)[said], covers[said], moments[said]


def checker(group: tuple[str, ...], threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` function over blocks of templates, each followed by a block of keys of their leaf."""

    names = [*group, "key", "first_seq", "part", "idx", "covers", "moment"]

    def runs(batch: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        """The rows of each block that the batch has, in order."""
        at = [*group, "block", "part"]
        codes = np.array([pd.factorize(batch[c], use_na_sentinel=False)[0] for c in at])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.iloc[a:b]
            yield tuple(None if pd.isna(rows[c].iat[0]) else rows[c].iat[0] for c in at), rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, block = None, Templates(threshold)
        for batch in batches:
            if batch.empty:
                continue
            for own, rows in runs(batch):
                if own != current:
                    current, block = own, Templates(threshold)
                of_templates = rows["key"].isna()
                for idx, born, init, wild in rows.loc[of_templates, ["idx", "born", "init", "wild"]].itertuples(index=False):
                    block.add(int(idx), int(born), list(init), list(wild))
                rows = rows[~of_templates]
                if rows.empty:
                    continue
                keys, first, last = rows["key"].to_numpy(), rows["first_seq"].to_numpy(np.int64), rows["last_seq"].to_numpy(np.int64)
                for at, idx, covers, moment in block.check(keys.tolist(), first, last):
                    said = {"key": keys[at], "first_seq": first[at], "part": own[-1], "idx": idx, "covers": covers, "moment": moment}
                    yield pd.DataFrame({**{c: [v] * len(at) for c, v in zip(group, own[:-2], strict=True)}, **said}, columns=names)

    return run
