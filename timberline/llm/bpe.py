"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

A sequence of tokens is the encoding of a piece if and only if every two neighbours can stand side
by side: merging never joins bytes of both. So each prefix of a piece has exactly one possible last
token, which follows from the last tokens of shorter prefixes. The transducer reads byte by byte.
Its states are the sets of tokens that may have begun at any earlier byte (subset construction over
the merges' results), made when they are first met and never more than the vocabulary has prefixes;
a move tells the tokens that end with its byte, and registers hold the last tokens of the prefixes
in which a token is begun. Once the held back tail is ``LOOKAHEAD`` bytes long, the tokens on which
all begun ones agree are emitted; none of a shorter piece can wait longer than its end.

A piece that is itself a token becomes that token, whatever the merges say; this is what the
common implementation of rank files does.

Decoding concatenates the tokens' bytes and lets an incremental UTF-8 automaton, advanced a token
at a time, tell where a block of text may end. Bytes that are no UTF-8 become U+FFFD.

Defined cases: a null or empty text has no tokens; null ids decode to an empty text; repeated rows
are encoded each on their own; texts are processed whole, in linear time, by pieces of the
splitting pattern. Only the given column is read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import kept_in_worker

# Bounds of what a worker remembers; none of them changes a result.
MAX_STATES = 1 << 18
MAX_PAIRS = 1 << 19
MAX_PIECES = 1 << 19
FLUSH_TOKENS = 1 << 13
LOOKAHEAD = 1 << 9
ROWS = 256


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class _State:
    """All tokens that are begun: ``suffix`` is the longest, the others begin at later bytes of it."""

    __slots__ = ("moves", "suffix")

    def __init__(self, suffix: bytes):
        self.suffix = suffix
        self.moves: dict[int, tuple[_State, tuple]] = {}


class Transducer:
    def __init__(self, tokens: list[bytes], max_states: int = MAX_STATES):
        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens) if token}
        self.longer = {token[:i] for token in self.ranks for i in range(1, len(token))}
        self.max_states = max_states
        self.pairs: dict[int, dict[int, bool]] = {}  # right token -> left token -> can stand before it
        self.n_pairs = 0
        self.edges: dict[tuple[int, bool], list | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.root = _State(b"")
        self.states = {b"": self.root}

    def merged(self, data: bytes, trace: list | None = None) -> list[int]:
        """Plain merging by rank. ``trace`` gets the place, the number of parts and the result of every merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            if trace is not None:
                trace.append((at, len(parts), parts[at] + parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, right: bool) -> list | None:
        """What stands at one edge of a token while it is merged: (bytes, rank of the merge that ends it).

        None for a token that merging its bytes does not give.
        """
        key = (token, right)
        if key not in self.edges:
            data, trace = self.tokens[token], []
            if self.merged(data, trace) != [token]:
                self.edges[key] = None
            else:
                own = [data[-1:] if right else data[:1]]
                own += [made for at, parts, made in trace if at == (parts - 2 if right else 0)]
                self.edges[key] = [(x, self.ranks[y] if y else 1 << 60) for x, y in zip(own, [*own[1:], b""], strict=True)]
        return self.edges[key]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging never joins bytes of both tokens, so that they can stand side by side.

        Merges happen in the order of ranks. One across the border needs both its parts to be there,
        that is before either is merged into more of its own token; of equal ranks the left one is first.
        """
        before, after = self._edge(left, True), self._edge(right, False)
        known = before is not None and after is not None
        if known:
            get = self.ranks.get
            for x, x_end in before:
                for y, y_end in after:
                    rank = get(x + y)
                    if rank is not None and rank < x_end and rank <= y_end:
                        known = False
                        break
                if not known:
                    break
        self.n_pairs += 1
        if self.n_pairs > MAX_PAIRS:
            self.n_pairs = 0
            for row in self.pairs.values():
                row.clear()
                row[-1] = True
        self.pairs[right][left] = known
        return known

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple]:
        """Next state, and (token, size, neighbours) of the tokens that end with this byte."""
        read = state.suffix + bytes((byte,))
        ends = tuple(
            (token, len(read) - i, self.pairs.setdefault(token, {-1: True}))
            for i in range(len(read))
            if (token := self.ranks.get(read[i:])) is not None and self._edge(token, False) is not None
        )
        suffix = next(read[i:] for i in range(len(read) + 1) if i == len(read) or read[i:] in self.longer)
        to = self.states.get(suffix)
        if to is None:
            to = self.states[suffix] = _State(suffix)
        move = state.moves[byte] = (to, ends)
        return move

    def _path(self, last: list, end: int) -> list[int]:
        """Positions before which the tokens of the prefix of size ``end`` end, from the end back to 0."""
        path = [end]
        while end:
            end -= len(self.tokens[last[end]])
            path.append(end)
        return path

    def _emit(self, last: list, out: list, state: _State) -> list:
        """Move the tokens that no further byte can change from ``last`` to ``out``."""
        n, suffix = len(last) - 1, state.suffix
        begun = [n, *(n - len(suffix) + i for i in range(len(suffix)) if suffix[i:] in self.longer)]
        paths = [self._path(last, at) for at in begun if last[at] is not None]
        sure = max(set.intersection(*map(set, paths)), default=0) if paths else 0
        if sure:
            out += [last[at] for at in self._path(last, sure)[-2::-1]]
        return last[sure:]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._forget()
        state, out = self.root, []
        # last[i]: last token of the prefix of size i since what was emitted; before a piece there is none
        last: list[int | None] = [-1]
        n = 0
        for byte in piece:
            move = state.moves.get(byte) or self._move(state, byte)
            state, ends = move
            n += 1
            found = None
            for token, size, row in ends:
                left = last[n - size]
                if left is not None:
                    fits = row.get(left)
                    if fits is None:
                        fits = self._neighbours(left, token)
                    if fits:
                        found = token
                        break
            last.append(found)
            if n >= LOOKAHEAD:
                last = self._emit(last, out, state)
                n = len(last) - 1
        return out + [last[at] for at in self._path(last, len(last) - 1)[-2::-1]]


def latin_splitter(pattern: str):
    """The pattern for texts within Latin-1, with its classes spelled out for the faster ``re``."""
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        own = "".join(f"\\x{i:02x}" for i in range(256) if regex.fullmatch(name, chr(i)))
        if name == r"\S":
            pattern = pattern.replace(name, f"[{own}]")
            continue
        # first where it stands in a class, then alone
        inside = regex.sub(r"\[[^\]]*\]", lambda m, name=name, own=own: m[0].replace(name, own), pattern)
        pattern = regex.sub(r"(\[[^\]]*\])|" + regex.escape(name), lambda m, own=own: m[1] or f"[{own}]", inside)
    return re.compile(pattern).findall


class Encoder:
    """Splits a text into pieces and remembers the tokens of those met before."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.transducer = Transducer(tokens)
        self.split_any = regex.compile(pattern).findall
        self.split_latin = latin_splitter(pattern)
        self.known: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        if len(known) > MAX_PIECES:
            known.clear()
        for piece in self.split(text) if text else ():
            ids = known.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    known[piece] = ids
            out += ids
        return out


def _utf8_moves() -> list[list[int]]:
    """State x byte of UTF-8: 0 between characters, 1-3 continuation bytes missing, 4-7 after E0, ED, F0, F4, 8 invalid."""
    moves = [[8] * 256 for _ in range(9)]
    for byte in range(256):
        if byte < 0x80:
            moves[0][byte] = 0
        elif 0xC2 <= byte <= 0xDF:
            moves[0][byte] = 1
        elif 0xE0 <= byte <= 0xEF:
            moves[0][byte] = {0xE0: 4, 0xED: 5}.get(byte, 2)
        elif 0xF0 <= byte <= 0xF4:
            moves[0][byte] = {0xF0: 6, 0xF4: 7}.get(byte, 3)
        if 0x80 <= byte <= 0xBF:
            moves[1][byte], moves[2][byte], moves[3][byte] = 0, 1, 2
            moves[4][byte] = 1 if byte >= 0xA0 else 8
            moves[5][byte] = 1 if byte < 0xA0 else 8
            moves[6][byte] = 2 if byte >= 0x90 else 8
            moves[7][byte] = 2 if byte < 0x90 else 8
    return moves


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.moves = []
        single = _utf8_moves()
        for state in range(9):
            row = bytearray(len(tokens))
            for i, token in enumerate(tokens):
                at = state
                for byte in token:
                    at = single[at][byte]
                row[i] = at
            self.moves.append(row)
        self.odd = [x != 0 for x in self.moves[0]]

    def blocks(self, ids: list[int]) -> Iterator[str]:
        """The text in blocks that end between characters.

        Most tokens are whole characters, so the automaton only reads those at the end of a block.
        """
        tokens, moves, odd = self.tokens, self.moves, self.odd
        start = 0
        while start < len(ids):
            end = at = min(len(ids), start + FLUSH_TOKENS)
            while at > start and odd[ids[at - 1]]:
                at -= 1
            state = 0
            for i in ids[at:end]:
                state = moves[state][i]
            while end < len(ids) and state and (state < 8 or odd[ids[end]]):
                state = moves[state][ids[end]]
                end += 1
            yield b"".join([tokens[i] for i in ids[start:end]]).decode("utf-8", "replace")
            start = end

    def decode(self, ids: list[int]) -> str:
        return "".join(self.blocks(ids))


def _mine(kind: type, key: str, *args):
    return kept_in_worker((kind, key), lambda: kind(*args))


def _key(tokens: list[bytes], pattern: str = "") -> str:
    return hashlib.sha256(pattern.encode() + b"\0".join(base64.b64encode(t) for t in tokens)).hexdigest()


def encode(spark: SparkSession, text: Column, tokens: list[bytes], pattern: str) -> Column:
    """Token ids of a text column; the vocabulary, whose size is fixed, is broadcast."""
    shared, key = spark.sparkContext.broadcast(tokens), _key(tokens, pattern)

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _mine(Encoder, key, shared.value, pattern)
        for texts in batches:
            yield pd.Series([np.array(encoder.encode(t), np.int32) for t in texts], dtype=object)

    # string annotations can't be read from inside a function
    encoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encoded, "array<int>")(text)


def decode(spark: SparkSession, ids: Column, tokens: list[bytes]) -> Column:
    """Text of a column of token ids."""
    shared, key = spark.sparkContext.broadcast(tokens), _key(tokens)

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = _mine(Decoder, key, shared.value)
        for rows in batches:
            yield pd.Series([decoder.decode([] if x is None else x.tolist()) for x in rows], dtype=object)

    decoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decoded, "string")(ids)


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``ids`` of the text and ``decoded``, the text of the ids, in one pass.

    Results leave a worker in small batches, whatever the size of those that come in.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(tokens), _key(tokens, pattern)
    rows = docs.select(docs[text_col].alias("_text"), *(docs[c] for c in keep))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _mine(Encoder, key, shared.value, pattern)
        decoder = _mine(Decoder, key, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                flat, offsets, texts = array("i"), [0], []
                for text in batch.column(0).to_pylist():
                    ids = encoder.encode(text)
                    texts.append(decoder.decode(ids))
                    flat.extend(ids)
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, pa.array(texts, pa.string())], [*keep, "ids", "decoded"])

    return rows.mapInArrow(run, schema)
