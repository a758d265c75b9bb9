"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z only) words of ASCII letters, digits and everything
beyond ASCII. Every window of ``window`` consecutive words of an item is a pattern of the
automaton; an item with fewer words is one pattern. A text is scanned once, as bytes, with its
words set apart by single spaces, so that a pattern can only match whole words. Hits are mapped
back to words and to code points of the original text.

Defined cases: a null or wordless text has no words, no hits and no items; a null or wordless
item is never found; items that share an id count as one item, and one without an id is listed
as an empty string; repeated rows are scanned each on their own. The columns of the documents
do not matter, as only the text column is read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import free_worker

WINDOW = 10
# Text of the items that one automaton holds; more items take more automata, one after the other.
# An automaton needs about 400 times as many bytes in each Python worker at most.
BLOCK_BYTES = 256 << 10

_WORD_BYTE = re.compile(rb"[a-z0-9\x80-\xff]")
_TO_SPACE = bytes(b if _WORD_BYTE.match(bytes([b])) else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = (
    "n_words bigint, n_hit bigint, word_ranges array<bigint>, items array<string>, "
    "spans array<struct<start: bigint, end: bigint>>"
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


def patterns(items: list[tuple[str, str]], window: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Padded window -> (its words, the items that have it)."""
    found = defaultdict(set)
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            found[b" ".join([b"", *own[i : i + window], b""])].add(item)
    return {k.decode("latin-1"): (k.count(b" ") - 1, tuple(sorted(v))) for k, v in found.items()}


def automaton(found: dict[str, tuple[int, tuple[str, ...]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, (n, items) in found.items():
        made.add_word(key, (len(key), n, items))
    if found:
        made.make_automaton()
    return made


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Ranges of words as a flat list start, end, start, end, ..., touching ones joined."""
    order = np.argsort(starts, kind="stable")
    out: list[int] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def scan(made, text: str | None, ranges: list[int], items: list[str]) -> tuple[int, list[int], list[str]]:
    """Number of words, hit ranges and items of one text, joined with those already known."""
    own = words(text)
    if not own or not len(made):
        return len(own), ranges, items
    line = b" ".join([b"", *own, b""])
    starts, ends, seen, spaces = [], [], set(items), None
    for end, (size, n, names) in made.iter(line.decode("latin-1")):
        starts.append(end - size + 1)
        ends.append(n)
        seen.update(names)
    if not starts:
        return len(own), ranges, items
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.searchsorted(spaces, np.array(starts))
    old = np.array(ranges, np.int64).reshape(-1, 2)
    return (
        len(own),
        _merged(np.concatenate([old[:, 0], first]), np.concatenate([old[:, 1], first + np.array(ends)])),
        sorted(seen),
    )


def _spans(text: str, ranges: list[int]) -> list[dict]:
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[s][0], "end": at[e - 1][1]} for s, e in zip(ranges[::2], ranges[1::2], strict=True)]


def _scanner(spark: SparkSession, block: dict, last: bool):
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(SCHEMA)
    def scanned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        free_worker()
        made = automaton(shared.value)
        for texts, ranges, items in batches:
            rows = []
            for text, known, names in zip(texts, ranges, items, strict=True):
                n, hit, seen = scan(made, text, [int(x) for x in known], list(names))
                spans = _spans(text, hit) if last and hit else []
                rows.append((n, sum(hit[1::2]) - sum(hit[::2]), hit, seen, spans))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "word_ranges", "items", "spans"])

    return scanned


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items on the driver, at most about ``block_bytes`` of text at a time, by hash of id and text."""
    rows = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("i"), items[text_col].alias("t"))
    rows = rows.where(F.col("t").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-size // block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [tuple(r) for r in part.distinct().collect()]


def contamination(
    items: DataFrame, text: Column, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> Column:
    """Struct column with what the items leave in ``text``: words, hit words, their ranges, items, spans.

    The automaton is broadcast; ``block_bytes`` bounds it, and further items are scanned for by
    further automata whose hits are joined with the earlier ones.
    """
    spark = items.sparkSession
    blocks = [patterns(b, window) for b in item_blocks(items, id_col, text_col, block_bytes)] or [{}]
    ranges, names = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    out = None
    for k, block in enumerate(blocks):
        out = _scanner(spark, block, k == len(blocks) - 1)(text, ranges, names)
        ranges, names = out["word_ranges"], out["items"]
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    hit = contamination(items, docs[text_col], **options)
    return docs.where(hit["n_hit"] == 0)
