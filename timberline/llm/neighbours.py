"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of ``TERMS`` hashed terms: its words, trigrams of its run-length squeezed character
classes (what kind of characters follow each other), and classes of its share of repeated word
triples and of symbols. Counts are dampened and weighted by how rare the term is among all documents;
the largest singular vectors of the labelled rows' matrix span the latent space.

The latent vectors of the labelled rows are broadcast, and each document is compared with every one
of them: blocks of documents times blocks of labelled vectors are matrix products, after each of which
the best ``NEIGHBOURS`` are kept, so the search is exact and holds one block of products at a time.
The neighbours' labels are weighted by a power of the cosine, and by how many labelled rows a sampled
one of its class stands for.

The space and the voters are fitted on at most ``max_labelled`` rows of either class, those with the
smallest hash of their id, so what passes through the driver and is broadcast is bounded by
parameters: ``2 * max_labelled`` rows of ``TERMS`` numbers, and ``DIMENSIONS`` numbers for a voter.
Term frequencies are counted over all documents. Rows with crc32(doc_id) mod 4 = 2 are never learned from.

Defined cases: a null or empty text, or one without a term that the voters know, has the share of
label 1 as score (0.5 without labels); labels that are null or belong to no document are not used,
and of several labels for an id the largest counts; rows that share an id are all learned from and
scored each on its own; with labels of one class only every score is that class. Equally near
neighbours are taken in the order of the voters. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.toxicity import sample_labels
from timberline.session import materialize

MAX_LABELLED = 3000
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 4
# documents and voters whose products are formed at a time
BLOCK, VOTER_BLOCK = 256, 2048
# rounds of subspace iteration
ROUNDS = 4

_SHAPES, _WORDS, _LEVELS = 2048, 2032, 8
TERMS = _SHAPES + _WORDS + 2 * _LEVELS
_REPEATS, _SYMBOLS = TERMS - 2 * _LEVELS, TERMS - _LEVELS
_LOWER, _UPPER, _DIGIT, _LINE, _SPACE, _CONTROL = range(1, 7)


def _classes() -> np.ndarray:
    """Class of each byte; symbols are classes of their own, all beyond ASCII are taken for lower case."""
    out, symbols = np.full(256, _LOWER, np.int64), _CONTROL
    for b in range(128):
        c = chr(b)
        if c.isupper():
            out[b] = _UPPER
        elif c.isdigit():
            out[b] = _DIGIT
        elif c == "\n":
            out[b] = _LINE
        elif c.isspace():
            out[b] = _SPACE
        elif b < 32 or b == 127:
            out[b] = _CONTROL
        elif not c.islower():
            symbols += 1
            out[b] = symbols
    return out


_CLASS = _classes()
_MIX = 2654435761
_KEPT_WORDS = 1 << 20


class _WordHashes(dict):
    """Hash of a word, remembered by the worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = found = crc32(word)
        return found


_WORD_HASHES = _WordHashes()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text and how often each occurs."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    squeezed = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
    shapes = (((squeezed[:-2] * 64 + squeezed[1:-1]) * 64 + squeezed[2:]) * _MIX & 0xFFFFFFFF) >> 16
    words = data.lower().split()
    hashes = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.int64, len(words))
    counts = np.bincount(shapes % _SHAPES, minlength=TERMS)
    counts[_SHAPES : _SHAPES + _WORDS] = np.bincount(hashes % _WORDS, minlength=_WORDS)
    # the two descriptions weigh as much as a quarter of the words
    level = np.array([_repeated(hashes), np.count_nonzero(kinds > _CONTROL) / len(kinds) * 2])
    at = np.array([_REPEATS, _SYMBOLS]) + np.minimum(level * _LEVELS, _LEVELS - 1).astype(np.int64)
    counts[at] = max(1, len(words) // 4)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _repeated(words: np.ndarray) -> float:
    """Share of the word triples that occurred before."""
    if len(words) < 3:
        return 0.0
    triples = np.sort((words[:-2] * 0x9E3779B1 + words[1:-1]) * 0x85EBCA77 + words[2:])
    return float(np.count_nonzero(triples[1:] == triples[:-1]) / len(triples))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each term occurs, and how many texts have terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found, _ = terms(text.as_py())
                total[found] += 1
                total[TERMS] += len(found) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    sums = texts.mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out[:TERMS], int(out[TERMS])


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    rarity: np.ndarray  # of every term
    axes: np.ndarray  # term x dimension
    voters: np.ndarray  # labelled rows x dimension, of length 1
    labels: np.ndarray  # of the voters
    weights: np.ndarray  # labelled rows that a voter stands for
    share: float  # of label 1

    def latent(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for i, text in enumerate(texts):
            found, n = terms(text)
            if len(found):
                out[i] = (np.log1p(n) * self.rarity[found]).astype(np.float32) @ self.axes[found]
        return _normal(out)

    def scores(self, texts) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by similarity."""
        out = np.full(len(texts), self.share)
        if not len(self.voters):
            return out
        for start in range(0, len(texts), BLOCK):
            own = self.latent(texts[start : start + BLOCK])
            near = np.zeros((len(own), 0), np.float32)
            who = np.zeros((len(own), 0), np.int64)
            for at in range(0, len(self.voters), VOTER_BLOCK):
                part = own @ self.voters[at : at + VOTER_BLOCK].T
                near = np.hstack([near, part])
                who = np.hstack([who, np.broadcast_to(np.arange(at, at + part.shape[1]), part.shape)])
                # (stable, so that ties go to the earlier voter)
                best = np.argsort(-near, axis=1, kind="stable")[:, :NEIGHBOURS]
                near, who = np.take_along_axis(near, best, 1), np.take_along_axis(who, best, 1)
            votes = np.clip(near, 0, None).astype(np.float64) ** SHARPNESS * self.weights[who]
            total = votes.sum(axis=1)
            some = total > 0
            out[start : start + BLOCK][some] = (votes * self.labels[who]).sum(axis=1)[some] / total[some]
        return out


def _axes(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    wide = min(dimensions + 8, *matrix.shape)
    base = np.random.default_rng(0).standard_normal((matrix.shape[1], wide)).astype(np.float32)
    for _ in range(ROUNDS):
        base = np.linalg.qr(matrix.T @ (matrix @ base))[0]
    _, _, right = np.linalg.svd(matrix @ base, full_matrices=False)
    return (base @ right[:dimensions].T).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS,
) -> Model:
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    n_docs, documents = document_frequencies(own.select("text"))
    rarity = 1 + np.log((documents + 1) / (n_docs + 1))
    picked, totals = sample_labels(labels, id_col, label_col, max_labelled)
    share = totals[1] / sum(totals.values()) if sum(totals.values()) else 0.5
    none = Model(rarity, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), np.zeros(0), np.zeros(0), share)
    if not picked:
        return none
    chosen = spark.createDataFrame(list(picked.items()), f"_id {labels.schema[id_col].dataType.simpleString()}, label int")
    # at most 2 * max_labelled ids
    labelled = own.join(F.broadcast(chosen), own["id"] == chosen["_id"]).select("id", "label", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(text.as_py()) for text in batch.column(2)]
            columns = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "label", "terms", "counts"])

    id_type = own.schema["id"].dataType.simpleString()
    vectors = materialize(labelled.mapInArrow(sparse, f"id {id_type}, label int, terms array<int>, counts array<int>"), "labelled")
    # an id that many rows share is sampled as well
    rows = vectors.orderBy(F.xxhash64("id"), "id", F.xxhash64("terms", "counts")).limit(2 * max_labelled).toArrow()
    matrix = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (found, n) in enumerate(zip(rows["terms"], rows["counts"], strict=True)):
        found, n = found.values.to_numpy(), n.values.to_numpy()
        matrix[i, found] = np.log1p(n) * rarity[found]
    y = rows["label"].to_numpy().astype(np.int64)
    some = np.linalg.norm(matrix, axis=1) > 0
    matrix, y = _normal(matrix[some]), y[some]
    if not len(y):
        return none
    axes = _axes(matrix, dimensions)
    stands_for = np.array([totals[c] / max(1, int((y == c).sum())) for c in (0, 1)])
    return Model(rarity, axes, _normal(matrix @ axes), y, stands_for[y], share)


def scores(model: Model, text: Column, docs: DataFrame) -> Column:
    """The score of a text column; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, "double")(text)
