"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are compared word by word. Each is interpolated
Kneser-Ney: discounted counts of the class's bigrams, then of its words, and last the counts of the
words in the whole corpus. Both class levels count contexts, that is after how many different words
a bigram or word was seen, so that copies of a text count once. The corpus counts are shared by both
classes, so that an expression which is rare in both says nothing for either. Every word of the counted
rows has its own count of the corpus; one that no counted row has gets the same lowest factor in both
classes, which the difference takes out, so these words share one place.

Two length-normalised differences of the log-likelihoods describe a text: the mean over all its
words, and the largest mean over ``WINDOW`` neighbouring words, which finds a few words in a long
text. A logistic curve, fitted on labelled rows that the counts have not seen, turns them into the
score.

The classifier is fitted on at most ``max_labelled`` rows of either class, those with the smallest
hash of their id; the corpus counts cover all documents. What is broadcast is bounded by that
sample, not by the corpus. Rows with crc32(doc_id) mod 4 = ``HELD_OUT`` are never learned from,
those with ``CALIBRATION`` fit the curve, the others are counted.

Defined cases: a null, empty or wordless text has differences of 0; labels that are null or belong
to no document are not used, and of several labels for an id the largest counts; documents that
share an id are all learned from; with labels of one class only, or none, every score is that
class's share (0.5 without labels). Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import free_worker
from timberline.session import materialize

MAX_LABELLED = 8000
HELD_OUT, CALIBRATION = 2, 3
# Taken from every count: above the usual 0.75, as the classes differ much in size and a few counts in
# the smaller one would otherwise weigh as much as many.
DISCOUNT = 3.0
WINDOW = 3
UNKNOWN = 0
# What a task holds at a time: words, and characters of texts.
MAX_HELD = 1 << 17
MAX_CHARS = 1 << 20

_words = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


@dataclass
class Model:
    vocabulary: dict[str, int]
    keys: np.ndarray  # sorted: earlier word * size + word
    discounted: np.ndarray  # class x key: probability left to the bigram
    backoff: np.ndarray  # class x word: weight of the lower level after it
    lower: np.ndarray  # class x word: interpolated probability without context
    weights: np.ndarray  # of 1, largest window and mean

    def ids(self, text: str | None) -> list[int]:
        get = self.vocabulary.get
        return [get(w, UNKNOWN) for w in words(text)]

    def differences(self, texts) -> np.ndarray:
        """Largest mean of a window and overall mean of log toxic - log ordinary, a row for each text."""
        rows = [self.ids(t) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(sizes)
        ids = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        before = np.roll(ids, 1)
        before[(ends - sizes)[sizes > 0]] = UNKNOWN
        keys = before * (len(self.vocabulary) + 1) + ids
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        logs = []
        for c in (0, 1):
            own = np.where(hit, self.discounted[c][at], 0) if len(self.keys) else 0
            logs.append(np.log(own + self.backoff[c][before] * self.lower[c][ids]))
        sums = np.concatenate([[0.0], np.cumsum(logs[1] - logs[0])])
        out = np.zeros((len(rows), 2))
        for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            if n:
                own = sums[end - n : end + 1]
                w = min(n, WINDOW)
                out[k] = (own[w:] - own[: n + 1 - w]).max() / WINDOW, (own[-1] - own[0]) / n
        return out

    def scores(self, differences: np.ndarray) -> np.ndarray:
        z = self.weights[0] + differences @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> tuple[dict, dict[int, int]]:
    """Id -> class of the rows to learn from, and how many labelled rows either class has."""
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    total = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = {}
    for label in (0, 1):
        rows = own.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()
        picked.update({r.id: label for r in rows})
    return picked, {label: total.get(label, 0) for label in (0, 1)}


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    free_worker()
    found: set[str] = set()
    for batch in batches:
        for text in batch["text"]:
            found.update(words(text))
            if len(found) > MAX_HELD:
                yield pd.DataFrame({"word": list(found)})
                found.clear()
    yield pd.DataFrame({"word": list(found)}, dtype=object)


def _slices(texts: pd.Series) -> Iterator[pd.Series]:
    """Texts of a bounded number of characters at a time, one text at least."""
    sizes = texts.str.len().fillna(0).cumsum() // MAX_CHARS
    for _, part in texts.groupby(sizes.to_numpy()):
        yield part


def _bigrams(vocabulary):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        get, size = vocabulary.value.get, len(vocabulary.value) + 1
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                ids = np.array([UNKNOWN, UNKNOWN, *(get(w, UNKNOWN) for w in words(text))], np.int64)
                seen = np.unique(np.column_stack([ids[:-2], ids[1:-1] * size + ids[2:]]), axis=0)
                yield pd.DataFrame({"before": seen[:, 0], "key": seen[:, 1], "label": label})

    return found


def _unigrams(vocabulary):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        get, size = vocabulary.value.get, len(vocabulary.value) + 1
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch["text"]:
                ids, n = np.unique(np.array([get(w, UNKNOWN) for w in words(text)], np.int64), return_counts=True)
                total[ids] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"word": at, "n": total[at]})

    return counted


def _frame(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    table = df.select(*columns).toArrow()
    return {c: table[c].to_numpy() for c in columns}


def _lower(n1: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Discounted continuation counts, interpolated with the level below."""
    total = n1.sum()
    if not total:
        return below
    return (np.maximum(n1 - DISCOUNT, 0) + np.minimum(n1, DISCOUNT).sum() * below) / total


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of 1 and the columns of x by Newton steps, lightly held to 0."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.05 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    spark = docs.sparkSession
    picked, totals = sample_labels(labels, id_col, label_col, max_labelled)
    prior = totals[1] / max(1, totals[0] + totals[1]) if sum(totals.values()) else 0.5
    flat = Model({}, np.zeros(0, np.int64), np.zeros((2, 0)), np.ones((2, 1)), np.ones((2, 1)), np.array([0.0, 0, 0]))
    flat.weights[0] = np.log(np.clip(prior, 1e-9, 1 - 1e-9) / (1 - np.clip(prior, 1e-9, 1 - 1e-9)))
    if not all(totals.values()):
        return flat
    id_type = labels.schema[id_col].dataType.simpleString()
    chosen = spark.createDataFrame(list(picked.items()), f"_id {id_type}, label int")
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    # at most 2 * max_labelled rows
    labelled = own.join(F.broadcast(chosen), own["id"] == chosen["_id"])
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    counted = labelled.where(fold != CALIBRATION).select("label", "text")
    vocabulary = counted.select("text").mapInPandas(_distinct, "word string").distinct()
    known = {w: i for i, w in enumerate(sorted(vocabulary.toArrow()["word"].to_pylist()), 1)}
    size = len(known) + 1
    shared = spark.sparkContext.broadcast(known)
    # every document counts here, labelled or not
    corpus = (
        own.select("text").mapInPandas(_unigrams(shared), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    )
    base = np.ones(size)
    seen = _frame(corpus, ["word", "n"])
    base[seen["word"]] += seen["n"]
    pairs = materialize(
        counted.mapInPandas(_bigrams(shared), "before bigint, key bigint, label int").distinct().groupBy("key").agg(
            F.count(F.when(F.col("label") == 0, 1)).alias("n0"), F.count(F.when(F.col("label") == 1, 1)).alias("n1")
        ),
        "bigrams",
    )
    some = [F.count(F.when(F.col(c) > 0, 1)).alias(f"k{i}") for i, c in enumerate(("n0", "n1"))]
    ends = _frame(pairs.groupBy((F.col("key") % size).alias("w")).agg(*some), ["w", "k0", "k1"])
    starts = _frame(
        pairs.groupBy(F.floor(F.col("key") / size).alias("w")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), ["w", "n0", "n1"]
    )
    kept = _frame(pairs.where(F.greatest("n0", "n1") > DISCOUNT).orderBy("key"), ["key", "n0", "n1"])

    def dense(found: dict, column: str) -> np.ndarray:
        out = np.zeros(size)
        out[found["w"]] = found[column]
        return out

    contexts = [dense(ends, f"k{c}") for c in (0, 1)]
    for x in contexts:
        x[UNKNOWN] = 0  # words outside the vocabulary say nothing
    lower = np.array([_lower(x, base / base.sum()) for x in contexts])
    total = np.array([dense(starts, f"n{c}") for c in (0, 1)])
    left = kept["key"] // size
    discounted = np.array([np.maximum(kept[f"n{c}"] - DISCOUNT, 0) / np.maximum(total[c][left], 1) for c in (0, 1)])
    backoff = np.array([1 - np.bincount(left, discounted[c], size) for c in (0, 1)])
    model = Model(known, kept["key"], discounted, np.maximum(backoff, 1e-6), lower, np.zeros(3))
    # the curve: on labelled rows that were not counted
    features = labelled.where(fold == CALIBRATION).select("label", differences(model, F.col("text"), docs).alias("d"))
    rows = _frame(features.select("label", F.col("d.window").alias("window"), F.col("d.mean").alias("mean")), ["label", "window", "mean"])
    y = rows["label"].astype(float)
    if 0 < y.sum() < len(y):
        # as many toxic and ordinary rows as the labels have, not as the sample has
        share = {c: totals[c] / max(1, sum(v == c for v in picked.values())) for c in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        model.weights = _logistic(np.column_stack([rows["window"], rows["mean"]]), y, weight)
    else:
        model.weights = np.array([flat.weights[0], 10.0, 0.0])
    return model


def differences(model: Model, text: Column, docs: DataFrame) -> Column:
    """Struct column with the score and the two differences it follows from; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        free_worker()
        own = shared.value
        for texts in batches:
            found = np.concatenate([np.zeros((0, 2)), *(own.differences(part) for part in _slices(texts))])
            yield pd.DataFrame({"score": own.scores(found), "window": found[:, 0], "mean": found[:, 1]})

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scored, "score double, window double, mean double")(text)
