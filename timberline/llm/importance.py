"""Target-distribution importance resampling.

Documents are drawn without replacement with probabilities that grow with how much likelier their
n-grams are in a target corpus than in the documents themselves: the n-grams' hash buckets give
every document a log weight, Gumbel noise from a hash of its id is added, and the highest scores are
drawn.

* Both corpora are counted by bucket in one pass each; a task sends its array of counts, so what the
  driver gets is ``BUCKETS`` numbers a corpus, whatever their size. The log ratios of all buckets are
  one array, and a document's weight is the mean over its n-grams, read from it.
* The cutoff is bracketed by a quantile sketch of the scores. How many rows lie above and inside
  the bracket is counted exactly; a bracket that misses the cutoff is widened, four times at each try,
  until it holds it. Only its rows are sorted, by a range-partitioned sort, to find the last one drawn.
* The drawn rows are ranked by a range-partitioned sort whose parts are numbered by their sizes.

Defined cases: a null or wordless text has no n-grams and weight 0; a null id has the noise of an
empty id and comes after all others among equal scores; rows that share an id and a score are
ordered by weight, then number of features, then where they were read, each row being drawn on its
own; an empty target gives every bucket one count; an empty table gives an empty result. Only the
named columns are read, whatever others there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import materialize

BUCKETS = 10_000
NGRAM = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# relative error of the quantile sketch is one in this many
SKETCH = 10_000
# what a worker keeps of hashed n-grams
MAX_CACHED = 1 << 20

# fixed values: letters and digits of ASCII and everything beyond it are parts of words
_AS_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_AS_WORDS).split() if text else []


class _Buckets(dict):
    """Bucket of an n-gram, remembered."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, ngram: bytes) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        self[ngram] = found = crc32(ngram) % self.size
        return found


def _features(text: str | None, ngram: int, buckets: _Buckets) -> tuple[int, Iterator[int]]:
    """The number of words, and the buckets of all runs of one to ``ngram`` words."""
    own = words(text)
    runs = [own] + [map(b" ".join, zip(*(own[i:] for i in range(n)), strict=False)) for n in range(2, ngram + 1)]
    return len(own), (buckets[run] for of_size in runs for run in of_size)


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, size: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = _Buckets(size), np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = np.fromiter(_features(text.as_py(), ngram, buckets)[1], np.int64)
                total += np.bincount(found, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select(texts[text_col].alias("text")).mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, floored."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log((float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size))))

    return np.array([gain(s, t) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """``id, n_words, n_features, weight`` of every document."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        buckets = _Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1):
                n, found = _features(text.as_py(), ngram, buckets)
                at = np.fromiter(found, np.int64)
                n_words.append(n)
                n_features.append(len(at))
                weights.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            rest = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], ["id", "n_words", "n_features", "weight"])

    id_type = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(scored, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the seed and the id, floored."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("row")]


def _ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank`` from 1 in the order of drawing."""
    order = _order()
    parts = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_id", 33))
    # one row for each part of the sort
    runs = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_shift"))
    return parts.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def cutoff(rows: DataFrame, drawn: int, total: int, sketch: int = SKETCH) -> dict | None:
    """The last of the ``drawn`` first of ``total`` rows by score; None if none or all are drawn."""
    if not 0 < drawn < total:
        return None
    width = 1 / sketch
    at = 1 - drawn / total
    while True:
        lo, hi = max(0.0, at - width), min(1.0, at + width)
        ends = rows.agg(F.percentile_approx("score", F.array(F.lit(lo), F.lit(hi)), sketch).alias("ends"), F.min("score").alias("min"), F.max("score").alias("max")).first()
        low = ends["min"] if lo == 0 else ends["ends"][0]
        high = ends["max"] if hi == 1 else ends["ends"][1]
        outside = rows.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if outside["above"] < drawn <= outside["reached"]:
            break
        width *= 4
    inside = _ranked(rows.where(F.col("score").between(low, high)))
    return inside.where(F.col("rank") == drawn - outside["above"]).first().asDict()


def _up_to(last: dict) -> Column:
    """Whether a row is drawn no later than ``last``."""
    id_ = F.col("id")
    if last["id"] is None:
        before, same = id_.isNotNull(), id_.isNull()
    else:
        before, same = F.coalesce(id_ < last["id"], F.lit(False)), id_.eqNullSafe(F.lit(last["id"]))
    later = F.col("row") <= last["row"]
    for name in ("n_features", "weight"):
        later = (F.col(name) < last[name]) | ((F.col(name) == last[name]) & later)
    return (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (before | (same & later)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM,
    buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, sketch: int = SKETCH,
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every document; rank is null for those not drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))
    scored = weighted(docs, gain, id_col, text_col, ngram).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = rows.where(F.col("n_words") >= min_words)
    total = fit.count()
    drawn = percent * total // 100
    last = cutoff(fit, drawn, total, sketch)
    taken = F.lit(drawn > 0) if last is None else _up_to(last)
    taken = (F.col("n_words") >= min_words) & taken
    out = _ranked(rows.where(taken)).unionByName(rows.where(~taken).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
