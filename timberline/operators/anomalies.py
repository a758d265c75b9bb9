"""Patterns whose rate departs from what it was in the windows before.

The log is reduced to one count per pattern and non-empty window. Each count is then handed to the ``history``
windows after it, so a window's baseline is a hash aggregate of at most ``history`` numbers and no task sorts a
pattern's whole history, let alone all patterns.

The baseline is robust: the median of the last ``history`` windows and the median distance from it. Windows without a
line of the pattern count as 0, back to the first window of the log. A window is judged if at least
``MIN_HISTORY`` came before it.

Defined cases: entries without a time or without tokens are left out; a pattern that stops is judged as long as
its last line is within ``history`` windows; an empty log has no anomalies.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import tokens as tk
from timberline.operators.windows import window_index, window_micros, window_start
from timberline.session import materialize

HISTORY = 24
MIN_HISTORY = 6
# the median distance of normal values times this is their standard deviation
NORMAL = 1.4826
# scores from which on an anomaly is of a severity
SEVERITIES = (("CRITICAL", 13.0), ("HIGH", 8.0), ("MEDIUM", 5.0), ("LOW", 3.0))


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(sorted_values, low) + F.get(sorted_values, high)) / 2


def severity(score: Column) -> Column:
    out = None
    for name, least in SEVERITIES:
        out = (F if out is None else out).when(F.abs(score) >= least, name)
    return out


def rate_scores(entries: DataFrame, window: str | timedelta, history: int = HISTORY, key: Column | None = None) -> DataFrame:
    """``pattern, start, end, count, median, spread, score`` for every window of a pattern that has a baseline.

    ``key`` names what is counted; without it, messages with their variable tokens masked.
    """
    if history < MIN_HISTORY:
        raise ValueError(f"the history must have at least {MIN_HISTORY} windows")
    width = window_micros(window)
    pattern = tk.mask_message(F.col("message")) if key is None else key
    rows = entries.where(F.col("ts").isNotNull()).select(pattern.alias("pattern"), window_index(width).alias("idx"))
    counts = materialize(rows.where("pattern <> ''").groupBy("pattern", "idx").agg(F.count("*").alias("n")), "rates")
    bounds = counts.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    lo, hi = (F.lit(bounds[c]).cast("bigint") for c in ("lo", "hi"))
    reach = F.sequence(F.col("idx"), F.least(F.col("idx") + history, hi))
    spread_out = counts.select("pattern", "n", F.col("idx").alias("of"), F.explode(reach).alias("idx"))
    own, past = F.col("idx") == F.col("of"), F.when(F.col("idx") > F.col("of"), F.col("n"))
    judged = (
        spread_out.groupBy("pattern", "idx")
        .agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("count"), F.collect_list(past).alias("past"))
        .withColumn("known", F.least(F.col("idx") - lo, F.lit(history)).cast("int"))
        .where(F.col("known") >= MIN_HISTORY)
    )
    none = F.array_repeat(F.lit(0).cast("bigint"), F.col("known") - F.size("past"))
    judged = judged.withColumn("past", F.sort_array(F.concat(none, "past"))).withColumn("median", _median(F.col("past")))
    apart = F.sort_array(F.transform("past", lambda x: F.abs(x - F.col("median"))))
    judged = judged.withColumn("spread", F.greatest(_median(apart) * NORMAL, F.sqrt("median"), F.lit(1.0)))
    return judged.select(
        "pattern", window_start(F.col("idx"), width).alias("start"), window_start(F.col("idx") + 1, width).alias("end"),
        "count", "median", "spread", ((F.col("count") - F.col("median")) / F.col("spread")).alias("score"),
    )


def rate_anomalies(entries: DataFrame, window: str | timedelta, history: int = HISTORY, key: Column | None = None) -> DataFrame:
    """The scores beyond the least severity, with ``direction`` (spike or drop) and ``severity``."""
    scores = rate_scores(entries, window, history, key).withColumn("severity", severity(F.col("score")))
    direction = F.when(F.col("score") > 0, "spike").otherwise("drop")
    return scores.where(F.col("severity").isNotNull()).withColumn("direction", direction)
