"""Tumbling time windows with gap fill, error share and change from the window before."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.levels import LEVELS
from timberline.functions.timeref import micros, parse_duration
from timberline.operators.stats import level_count_map, share
from timberline.session import materialize

# Fixed value: windows are aligned to 0001-01-01T00:00:00Z, this many days before 1970.
ALIGNMENT_DAYS = 719_162
# windows generated per task row when filling gaps
FILL_BLOCK = 4_096


def window_micros(window: str | timedelta) -> int:
    width = micros(parse_duration(window) if isinstance(window, str) else window)
    if width <= 0:
        raise ValueError("the window must be positive")
    return width


def alignment(width: int) -> int:
    """Offset of window starts from 1970 in microseconds, in [0, width)."""
    return (-ALIGNMENT_DAYS * 86_400_000_000) % width


def window_index(width: int) -> Column:
    since = F.unix_micros("ts") - F.lit(alignment(width))
    return F.call_function("div", since - F.pmod(since, F.lit(width)), F.lit(width))


def window_start(index: Column, width: int) -> Column:
    return F.timestamp_micros(index * F.lit(width) + F.lit(alignment(width)))


def is_window_error() -> Column:
    # unknown levels count as errors here, unlike in the error rate
    return F.col("level").isin("ERROR", "FATAL", "UNKNOWN")


def _window_counts(entries: DataFrame, width: int) -> DataFrame:
    return (
        entries.where(F.col("ts").isNotNull())
        .groupBy(window_index(width).alias("idx"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(is_window_error()).alias("errors"),
            *[F.count_if(F.col("level") == name).alias(f"n_{name}") for name in LEVELS],
        )
    )


def time_windows(entries: DataFrame, window: str | timedelta) -> DataFrame:
    """``start, end, count, level_counts, error_count, error_percent, change_percent``.

    From the window of the earliest entry to that of the latest, empty ones included;
    entries without a time are left out.

    The log is scanned once, into one row per non-empty window. Each of these then
    contributes its counts to its own window and its total to the next one, so the
    previous window is found by a hash aggregate and not by sorting all windows in
    one task.
    """
    width = window_micros(window)
    counts = materialize(_window_counts(entries, width), "windows")
    levels = [f"n_{name}" for name in LEVELS]
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("n", "errors", *levels)]

    bounds = counts.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    block = F.lit(FILL_BLOCK)
    first, last = F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)
    blocks = (
        bounds.where("lo is not null")
        .select("lo", "hi", F.explode(F.sequence(first, last)).alias("block"))
        .repartition("block")
    )
    grid = blocks.select(
        F.explode(
            F.sequence(
                F.greatest("lo", F.col("block") * block),
                F.least("hi", F.col("block") * block + FILL_BLOCK - 1),
            )
        ).alias("idx"),
        *zeros,
        F.lit(0).cast("bigint").alias("previous"),
        F.lit(True).alias("wanted"),
    )
    own = counts.withColumn("previous", F.lit(0).cast("bigint")).withColumn("wanted", F.lit(False))
    to_next = counts.select(
        (F.col("idx") + 1).alias("idx"),
        *zeros,
        F.col("n").alias("previous"),
        F.lit(False).alias("wanted"),
    )
    merged = (
        grid.unionByName(own)
        .unionByName(to_next)
        .groupBy("idx")
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "errors", *levels, "previous")],
            F.max("wanted").alias("wanted"),
        )
        .where("wanted")
    )
    n, previous = F.col("n"), F.col("previous")
    return merged.select(
        window_start(F.col("idx"), width).alias("start"),
        window_start(F.col("idx") + 1, width).alias("end"),
        n.alias("count"),
        level_count_map(lambda name: F.col(f"n_{name}")).alias("level_counts"),
        F.col("errors").alias("error_count"),
        share(F.col("errors") * 100, n).alias("error_percent"),
        share((n - previous) * 100, previous).alias("change_percent"),
    ).orderBy("start")


def window_levels(entries: DataFrame, window: str | timedelta) -> DataFrame:
    """Level counts per window in long form: ``start, level, count`` (no empty rows)."""
    width = window_micros(window)
    return (
        entries.where(F.col("ts").isNotNull())
        .groupBy(window_index(width).alias("idx"), "level")
        .agg(F.count("*").alias("count"))
        .select(window_start(F.col("idx"), width).alias("start"), "level", "count")
    )
