"""Statistics and top-N grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.levels import DISPLAY_ORDER, LEVELS

GROUP_FIELDS = ("level", "message", "source")


def level_count_map(count_of) -> Column:
    """MAP<level, count> of the non-zero levels, given ``count_of(level)``."""
    counts = F.create_map(*[item for name in LEVELS for item in (F.lit(name), count_of(name))])
    return F.map_filter(counts, lambda level, n: n > 0)


def is_error() -> Column:
    return F.col("level").isin("ERROR", "FATAL")


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when there is nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def total_lines(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total_lines"))


def level_counts(entries: DataFrame) -> DataFrame:
    """``level, count, percent``, present levels only, most severe first."""
    counts = entries.groupBy("level").agg(F.count("*").alias("count"))
    # at most six rows by now
    total = F.sum("count").over(Window.partitionBy())
    rank = F.array_position(F.array(*[F.lit(x) for x in DISPLAY_ORDER]), F.col("level"))
    return counts.select(
        "level", "count", share(F.col("count") * 100, total).alias("percent")
    ).orderBy(rank)


def time_span(entries: DataFrame) -> DataFrame:
    """``first_entry, last_entry, duration_seconds`` over the entries that have a time."""
    return entries.agg(F.min("ts").alias("first_entry"), F.max("ts").alias("last_entry")).select(
        "*",
        (
            (F.unix_micros("last_entry") - F.unix_micros("first_entry")) / F.lit(1e6)
        ).alias("duration_seconds"),
    )


def error_rate(entries: DataFrame) -> DataFrame:
    """Share of ERROR and FATAL among all entries, 0 for none."""
    return entries.agg(
        share(F.count_if(is_error()), F.count("*")).alias("error_rate")
    )


def top_messages(entries: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent messages; ties go to the smaller message."""
    return (
        entries.groupBy("message")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("message"))
        .limit(n)
    )


def compute_stats(entries: DataFrame, top_n: int = 10) -> DataFrame:
    """One row: total, level counts, first and last time, error rate, top messages.

    A rollup gives the messages and the grand total from a single pass over the
    entries; only its ``top_n + 1`` leading rows are then folded into one.
    """
    rolled = entries.rollup("message").agg(
        F.grouping_id().alias("whole"),
        F.count("*").alias("n"),
        *[F.count_if(F.col("level") == name).alias(f"n_{name}") for name in LEVELS],
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    leading = rolled.orderBy(F.desc("whole"), F.desc("n"), F.asc("message")).limit(top_n + 1)

    def of_total(column: str) -> Column:
        return F.max(F.when(F.col("whole") == 1, F.col(column)))

    def count_of_total(column: str) -> Column:
        return F.coalesce(of_total(column), F.lit(0))

    listed = F.collect_list(
        F.when(
            F.col("whole") == 0,
            F.struct((-F.col("n")).alias("rank"), F.col("message"), F.col("n").alias("count")),
        )
    )
    top = F.transform(
        F.sort_array(listed), lambda m: F.struct(m["message"].alias("message"), m["count"].alias("count"))
    )
    errors = count_of_total("n_ERROR") + count_of_total("n_FATAL")
    return leading.agg(
        count_of_total("n").alias("total_lines"),
        level_count_map(lambda name: count_of_total(f"n_{name}")).alias("level_counts"),
        of_total("first_ts").alias("first_entry"),
        of_total("last_ts").alias("last_entry"),
        share(errors, count_of_total("n")).alias("error_rate"),
        top.alias("top_messages"),
    )


def group_by(entries: DataFrame, field: str, top_n: int | None = 10) -> DataFrame:
    """``key, count, percent`` of the largest groups; percent is of all entries.

    The total comes from the same pass (a rollup row), and as the largest row it
    survives the limit, so no second scan and no window over all keys is needed.
    """
    if field not in GROUP_FIELDS:
        raise ValueError(f"unsupported group field: {field!r} (level, message or source)")
    key = F.col(field)
    if field == "source":
        key = F.when(key == "", "(unknown)").otherwise(key)
    rolled = (
        entries.select(key.alias("key"))
        .rollup("key")
        .agg(F.grouping_id().alias("whole"), F.count("*").alias("count"))
    )
    if top_n is None:
        total = entries.agg(F.count("*").alias("n")).scalar()
        rows = rolled.where("whole = 0").withColumn("_total", total)
    else:
        leading = rolled.orderBy(F.desc("whole"), F.desc("count"), F.asc("key")).limit(top_n + 1)
        # bounded by top_n + 1 rows
        whole = F.max(F.when(F.col("whole") == 1, F.col("count"))).over(Window.partitionBy())
        rows = leading.withColumn("_total", whole).where("whole = 0")
    return rows.select(
        "key", "count", (F.col("count") * 100 / F.col("_total")).alias("percent")
    ).orderBy(F.desc("count"), F.asc("key"))
