"""Redaction of entries and of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import redaction as rd


def redact_column(
    df: DataFrame, column: str, names: Sequence[str] | None = None, **options
) -> DataFrame:
    """Replace sensitive values in a text column; adds ``redacted_count``."""
    done = df.withColumn("_redacted", rd.redact_and_count(F.col(column), names, **options))
    return done.withColumn(column, F.col("_redacted.text")).select(
        *df.columns, F.col("_redacted.count").alias("redacted_count")
    )


def redact_entries(
    entries: DataFrame,
    names: Sequence[str] | None = None,
    enabled: bool = True,
    redact_fields: bool = False,
    compat: bool = False,
    **options,
) -> DataFrame:
    """Redact ``message`` and ``raw``; adds ``redacted_count``.

    A value in both counts twice, unless ``raw`` is just the message. ``redact_fields`` also
    treats field values and the source (not counted). ``compat`` leaves a ``raw`` that equals
    the message as it is, secrets included.
    """
    if not enabled:
        return entries.withColumn("redacted_count", F.lit(0).cast("bigint"))
    message, raw = F.col("message"), F.col("raw")
    columns = entries.columns
    done = entries.withColumn("_message", rd.redact_and_count(message, names, **options))
    count = F.col("_message.count")
    changed = {"message": F.col("_message.text")}
    if "raw" in columns:
        done = done.withColumn(
            "_raw", F.when(raw != message, rd.redact_and_count(raw, names, **options))
        )
        count = count + F.coalesce(F.col("_raw.count"), F.lit(0))
        same = raw if compat else F.col("_message.text")
        changed["raw"] = F.coalesce(F.col("_raw.text"), F.when(raw == message, same).otherwise(raw))
    if redact_fields:
        if "fields" in columns:
            changed["fields"] = F.transform_values(
                "fields", lambda k, v: rd.redact(v, names, **options)
            )
        if "source" in columns:
            changed["source"] = rd.redact(F.col("source"), names, **options)
    return done.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in columns],
        count.alias("redacted_count"),
    )


def redacted_values(
    df: DataFrame,
    columns: Sequence[str] = ("message", "raw"),
    names: Sequence[str] | None = None,
    by: Sequence[str] = (),
    hash_len: int = 4,
    normalize: bool = False,
) -> DataFrame:
    """Distinct replaced values: ``*by, value, type, placeholder``. The output is sensitive."""
    found = F.flatten(
        F.array(
            *[
                rd.redact_and_count(F.col(c), names, hash_len, normalize, keep_found=True)["found"]
                for c in columns
            ]
        )
    )
    values = (
        df.select(*by, F.explode(found).alias("v"))
        .groupBy(*by, F.col("v.value").alias("value"))
        # one value, one placeholder: that of the first pattern that takes it
        .agg(F.min("v.nth").alias("nth"))
    )
    type_of = F.element_at(
        F.array(*[F.lit(p.type) for p in rd.select_patterns(names)]), F.col("nth") + 1
    )
    mark = None
    for pattern in rd.select_patterns(names):
        made = rd.placeholder(F.col("value"), pattern.type, hash_len, normalize)
        mark = (F if mark is None else mark).when(F.col("type") == pattern.type, made)
    return values.withColumn("type", type_of).select(
        *by, "value", "type", mark.alias("placeholder")
    )


def redacted_type_counts(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unique redacted values per type, from ``redacted_values``."""
    return values.groupBy(*by, "type").agg(F.count("*").alias("count"))
