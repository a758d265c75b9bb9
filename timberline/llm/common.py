"""What several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.session import materialize

SALTS = 16
# rows of a key from which on they are dealt
BUSY = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def split_words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def squeezed(text: Column) -> Column:
    """``text`` with its words set apart by single spaces."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _sent_whole(side: DataFrame) -> bool:
    """Whether Spark sends ``side`` to every task as it is, by the size it takes it for."""
    most = side.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def salted_join(
    rows: DataFrame, side: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``rows``, of which one key may hold a great part, with a ``side`` of few rows a key.

    The rows of a key are dealt over ``salts`` parts by the hash of ``by``; the side goes to each part. A side that Spark
    sends to every task needs no parts. Copies are never sent that way, as Spark takes a table for no larger after an
    explode, and all copies would be in the driver's memory.
    """
    if _sent_whole(side):
        return rows.join(side, on, how)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return rows.join(side.hint("merge"), [*on, "_salt"], how).drop("_salt")


def busy_parts(rows: DataFrame, on: list[str], salts: int = SALTS, busy: int = BUSY) -> DataFrame:
    """(on, _parts) of the keys of more than ``busy`` rows: over how many parts these are dealt."""
    parts = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > busy).select(*on, F.lit(salts).cast("bigint").alias("_parts"))
    return materialize(parts, "busy")


def dealt_join(
    rows: DataFrame, side: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = SALTS, busy: int = BUSY,
    parts: DataFrame | None = None,
) -> DataFrame:
    """``salted_join`` that copies the side only for keys of more than ``busy`` rows; ``rows`` is read twice.

    ``parts`` are the ``busy_parts`` of the rows, if they are known already.
    """
    parts = busy_parts(rows, on, salts, busy) if parts is None else parts
    if _sent_whole(side):
        return rows.join(side, on, how)
    own = F.coalesce("_parts", F.lit(1).cast("bigint"))
    rows = rows.join(parts, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), own)).drop("_parts")
    side = side.join(parts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), own - 1))).drop("_parts")
    return rows.join(side.hint("merge"), [*on, "_salt"], how).drop("_salt")


# What the operator that ran last in this Python worker keeps for its later tasks.
_IN_WORKER: dict = {}


def kept_in_worker(key: tuple, make: Callable):
    """What ``make`` gives, made once in this worker process, so that tasks find what earlier ones remembered."""
    if key not in _IN_WORKER:
        _IN_WORKER[key] = make()
    return _IN_WORKER[key]


def free_worker() -> None:
    """Drop what other operators keep in this worker process, which lives on from stage to stage."""
    if _IN_WORKER:
        _IN_WORKER.clear()
        # states refer to each other
        gc.collect()
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name
