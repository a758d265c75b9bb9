"""Writing entries and results: text, JSON and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import truncate
from timberline.operators.parse import KNOWN_KEYS

# Fixed value: how an absent time is written.
ZERO_TIME = "0001-01-01T00:00:00Z"


# parts that the rows of one day and level are dealt over
FILES = 16


def text_lines(entries: DataFrame, with_file: bool = False) -> DataFrame:
    """``value``: the raw line, with ``file:`` in front for multi-file output."""
    raw = F.col("raw")
    value = F.concat(F.col("file"), F.lit(":"), raw) if with_file else raw
    return entries.select(value.alias("value"))


def write_text(entries: DataFrame, path: str, with_file: bool = False) -> None:
    text_lines(entries, with_file).write.text(path)


def format_time(ts: Column) -> Column:
    """RFC 3339 in UTC, fractions only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(
        F.concat(F.lit("."), F.rtrim(micros, F.lit("0")))
    )
    return F.concat(whole, fraction, F.lit("Z"))


def _typed_fields(entries: DataFrame) -> Column:
    """Fields with their JSON types; NULL when there are none."""
    strings = F.to_json("fields")
    if not {"raw", "format"} <= set(entries.columns):
        return F.when(F.size("fields") > 0, F.parse_json(strings))
    typed = F.to_json(
        F.map_filter(
            F.from_json("raw", "map<string,variant>"), lambda k, v: ~k.isin(*KNOWN_KEYS)
        )
    )
    text = F.when(F.col("format") == "json", typed).otherwise(strings)
    return F.when(F.size("fields") > 0, F.try_parse_json(text))


def entry_json(entries: DataFrame) -> Column:
    """One entry as a JSON object; an empty source and empty fields are left out."""
    return F.to_json(
        F.struct(
            F.col("raw"),
            F.coalesce(format_time(F.col("ts")), F.lit(ZERO_TIME)).alias("timestamp"),
            F.col("level"),
            F.col("message"),
            F.nullif(F.col("source"), F.lit("")).alias("source"),
            _typed_fields(entries).alias("fields"),
            F.col("line"),
        )
    )


def json_lines(entries: DataFrame) -> DataFrame:
    return entries.select(entry_json(entries).alias("value"))


def write_json(entries: DataFrame, path: str, by_file: bool = False) -> None:
    """JSON lines; ``by_file`` keeps the entries of each file in their own folder."""
    if by_file:
        entries.select("file", entry_json(entries).alias("value")).write.partitionBy(
            "file"
        ).text(path)
    else:
        json_lines(entries).write.text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Any result table as JSON lines."""
    results.write.json(path)


def table_rows(entries: DataFrame) -> DataFrame:
    """``line, level, timestamp (HH:mm:ss or ''), message (cut)``, for display."""
    return entries.select(
        "line",
        "level",
        F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit("")).alias("timestamp"),
        truncate(F.col("message"), 80).alias("message"),
    )


def save_parsed(entries: DataFrame, path: str) -> None:
    """Keep parsed entries as Parquet, split by day and level so later filters skip files.

    Rows meet by day and level first, in at most ``FILES`` parts each, so that not every task
    writes a file into every folder.
    """
    part = F.pmod(F.xxhash64("raw"), F.lit(FILES))
    days = entries.withColumn("day", F.to_date("ts"))
    days.repartition("day", "level", part).write.partitionBy("day", "level").parquet(path)
