"""Log lines derived from the ``events`` table, in the four formats.

Every event becomes one line; the SQL in ``oracle`` states what parsing it must give,
straight from the event's columns.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.parse import parse_logs
from timberline.session import configure, spread

YEAR = 2024

VERBS = {
    "signup": "registered account",
    "purchase": "bought item",
    "view": "viewed page",
    "click": "clicked banner",
}
STATUS = {"signup": "404", "purchase": "201", "view": "200", "click": "302"}
SEVERITY = {"DEBUG": "15", "INFO": "14", "WARN": "12", "ERROR": "11", "FATAL": "10"}


def _choose(column: Column, values: dict[str, str], other: str) -> Column:
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(column == key, value)
    return out.otherwise(other)


@lru_cache(maxsize=4)
def _line_columns(app_id: str) -> list[Column]:
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    level = (
        F.when((kind == "error") & (u % 5 == 0), "FATAL")
        .when(kind == "error", "ERROR")
        .when(kind == "signup", "WARN")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
    )
    no_level, no_time = e % 11 == 3, e % 13 == 5
    verb = _choose(kind, VERBS, "failed on node")
    message = F.concat(
        F.lit("user "), u.cast("string"), F.lit(" "), verb, F.lit(" "), (e % 97).cast("string"),
        F.lit(" from 10.0."), (u % 256).cast("string"), F.lit("."), (e % 256).cast("string"),
        F.lit(" session s"), (u % 40).cast("string"), F.lit(" took "), (e % 500).cast("string"),
        F.lit(" ms"),
    )
    stamp = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    host = F.concat(F.lit("web-"), (u % 7).cast("string"))

    json = F.to_json(
        F.struct(
            F.when(~no_time, iso).alias("time"),
            F.when(~no_level, F.lower(level)).alias("level"),
            message.alias("msg"),
            F.when(e % 3 == 0, host).alias("source"),
            u.alias("user_id"),
        )
    )
    has_priority = e % 8 == 1
    syslog = F.concat(
        F.when(has_priority, F.concat(F.lit("<"), _choose(level, SEVERITY, "8"), F.lit(">"))).otherwise(""),
        F.date_format(at, "MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "),
        F.date_format(at, " HH:mm:ss "), host, F.lit(" app["), u.cast("string"), F.lit("]: "),
        F.when(has_priority | no_level, "").otherwise(F.concat(level, F.lit(": "))),
        message,
    )
    apache = F.concat(
        F.lit("10.1.0."), (u % 256).cast("string"), F.lit(" - "),
        F.when(u % 2 == 0, F.concat(F.lit("u"), u.cast("string"))).otherwise("-"),
        F.lit(" ["), F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "),
        F.lit('"GET /item/'), (e % 97).cast("string"), F.lit(' HTTP/1.1" '),
        F.when(no_level, "101").otherwise(_choose(kind, STATUS, "500")),
        F.lit(" "), (e % 5000).cast("string"), F.lit(' "-" "agent/'), (u % 3).cast("string"), F.lit('"'),
    )
    generic = F.concat_ws(
        " ",
        F.when(~no_time, stamp),
        F.when(~no_level, level),
        message,
    )
    shape = e % 4
    raw = (
        F.when(shape == 0, json).when(shape == 1, syslog).when(shape == 2, apache).otherwise(generic)
    )
    file_no = e % 3
    return [
        F.concat(F.lit("f"), file_no.cast("string"), F.lit(".log")).alias("file"),
        (e + 1).alias("line"),
        (F.shiftleft(file_no, 40) + e + 1).alias("seq"),
        raw.alias("raw"),
    ]


def render_lines(events: DataFrame, *columns: str) -> DataFrame:
    """``file, line, seq, raw`` and the given columns: one log line per event."""
    return events.select(*_line_columns(events.sparkSession.sparkContext.applicationId), *columns)


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return render_lines(spread(spark.read.parquet(f"{folder}/events.parquet")))


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed entries of the rendered events."""
    return parse_logs(event_lines(spark, folder), reference_year=YEAR)
