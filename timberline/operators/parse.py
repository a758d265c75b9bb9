"""Raw lines -> structured entries, as one projection of built-in expressions.

Each line's format is detected on its own (JSON, syslog, Apache/Nginx combined,
generic), so mixed files are fine. The work is staged in a few projections so that
every line is matched at most once per format, and whatever a query does not use
(often ``fields``) is pruned away by Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import levels, text, timestamps
from timberline.session import configure

# Line shapes. \s and \S are spelled out (ASCII blanks without \x0B).
SYSLOG_LINE = (
    r"(?s)^(?:<(\d+)>)?(\w{3})([\t\n\f\r ]+)(\d{1,2})([\t\n\f\r ]+)(\d{2}:\d{2}:\d{2})[\t\n\f\r ]+"
    r"([^\t\n\f\r ]+)[\t\n\f\r ]+([^\t\n\f\r ]+?)(?:\[(\d+)\])?:[\t\n\f\r ]+(.*)\z"
)
COMBINED_LINE = (
    r'(?s)^([^\t\n\f\r ]+) ([^\t\n\f\r ]+) ([^\t\n\f\r ]+) \[([^\]]+)\] '
    r'"([^\t\n\f\r ]+) ([^\t\n\f\r ]+)(?: ([^\t\n\f\r ]+))?" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)".*'
)
# What generic cleaning strips from the front, in this order.
LEADING_NOISE = (
    r"^(?:\[?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\]?[\t\n\f\r ]*)?"
    r"(?:\[?\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?\]?[\t\n\f\r ]*)?"
    r"(?:\[?\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\]?[\t\n\f\r ]*)?"
    r"(?:[\t\n\f\r ]*[\[\(]?(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)[\]\)]?"
    r"[\t\n\f\r ]*[-:]?[\t\n\f\r ]*)?"
)
# Groups of the two patterns, from 0.
(PRIORITY, MONTH, GAP_1, DAY, GAP_2, CLOCK, HOST, PROCESS, PID, TEXT) = range(10)
(REMOTE, IDENTITY, USER, TIME, METHOD, PATH, PROTOCOL, STATUS, SIZE, REFERER, AGENT) = range(11)

# JSON keys, by precedence.
MESSAGE_KEYS = ("msg", "message", "text")
LEVEL_KEYS = ("level", "severity", "lvl")
TIME_KEYS = ("time", "timestamp", "ts", "@timestamp")
KNOWN_KEYS = MESSAGE_KEYS + LEVEL_KEYS + TIME_KEYS + ("source",)

ENTRY_COLUMNS = ("raw", "format", "ts", "level", "message", "source", "fields")

# A log line has no line feed, so it is a safe separator for captured groups.
_SEP = "\n"


def _captures(line: Column, pattern: str, groups: int) -> Column:
    """All groups of a whole-line pattern from a single match; one element if none."""
    template = _SEP.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(line, pattern, template), _SEP)


def _json_value(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f'$[0]["{key}"]', "variant")


def _json_kind(doc: Column, key: str) -> Column:
    return F.schema_of_variant(_json_value(doc, key))


def _json_string(doc: Column, key: str) -> Column:
    """The value under ``key`` if it is a string, else NULL."""
    return F.when(
        _json_kind(doc, key) == "STRING", F.try_variant_get(doc, f'$[0]["{key}"]', "string")
    )


def _json_time_value(doc: Column) -> Column:
    """The first string or number among the time keys."""
    candidates = []
    for key in TIME_KEYS:
        usable = _json_kind(doc, key).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)")
        candidates.append(F.when(usable, _json_value(doc, key)))
    return F.coalesce(*candidates)


# microseconds in 64 bits
MAX_SECONDS = 9_223_372_036_854.0


def _json_time(value: Column, formats: Sequence[str], year: Column) -> Column:
    """A string in a known format, or epoch seconds / milliseconds (fractions cut off)."""
    number = F.try_variant_get(value, "$", "double")
    # all that a timestamp can hold; numbers above 1e12 are milliseconds
    in_seconds = number.between(-MAX_SECONDS, 1e12)
    in_millis = (number > 1e12) & (number <= MAX_SECONDS * 1000)
    return (
        F.when(
            F.schema_of_variant(value) == "STRING",
            timestamps.parse_with_formats(
                F.try_variant_get(value, "$", "string"), formats, year
            ),
        )
        .when(in_millis, F.timestamp_millis(number.cast("bigint")))
        .when(in_seconds, F.timestamp_seconds(number.cast("bigint")))
    )


@lru_cache(maxsize=4)
def _stages(app_id: str) -> tuple[list[tuple[str, Column]], Column]:
    """Steps of format detection, and the struct of their results.

    Columns are plain unresolved expressions, so they are built once per application:
    sending them to the JVM piece by piece takes longer than a small query.
    """
    raw, doc, sys_parts, web = F.col("raw"), F.col("_json"), F.col("_sys"), F.col("_web")
    # wrapped in brackets, trailing text after the object becomes invalid or a second element
    parsed = F.when(raw.startswith("{"), F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))))
    fmt = (
        F.when(doc.isNotNull(), "json")
        .when(sys_parts.isNotNull(), "syslog")
        .when(web.isNotNull(), "apache")
        .otherwise("generic")
    )
    steps = [
        ("_json", parsed),
        ("_json", F.when(F.try_variant_get(doc, "$[1]", "variant").isNull(), doc)),
        ("_sys", F.when(doc.isNull(), _captures(raw, SYSLOG_LINE, 10))),
        ("_sys", F.when(F.size(sys_parts) == 10, sys_parts)),
        ("_web", F.when(doc.isNull() & sys_parts.isNull(), _captures(raw, COMBINED_LINE, 11))),
        ("_web", F.when(F.size(web) == 11, web)),
        ("_format", fmt),
        ("_word", F.when(F.col("_format") == "generic", levels.extract_level_word(raw))),
    ]
    line = F.struct(
        doc.alias("json"),
        sys_parts.alias("sys"),
        web.alias("web"),
        F.col("_format").alias("format"),
        F.col("_word").alias("word"),
    )
    return steps, F.explode(F.array(line)).alias("_line")


def _detect(df: DataFrame) -> DataFrame:
    """Add ``_line``: the parsed document, captured groups, format and level word.

    The struct passes through a one-row ``explode``. Catalyst pushes predicates on
    ``raw``, ``file`` and the like through it to the scan, but not those on parsed
    columns, which would otherwise be inlined below and repeat the whole parse.
    """
    steps, line = _stages(df.sparkSession.sparkContext.applicationId)
    staged = df
    for name, column in steps:
        staged = staged.withColumn(name, column)
    return staged.select(*df.columns, line)


def detect_format(df: DataFrame) -> DataFrame:
    """Add ``format`` for each ``raw`` line."""
    configure(df.sparkSession)
    return _detect(df).withColumn("format", F.col("_line.format")).drop("_line")


def _json_level(doc: Column) -> Column:
    named = F.coalesce(*[_json_string(doc, k) for k in LEVEL_KEYS])
    return F.coalesce(levels.parse_level(named), F.lit(levels.UNKNOWN))


def _syslog_level(parts: Column) -> Column:
    # severity is the priority modulo 8, i.e. given by its last three digits
    priority = parts[PRIORITY]
    severity = F.pmod(F.right(priority, F.lit(3)).cast("int"), F.lit(8))
    # one literal array lookup; a CASE would repeat the expression
    by_severity = F.array(
        *[F.lit(x) for x in ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")]
    )
    in_message = levels.parse_level(levels.extract_level_word(parts[TEXT]))
    return F.when(priority != "", F.get(by_severity, severity)).otherwise(in_message)


def _web_level(parts: Column) -> Column:
    status = parts[STATUS]
    return (
        F.when(status.startswith("2") | status.startswith("3"), "INFO")
        .when(status.startswith("4"), "WARN")
        .when(status.startswith("5"), "ERROR")
        .otherwise(levels.UNKNOWN)
    )


def _web_protocol(parts: Column) -> Column:
    return F.when(parts[PROTOCOL] == "", "HTTP/1.0").otherwise(parts[PROTOCOL])


def _generic_message(raw: Column, word: Column) -> Column:
    """The line without its level word, leading timestamps and level prefix."""
    at = F.instr(raw, word)
    cut = F.when(
        word != "",
        F.concat(
            F.substr(raw, F.lit(1), at - 1),
            F.substr(raw, at + F.length(word)),
        ),
    ).otherwise(raw)
    cleaned = text.trim_space(F.regexp_replace(cut, LEADING_NOISE, ""))
    return F.when(cleaned == "", raw).otherwise(cleaned)


def _pairs(*pairs: tuple[str, Column]) -> Column:
    """Map of the non-null values."""
    entries = [
        F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
        for key, value in pairs
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _fields() -> Column:
    raw, sys_parts, web = F.col("raw"), F.col("_line.sys"), F.col("_line.web")
    fmt = F.col("_line.format")
    json_fields = F.map_filter(
        F.from_json(raw, "map<string,string>"), lambda k, v: ~k.isin(*KNOWN_KEYS)
    )
    syslog_fields = _pairs(
        ("process", F.nullif(sys_parts[PROCESS], F.lit(""))),
        ("pid", F.nullif(sys_parts[PID], F.lit(""))),
    )
    web_fields = _pairs(
        ("method", web[METHOD]),
        ("path", web[PATH]),
        ("protocol", _web_protocol(web)),
        ("status_code", web[STATUS]),
        ("size", F.nullif(web[SIZE], F.lit("-"))),
        ("referer", F.when(~web[REFERER].isin("-", ""), web[REFERER])),
        ("user_agent", F.nullif(web[AGENT], F.lit(""))),
        ("user", F.nullif(web[USER], F.lit("-"))),
    )
    return (
        F.when(fmt == "json", json_fields)
        .when(fmt == "syslog", syslog_fields)
        .when(fmt == "apache", web_fields)
        .otherwise(F.create_map().cast("map<string,string>"))
    )


@lru_cache(maxsize=16)
def _projection(
    app_id: str, formats: tuple[str, ...], reference_year: int | None
) -> tuple[Column, list[Column]]:
    """``_time`` from ``_line``, and the entry columns from both; built once like ``_stages``."""
    year = F.lit(reference_year) if reference_year else F.year(F.current_date())
    raw = F.col("raw")
    doc, sys_parts, web = F.col("_line.json"), F.col("_line.sys"), F.col("_line.web")
    fmt, word = F.col("_line.format"), F.col("_line.word")
    syslog_ts = F.when(
        F.concat(F.trim(sys_parts[GAP_1]), F.trim(sys_parts[GAP_2])) == "",
        timestamps.from_parts(year, sys_parts[MONTH], sys_parts[DAY], sys_parts[CLOCK]),
    )
    ts = (
        F.when(fmt == "json", _json_time(F.col("_time"), formats, year))
        .when(fmt == "syslog", syslog_ts)
        .when(fmt == "apache", timestamps.parse_clf(web[TIME]))
        .otherwise(timestamps.find_timestamp(raw, formats, year))
    )
    level = (
        F.when(fmt == "json", _json_level(doc))
        .when(fmt == "syslog", _syslog_level(sys_parts))
        .when(fmt == "apache", _web_level(web))
        .otherwise(levels.parse_level(word))
    )
    request = F.concat_ws(
        " ", web[METHOD], web[PATH], _web_protocol(web), F.lit("->"), web[STATUS]
    )
    message = (
        F.when(
            fmt == "json",
            F.coalesce(*[_json_string(doc, k) for k in MESSAGE_KEYS], F.lit("")),
        )
        .when(fmt == "syslog", sys_parts[TEXT])
        .when(fmt == "apache", request)
        .otherwise(_generic_message(raw, word))
    )
    source = (
        F.when(fmt == "json", F.coalesce(_json_string(doc, "source"), F.lit("")))
        .when(fmt == "syslog", sys_parts[HOST])
        .when(fmt == "apache", web[REMOTE])
        .otherwise("")
    )
    return _json_time_value(doc), [
        raw,
        fmt.alias("format"),
        ts.alias("ts"),
        level.alias("level"),
        message.alias("message"),
        source.alias("source"),
        _fields().alias("fields"),
    ]


def parse_logs(
    df: DataFrame,
    ts_formats: Sequence[str] = (),
    reference_year: int | None = None,
) -> DataFrame:
    """Parse ``raw`` into ``format, ts, level, message, source, fields``.

    Other columns (``file``, ``line``, ...) pass through, in front. Blank lines are
    dropped. ``ts_formats`` are Spark datetime patterns for JSON strings and line
    prefixes; ``reference_year`` completes syslog times, default the current year.
    """
    configure(df.sparkSession)
    formats = tuple(ts_formats) or timestamps.DEFAULT_FORMATS
    kept = [c for c in df.columns if c not in ENTRY_COLUMNS]
    app_id = df.sparkSession.sparkContext.applicationId
    lines = _detect(df.where(~text.is_blank(F.col("raw"))))
    time_value, entry_columns = _projection(app_id, formats, reference_year)
    return lines.withColumn("_time", time_value).select(*kept, *entry_columns)
