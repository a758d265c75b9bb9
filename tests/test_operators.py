from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import timberline as tl
from timberline.functions import timeref
from timberline.operators import filters, search, stats, windows
from timberline.sources import sinks
from timberline.sources.text import expand_paths, read_lines, read_logs, with_positions


def log(spark, *lines, file="a.log"):
    """Entries from 'level:message' at one-second steps from 2025-01-26T10:00:00Z."""
    rows = []
    for i, line in enumerate(lines):
        level, message = line.split(":", 1)
        rows.append((file, i + 1, datetime(2025, 1, 26, 10) + timedelta(seconds=i), level.upper(), message, "", message))
    return spark.createDataFrame(
        rows, "file string, line bigint, ts timestamp, level string, message string, source string, raw string"
    )


def at(spark, *items, source=""):
    rows = [("a.log", i + 1, t and datetime.fromisoformat(f"2025-01-26T{t}"), l, m, source, m) for i, (t, l, m) in enumerate(items)]
    return spark.createDataFrame(
        rows, "file string, line bigint, ts timestamp, level string, message string, source string, raw string"
    )


# -- parameters

def test_time_references():
    now = datetime(2025, 1, 26, 12, tzinfo=timezone.utc)
    ref = lambda s: timeref.parse_time_ref(s, now)
    assert ref("2025-01-26T10:00:01Z") == datetime(2025, 1, 26, 10, 0, 1, tzinfo=timezone.utc)
    assert ref("2025-01-26T10:00:01.5-05:00") == datetime(2025, 1, 26, 15, 0, 1, 500000, tzinfo=timezone.utc)
    assert ref("2025-01-26 10:00:01") == datetime(2025, 1, 26, 10, 0, 1, tzinfo=timezone.utc)
    assert ref("2025-01-26") == datetime(2025, 1, 26, tzinfo=timezone.utc)
    assert now - ref("1h30m") == timedelta(minutes=90)
    assert now - ref("1d2h") == timedelta(hours=26)
    assert now - ref("-1h") == timedelta(hours=-1)
    assert timeref.parse_duration("1.5h") == timedelta(minutes=90)
    assert timeref.parse_duration("100ms") == timedelta(milliseconds=100)
    for bad in ("banana", "", "2025-13-01", "5x", "1h banana", "2025-01-26T10:00:01"):
        with pytest.raises(ValueError):
            ref(bad)


# -- filters

def test_filters(spark):
    df = log(spark, "debug:a", "info:user_id=123", "warn:user_id=7", "error:product_id", "fatal:x", "unknown:y")
    def kept(condition):
        return [r.line for r in df.where(condition).orderBy("line").collect()]

    assert kept(filters.search_filter(level="warn")) == [3]
    assert kept(filters.search_filter(pattern="user_id", invert=True)) == [1, 4, 5, 6]
    assert kept(filters.search_filter(since="2025-01-26 10:00:04", until="2025-01-26T10:00:05Z")) == [5, 6]
    assert kept(filters.tail_filter("error")) == [4, 5, 6]
    assert kept(filters.tail_filter("unknown")) == [1, 2, 3, 4, 5, 6]
    assert kept(filters.tail_filter("error", "product")) == [4]
    assert kept(filters.tail_filter(pattern=r"user_id=\d+")) == [2, 3]
    assert kept(filters.entry_filter(min_level="fatal")) == [5, 6]
    assert kept(filters.entry_filter(min_level="fatal", exact_level=True)) == [5]
    assert kept(filters.search_filter(level="unknown", allow_unknown=True)) == [6]
    no_time = df.withColumn("ts", F.lit(None).cast("timestamp"))
    assert no_time.where(filters.in_time_range(since="2030-01-01")).count() == 6
    for bad in (dict(invert=True), dict(level="loud"), dict(level="unknown"), dict(pattern="[")):
        with pytest.raises(ValueError):
            filters.search_filter(**bad)


# -- search

def brute_context(hits, c):
    keep, group, last = {}, 0, None
    for i, hit in enumerate(hits):
        if hit:
            if last is None or i - last > c:
                group += 1
            for j in range(max(0, i - c), i + c + 1):
                if j < len(hits) and (j not in keep):
                    keep[j] = group
            last = i
    return keep


def test_context_and_groups(spark):
    df = log(spark, "info:first", "error:boom", "info:after1", "info:between", "error:boom2", "info:after2")
    got = search.search_context(df, filters.matches("boom"), 1, groups=True).orderBy("line").collect()
    assert [(r.line, r.group_id, r.matched) for r in got] == [
        (1, 1, False), (2, 1, True), (3, 1, False), (4, 2, False), (5, 2, True), (6, 2, False)
    ]


@pytest.mark.parametrize("context", [1, 2, 5])
def test_context_over_block_edges(spark, monkeypatch, context):
    monkeypatch.setattr(search, "BLOCK", 7)
    import random

    rng = random.Random(context)
    hits = [rng.random() < 0.08 for _ in range(300)]
    rows = [("f", 3 * i + 1, "hit" if h else "no") for i, h in enumerate(hits)]
    df = spark.createDataFrame(rows, "file string, line bigint, raw string")
    # two files with gaps in their line numbers
    df = df.unionByName(df.withColumn("file", F.lit("g")))
    got = search.search_context(with_positions(df, chunk=11), F.col("raw") == "hit", context, groups=True)
    want = brute_context(hits, context)
    for name in "fg":
        assert {(r.line - 1) // 3: r.group_id for r in got.where(F.col("file") == name).collect()} == want


def test_counts_and_last(spark, monkeypatch):
    df = log(spark, "error:boom", "info:x").unionByName(log(spark, "error:boom", "info:boom", file="b.log"))
    files = spark.createDataFrame([("a.log",), ("b.log",), ("c.log",)], "file string")
    got = {r.file: r["count"] for r in search.count_matches(df, filters.matches("boom"), files).collect()}
    assert got == {"a.log": 1, "b.log": 2, "c.log": 0}
    inverted = search.count_matches(log(spark, "info:first", "error:boom", "info:after"), filters.matches("boom", True))
    assert inverted.first()["count"] == 2

    many = spark.range(1, 2501).select(F.lit("f").alias("file"), F.col("id").alias("line"), F.col("id").alias("raw"))
    monkeypatch.setattr(search, "BLOCK", 100)
    even = F.col("line") % 2 == 0
    for n in (0, 1, 10, 1_100, 5_000):
        got = sorted(r.line for r in search.last_entries(many, n, even).collect())
        assert got == list(range(2, 2501, 2))[max(0, 1250 - n):]


# -- statistics

def test_stats(spark):
    df = log(spark, "info:first", "error:boom", "info:second", "error:boom", "warn:warning")
    row = stats.compute_stats(df, 2).first()
    assert (row.total_lines, row.error_rate) == (5, 0.4)
    assert row.level_counts == {"INFO": 2, "ERROR": 2, "WARN": 1}
    assert [(m.message, m["count"]) for m in row.top_messages] == [("boom", 2), ("first", 1)]
    assert row.last_entry - row.first_entry == timedelta(seconds=4)
    levels = [(r.level, r["count"], r.percent) for r in stats.level_counts(df).collect()]
    assert levels == [("ERROR", 2, 40.0), ("WARN", 1, 20.0), ("INFO", 2, 40.0)]
    empty = stats.compute_stats(df.limit(0)).first()
    assert (empty.total_lines, empty.level_counts, empty.top_messages, empty.error_rate) == (0, {}, [], 0.0)
    rates = log(spark, "info:a", "error:b", "fatal:c")
    assert stats.error_rate(rates).first()[0] == pytest.approx(2 / 3)
    inside = df.where(filters.in_time_range("2025-01-26T10:00:01.5Z", "2025-01-26T10:00:03Z"))
    assert stats.time_span(inside).first().duration_seconds == 1.0


def test_group_by(spark):
    df = log(spark, "info:first", "error:boom", "info:second", "error:crash", "warn:warning")
    got = [tuple(r) for r in stats.group_by(df, "level", 2).collect()]
    assert got == [("ERROR", 2, 40.0), ("INFO", 2, 40.0)]
    assert [tuple(r) for r in stats.group_by(df, "source", None).collect()] == [("(unknown)", 5, 100.0)]
    assert stats.group_by(df, "message", 10).count() == 5
    with pytest.raises(ValueError):
        stats.group_by(df, "host")


# -- windows

def test_windows(spark):
    df = at(
        spark, ("10:00:00", "INFO", "a"), ("10:00:30", "UNKNOWN", "b"), ("10:01:00", "ERROR", "c"),
        ("10:01:30", "FATAL", "d"), ("10:02:00", "INFO", "e"), ("10:04:59.999999", "INFO", "f"), (None, "INFO", "g"),
    )
    got = windows.time_windows(df, "1m").collect()
    assert [r.start.strftime("%H:%M") for r in got] == ["10:00", "10:01", "10:02", "10:03", "10:04"]
    assert [(r["count"], r.error_count, r.error_percent, r.change_percent) for r in got] == [
        (2, 1, 50.0, 0.0), (2, 2, 100.0, 0.0), (1, 0, 0.0, -50.0), (0, 0, 0.0, -100.0), (1, 0, 0.0, 0.0)
    ]
    assert got[1].level_counts == {"ERROR": 1, "FATAL": 1} and got[3].level_counts == {}
    assert sum(r["count"] for r in windows.window_levels(df, "1m").collect()) == 6
    week = windows.time_windows(df, "7d").collect()
    assert len(week) == 1 and week[0].start.weekday() == 0
    assert windows.time_windows(df.where("ts is null"), "1m").count() == 0
    for bad in ("0s", "-1m", "soon"):
        with pytest.raises(ValueError):
            windows.time_windows(df, bad)


def test_many_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "FILL_BLOCK", 16)
    df = at(spark, ("10:00:00", "INFO", "a"), ("10:10:00", "INFO", "b"))
    got = windows.time_windows(df, "1s").collect()
    assert len(got) == 601 and sum(r["count"] for r in got) == 2
    assert [r.start for r in got] == sorted(r.start for r in got)


# -- files

def test_files(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b"one\r\n\n  \ntwo\rx\n")
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, 2001)))
    (tmp_path / "c.txt").write_text("no")
    folder = str(tmp_path)
    both = expand_paths(spark, [f"{folder}/*.log", f"{folder}/a.log"])
    assert [p.rsplit("/", 1)[1] for p in both] == ["a.log", "b.log"]
    for bad in ([f"{folder}/*.gone"], []):
        with pytest.raises((FileNotFoundError, ValueError)):
            expand_paths(spark, bad)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("300b", "5000b", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            rows = read_lines(spark, [f"{folder}/*.log"]).collect()
            got = sorted((r.file.rsplit("/", 1)[1], r.line, r.pos, r.raw) for r in rows)
            want = [("a.log", i, i - i // 5, f"line {i}") for i in range(1, 2001) if i % 5]
            want += [("b.log", 1, 1, "one"), ("b.log", 4, 2, "two\rx")]
            assert got == sorted(want)
            ordered = [(r.file, r.line) for r in sorted(rows, key=lambda r: r.seq)]
            assert ordered == sorted(ordered) and len({r.seq for r in rows}) == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert read_lines(spark, f"{folder}/*.log", numbered=False).columns == ["file", "raw"]


def test_sinks(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"level": "warn", "msg": "m", "n": 5, "time": "2025-01-26T10:00:01.250Z"}\nplain ' + "y" * 90 + "\n")
    entries = read_logs(spark, str(tmp_path / "x.log"))
    lines = [r.value for r in sinks.json_lines(entries.orderBy("line")).collect()]
    import json

    first, second = (json.loads(x) for x in lines)
    assert first["timestamp"] == "2025-01-26T10:00:01.25Z" and first["fields"] == {"n": 5} and first["line"] == 1
    assert second["timestamp"] == sinks.ZERO_TIME and "fields" not in second and "source" not in second
    table = sinks.table_rows(entries).orderBy("line").collect()
    assert table[0].timestamp == "10:00:01" and table[1].timestamp == "" and len(table[1].message) == 80
    sinks.write_text(entries, str(tmp_path / "out"), with_file=True)
    assert all(r.value.startswith(str(tmp_path)) for r in spark.read.text(str(tmp_path / "out")).collect())
    sinks.write_json(entries, str(tmp_path / "json"), by_file=True)
    sinks.save_parsed(entries, str(tmp_path / "parsed"))
    assert spark.read.parquet(str(tmp_path / "parsed")).where("level = 'WARN'").count() == 1


# -- live

def test_follow(spark, tmp_path):
    live = tmp_path / "live"
    live.mkdir()
    (live / "1.log").write_text("".join(f"INFO old {i}\n" for i in range(20)))
    got = []

    def collect(batch, batch_id):
        got.append(sorted(r.message for r in batch.select("message").collect()))

    query = tl.tail_and_follow(spark, str(live), collect, str(tmp_path / "cp"), lines=2)
    query.processAllAvailable()
    (live / "2.log").write_text("ERROR new\nDEBUG fresh\n")
    query.processAllAvailable()
    query.stop()
    assert got == [["old 18", "old 19"], ["fresh", "new"]]
    assert tl.tail(spark, str(live / "1.log"), 3).count() == 3

    stream = tl.follow_logs(spark, str(live), min_level="error", redact=True)
    query = stream.writeStream.format("memory").queryName("errors").start()
    query.processAllAvailable()
    query.stop()
    assert [r.message for r in spark.table("errors").collect()] == ["new"]
