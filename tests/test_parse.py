from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline import detect_format, parse_logs
from timberline.functions.levels import parse_level


def parse(spark, *lines, **options):
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line bigint, raw string")
    options.setdefault("reference_year", 2027)
    return parse_logs(df, **options).orderBy("line").collect()


AT = datetime(2027, 3, 14, 8, 15, 42)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"timestamp": "2027-03-14T08:15:42Z", "level": "info", "message": "hello"}', "json"),
        ("Mar 14 08:15:42 edge7 chronyd[88]: Bye", "syslog"),
        ("Mar 14 08:15:42 edge7 udev: Device removed", "syslog"),
        (
            '203.0.113.9 - maria [14/Mar/2027:08:15:42 -0500] "GET /catalog/7 HTTP/1.1" 200 5120'
            ' "https://shop.test/" "Lynx/2.9"',
            "apache",
        ),
        ("2027-03-14 08:15:42 ERROR Cannot bind socket", "generic"),
        ("[2027-03-14T08:15:42Z] INFO: Worker ready", "generic"),
        ('{"x":1} trailing', "generic"),
        ("{'x':1}", "generic"),
        ("[1]", "generic"),
    ],
)
def test_format(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert detect_format(df).first()["format"] == want


def test_json(spark):
    rows = parse(
        spark,
        '{"timestamp": "2027-03-14T08:15:42Z", "level": "info", "message": "cache warmed", "tenant": "blue"}',
        '{"timestamp": "2027-03-14T08:15:42Z", "level": "error", "message": "upstream refused", "port": 8443, "tries": 4}',
        '{"ts": 1900000123, "level": "debug", "message": "lease renewed"}',
        '{"timestamp": 1900000123000, "level": "fatal", "message": "quorum lost"}',
        '{"time": "2027-03-14T08:15:42Z", "severity": "warning", "msg": "queue is deep"}',
        '{"msg": 5, "message": "second", "level": 3, "lvl": "crit", "source": 7, "blocked": true, "n": {"a": [1]}}',
        '{"time": "nonsense", "ts": 1900000123, "level": "loud", "text": "ERROR in text"}',
        '{"@timestamp": "14/Mar/2027:08:15:42 -0500", "message": "a", "message": "b", "source": "host"}',
        '{"ts": "2027-03-14 08:15:42.25", "text": ""}',
        '{"time": "Mar 14 08:15:42"}',
    )
    epoch = datetime(2030, 3, 17, 17, 48, 43)
    assert [(r.level, r.message, r.ts) for r in rows] == [
        ("INFO", "cache warmed", AT),
        ("ERROR", "upstream refused", AT),
        ("DEBUG", "lease renewed", epoch),
        ("FATAL", "quorum lost", epoch),
        ("WARN", "queue is deep", AT),
        ("FATAL", "second", None),
        ("UNKNOWN", "ERROR in text", None),  # unparsable text ends the search for a time
        ("UNKNOWN", "b", datetime(2027, 3, 14, 13, 15, 42)),
        ("UNKNOWN", "", datetime(2027, 3, 14, 8, 15, 42, 250000)),
        ("UNKNOWN", "", AT),
    ]
    assert [dict(r.fields) for r in rows[:6]] == [
        {"tenant": "blue"},
        {"port": "8443", "tries": "4"},
        {},
        {},
        {},
        {"blocked": "true", "n": '{"a":[1]}'},
    ]
    assert rows[5].source == "" and rows[7].source == "host"


def test_syslog(spark):
    rows = parse(
        spark,
        "Mar 14 08:15:42 edge7 chronyd[88]: Selected source 9",
        "Mar 14 08:15:42 store3 etcd: ERROR: member is down",
        "<27>Mar 14 08:15:42 box9 relay[17]: Handshake done",
        "<30>Mar 14 08:15:42 box4 ntpd: Clock in step",
        "<0>mar  6 08:15:42 h p: m",
        "<15>Feb 29 08:15:42 h p: m",
    )
    assert [(r.level, r.message, r.source, r.ts) for r in rows] == [
        ("UNKNOWN", "Selected source 9", "edge7", AT),
        ("ERROR", "ERROR: member is down", "store3", AT),
        ("ERROR", "Handshake done", "box9", AT),
        ("INFO", "Clock in step", "box4", AT),
        ("FATAL", "m", "h", datetime(2027, 3, 6, 8, 15, 42)),
        ("DEBUG", "m", "h", None),
    ]
    assert rows[0].fields == {"process": "chronyd", "pid": "88"}
    assert rows[1].fields == {"process": "etcd"}


def test_apache(spark):
    rows = parse(
        spark,
        '203.0.113.9 - maria [14/Mar/2027:08:15:42 -0500] "GET /catalog/7 HTTP/1.1" 200 5120 "https://shop.test/" "Lynx/2.9"',
        '198.51.100.4 - - [14/Mar/2027:09:30:00 -0500] "GET /old" 404 - "-" "wget/1.21" more',
        '192.0.2.77 - - [14/Mar/2027:23:59:59 -0500] "POST /orders HTTP/1.1" 500 89 "https://m.shop.test/" ""',
        '1.1.1.1 - - [bad] "GET / HTTP/1.1" 101 1 "" "x"',
    )
    assert [(r.level, r.message, r.source) for r in rows] == [
        ("INFO", "GET /catalog/7 HTTP/1.1 -> 200", "203.0.113.9"),
        ("WARN", "GET /old HTTP/1.0 -> 404", "198.51.100.4"),
        ("ERROR", "POST /orders HTTP/1.1 -> 500", "192.0.2.77"),
        ("UNKNOWN", "GET / HTTP/1.1 -> 101", "1.1.1.1"),
    ]
    assert rows[0].ts == datetime(2027, 3, 14, 13, 15, 42) and rows[3].ts is None
    assert rows[0].fields == {
        "method": "GET", "path": "/catalog/7", "protocol": "HTTP/1.1", "status_code": "200",
        "size": "5120", "referer": "https://shop.test/", "user_agent": "Lynx/2.9",
        "user": "maria",
    }
    assert rows[1].fields == {
        "method": "GET", "path": "/old", "protocol": "HTTP/1.0", "status_code": "404",
        "user_agent": "wget/1.21",
    }


@pytest.mark.parametrize(
    "raw, level, message, has_time",
    [
        ("2027-03-14T08:15:42Z ERROR Mirror unreachable", "ERROR", "Mirror unreachable", True),
        ("[2027-03-14 08:15:42] INFO Worker ready", "INFO", "Worker ready", True),
        ("2027-03-14 08:15:42 [WARN] Tape almost full", "WARN", "[] Tape almost full", True),
        ("FATAL: Power lost in rack", "FATAL", ": Power lost in rack", False),
        ("Debug: Walking the tree", "DEBUG", ": Walking the tree", False),
        ("03/14/2027 08:15:42 ERROR Backup skipped", "ERROR", "Backup skipped", True),
        ("2027-03-14T08:15:42 no zone", "UNKNOWN", "no zone", False),
        ("INFORMATION INFO x", "INFO", "RMATION INFO x", False),
        ("INFORMATION service", "UNKNOWN", "RMATION service", False),
        ("Mar 14 08:15:42 a line", "UNKNOWN", "Mar 14 08:15:42 a line", True),
        ("14/Mar/2027:08:15:42 -0500 clf", "UNKNOWN", "14/Mar/2027:08:15:42 -0500 clf", True),
        ("x 2027-03-14T08:15:42-05:00 INFO", "INFO", "x 2027-03-14T08:15:42-05:00", True),
        ("ERROR", "ERROR", "ERROR", False),
        ("éERROR x", "ERROR", "é x", False),
    ],
)
def test_generic(spark, raw, level, message, has_time):
    row = parse(spark, raw)[0]
    assert (row.level, row.message, row.ts is not None) == (level, message, has_time)


def test_custom_format_blank_and_long_lines(spark):
    rows = parse(
        spark,
        "14.03.2027 08-15-42 hello",
        "   \t ",
        "",
        "x" * 100_000,
        '{"time": "14.03.2027 08-15-42"}',
        ts_formats=["dd.MM.yyyy HH-mm-ss"],
    )
    assert [r.line for r in rows] == [1, 4, 5]
    assert rows[0].ts == AT and rows[2].ts == AT and len(rows[1].message) == 100_000


def test_levels(spark):
    spellings = {
        "DEBUG": ["debug", "DEBUG", "dbg", "DBG", "Debug"],
        "INFO": ["info", "INFO", "inf", "Info"],
        "WARN": ["warn", "warning", "WARNING", "Warn"],
        "ERROR": ["error", "err", "ERR", "Error"],
        "FATAL": ["fatal", "critical", "crit", "CRIT"],
        "UNKNOWN": ["", "trace", "notice", "x"],
    }
    rows = [(word, level) for level, words in spellings.items() for word in words]
    df = spark.createDataFrame(rows, "word string, want string")
    assert df.where(parse_level(F.col("word")) != F.col("want")).count() == 0


def test_filters_on_raw_reach_the_scan_and_parsed_ones_do_not(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    df = spark.read.text(str(tmp_path)).withColumnRenamed("value", "raw")
    plan = (
        parse_logs(df).where((F.col("level") == "ERROR") & F.col("raw").rlike("abc"))
    )._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert ", abc)" not in above and ", abc)" in below
    assert plan.count("parseJson") == 1
