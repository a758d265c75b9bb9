"""Chunks against a brute-force version, with blocks so small that everything crosses their edges."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from timberline.operators import chunks as ck

SCHEMA = "file string, line bigint, level string, message string, ts timestamp, chunk string, n int"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def log(seed, files=3, most=400, errors=0.03):
    rng = random.Random(seed)
    rows = []
    for k in range(files):
        line, at = 0, datetime(2024, 1, 1, 9, 30, tzinfo=timezone.utc)
        for _ in range(rng.randrange(most)):
            line += rng.choice([1, 1, 1, 4])
            at += timedelta(minutes=rng.randrange(12))
            level = rng.choice(["ERROR", "FATAL"]) if rng.random() < errors else rng.choice(["INFO", None, "WARN"])
            rows.append((f"f{k}", line, level, f"m{rng.randrange(5)}", None if rng.random() < 0.3 else at))
    # one file that is nothing but errors, and one without times
    rows += [("all", i, "ERROR", "same", None) for i in range(1, 250)] + [("one", 7, "ERROR", "alone", None)]
    rng.shuffle(rows)
    return rows


def by_file(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out[r[0]].append(r)
    return out


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(ck, "BLOCK", 16)
    # the default of the offsets is bound when the module is loaded
    monkeypatch.setattr(ck._block, "__defaults__", (0, 16))


@pytest.mark.parametrize(("before", "after"), [(20, 10), (0, 0), (3, 0), (0, 5)])
def test_anchored_chunks(spark, tiny, before, after):
    rows = log(1)
    want = {}
    for file, own in by_file(rows).items():
        anchors = [i for i, r in enumerate(own) if r[2] in ("ERROR", "FATAL")]
        inside = [any(a - before <= i <= a + after for a in anchors) for i in range(len(own))]
        chunk = 0
        for i, r in enumerate(own):
            chunk += inside[i] and not (i and inside[i - 1])
            if inside[i]:
                want[file, r[1]] = (chunk, i in anchors)
    got = ck.anchored_chunks(entries(spark, rows), before, after)
    assert {(r.file, r.line): (r.chunk_id, r.anchor) for r in got.collect()} == want
    assert got.columns[:7] == ["file", "line", "level", "message", "ts", "chunk", "n"]


@pytest.mark.parametrize(("size", "overlap"), [(30, 10), (5, 0), (7, 6), (1, 0)])
def test_sliding_chunks(spark, tiny, size, overlap):
    rows = log(2)
    want = set()
    for file, own in by_file(rows).items():
        chunk, start = 1, 0
        while True:
            want.update((file, r[1], chunk) for r in own[start : start + size])
            if start + size >= len(own):
                break
            chunk, start = chunk + 1, start + size - overlap
    got = ck.sliding_chunks(entries(spark, rows), size, overlap).select("file", "line", "chunk_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def brute_hours(own):
    hours = [r[4] and int(r[4].timestamp()) // 3600 for r in own]
    known = [h for h in hours if h is not None]
    carried, out = known[0] if known else 0, []
    for h in hours:
        carried = carried if h is None else h
        out.append(carried - (min(known) if known else 0) + 1)
    return out


def test_time_chunks(spark, tiny):
    rows = log(3)
    want = {(f, r[1]): c for f, own in by_file(rows).items() for r, c in zip(own, brute_hours(own), strict=True)}
    got = ck.time_chunks(entries(spark, rows), "1h")
    assert {(r.file, r.line): r.chunk_id for r in got.collect()} == want


@pytest.mark.parametrize(("least", "largest"), [(10, 20), (0, 2), (30, 100), (1, 7)])
def test_packs_keep_their_bounds(spark, tiny, least, largest):
    rows = log(4)
    packed = ck.pack_chunks(ck.time_chunks(entries(spark, rows), "1h"), least, largest).collect()
    assert sorted((r.file, r.line) for r in packed) == sorted((r[0], r[1]) for r in rows)
    for file, own in by_file(rows).items():
        packs = [r.pack_id for r in sorted((r for r in packed if r.file == file), key=lambda r: (r.chunk_id, r.pos))]
        # neighbours only, numbered without gaps
        assert packs == sorted(packs) and set(packs) == set(range(1, max(packs) + 1))
        sizes = [packs.count(p) for p in sorted(set(packs))]
        assert max(sizes) <= largest and all(s >= least for s in sizes[:-1]), (file, sizes)


def test_pack_texts(spark):
    at = datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows = [("a", 1, "INFO", "up", at), ("a", 2, "ERROR", "bad", None), ("a", 4, "ERROR", "bad", None), ("b", 1, None, "x", None)]
    packed = ck.pack_chunks(ck.time_chunks(entries(spark, rows), "1h"), 0, 10)
    got = {r.file: r.text for r in ck.pack_texts(packed).collect()}
    assert got == {
        "a": "a, lines 1 to 4, 2024-05-01T00:00:00Z to 2024-05-01T00:00:00Z: ERROR 2, INFO 1\nup\n2x bad", "b": "b, lines 1 to 1: \nx"
    }


def test_a_run_of_errors_is_many_tasks(spark):
    lines = spark.range(0, 100_000, 1, 4).select(
        F.lit("f").alias("file"), (F.col("id") + 1).alias("line"), F.lit("ERROR").alias("level"), F.lit("m").alias("message")
    )
    got = ck.anchored_chunks(lines)
    # one chunk, yet no key of the shuffles has more than a block with its copied edges
    assert got.agg(F.count("*"), F.max("chunk_id"), F.max("pos")).first() == (100_000, 1, 100_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file#" in plan and "_block#" in plan
    assert ck.pack_chunks(got, 50, 100).groupBy("pack_id").count().agg(F.max("count")).first()[0] <= 100


def test_empty_and_wrong_values(spark):
    none = entries(spark, [])
    packed = ck.pack_chunks(ck.time_chunks(none, "1h"), 1, 9)
    for got in (ck.anchored_chunks(none), ck.sliding_chunks(none), packed, ck.pack_texts(packed)):
        assert got.collect() == []
    with pytest.raises(ValueError, match="overlap"):
        ck.sliding_chunks(none, 10, 10)
    with pytest.raises(ValueError, match="largest"):
        ck.pack_chunks(none, 5, 6)
    with pytest.raises(ValueError, match="negative"):
        ck.anchored_chunks(none, -1)


def test_texts_read_the_entries_twice_at_most(spark):
    rows = spark.createDataFrame([("f", i, i, None, "INFO", f"m {i}") for i in range(1, 200)], "file string, line bigint, pos bigint, ts timestamp, level string, message string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    packed = ck.pack_chunks(ck.time_chunks(rows.mapInArrow(counted, rows.schema), "1h"), 20, 100)
    assert ck.pack_texts(packed).count() == 3 and read.value <= 2 * 199
