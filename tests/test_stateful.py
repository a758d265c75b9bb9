"""Windows and templates on a stream against the batch operators, in several starts of the query."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

import timberline as tl
from timberline.operators.templates import mine_templates
from timberline.streaming import stateful

SCHEMA = "ts timestamp, level string, message string"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)
END = (START + timedelta(days=300), "INFO", "the very last line of all")


def run(spark, root, steps, operator, mode):
    """Each step's rows arrive as one file and are taken by a new start of the query."""
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query = (
            operator(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"))
            .writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{root}/out"))
            .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    return spark.read.parquet(f"{root}/out")


def log(seed, n):
    rng = random.Random(seed)
    words = ["disk", "user", "cache", "job"]
    rows = []
    for k in range(n):
        text = f"{rng.choice(words)} {rng.choice(['sda', 'sdb', '7'])} is {rng.choice(['full', 'ready', 'lost'])} after {rng.randrange(99)} tries {rng.choice('abcd')}"
        rows.append((START + timedelta(seconds=40 * k + rng.randrange(30)), rng.choice(["INFO", "ERROR", "DEBUG"]), text))
    return rows


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = log(1, 600)
    # out of order within the delay; one row far too late, and some without a time
    steps = [rows[:200], rows[210:220], rows[200:210] + rows[220:], [rows[3], (None, "INFO", "x"), END]]
    got = run(spark, tmp_path, steps, lambda s: stateful.stream_windows(s, "30m", "20 minutes"), "append")
    want = tl.time_windows(spark.createDataFrame(rows, SCHEMA), "30m").where("count > 0").drop("change_percent")
    order = lambda df: sorted(map(str, df.collect()))
    assert got.columns == want.columns and order(got) == order(want)


def test_stream_templates_equal_batch(spark, tmp_path):
    rows = log(2, 400)
    # within the delay, in no order at all
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    by_step = [sorted(shuffled[:150]), shuffled[150:300], shuffled[300:] + [(None, "INFO", "no time here"), (START, "INFO", " ")]]
    late = [(START, "INFO", "much too late to count")]
    steps = [*by_step, [(START + timedelta(days=2), "INFO", "later line 1")], late, [END], [END]]
    changes = run(spark, tmp_path, steps, lambda s: stateful.stream_templates(s, "1 day"), "update")
    got = stateful.current_templates(changes)
    kept = sorted([*rows, steps[3][0]], key=lambda r: (r[0], r[2]))
    batch = spark.createDataFrame([(*r, n) for n, r in enumerate(kept)], SCHEMA + ", seq bigint")
    mined = mine_templates(batch).templates.select("pattern", "count")
    assert sorted(map(tuple, got.select("pattern", "count").collect())) == sorted(map(tuple, mined.collect()))
    assert got.agg(F.min("first_ts")).first()[0].replace(tzinfo=timezone.utc) == min(r[0] for r in rows)


def test_leaf_restores_its_templates():
    from timberline.operators import fold

    one, two = fold.Leaf(0.5), fold.Leaf(0.5)
    keys = ["a b c", "a \t d", "x y z", "x y \t", "q q q", "a b <*>"]
    places = []
    for k in keys:
        two = fold.Leaf.restored(0.5, two.patterns())
        places.append((one.add(k.split(" "), 1), two.add(k.split(" "), 1)))
    assert all(a == b for a, b in places) and one.patterns() == two.patterns() == ["a b <*>", "a <*> d", "x y <*>", "q q q"]
