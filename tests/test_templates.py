import random
import re

import numpy as np
import pytest
from drain_reference import mine
from pyspark.sql import functions as F

from timberline.functions import tokens as tk
from timberline.operators import fold
from timberline.operators import templates as tp


def entries(spark, messages):
    rows = [(i + 1, m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "line bigint, message string")


def result(mined):
    return [
        (r.template_id, r.pattern, r["count"], r.examples)
        for r in mined.with_examples().orderBy("first_seq").collect()
    ]


def expected(messages, **config):
    found, assignment = mine(messages, **config)
    table = [
        (f"T_{i + 1}", " ".join(t["tokens"]), t["count"], t["examples"])
        for i, t in enumerate(found)
    ]
    return table, assignment


def check(spark, messages, **config):
    mined = tp.mine_templates(entries(spark, messages), **config)
    table, assignment = expected(messages, **config)
    assert result(mined) == table
    got = {r.seq: r.template_id for r in mined.assignments().collect()}
    want = {i + 1: f"T_{a + 1}" for i, a in enumerate(assignment) if a is not None}
    assert got == want
    totals = mined.totals().first()
    assert (totals.template_count, totals.total_log_count) == (len(table), len(want))
    return mined


def test_small_cases(spark):
    check(
        spark,
        [
            "Probe from 10.1.1.1 answered",
            "Probe from 10.2.2.2 answered",
            "Lift 17 is stuck",
            "Lift 23 is stuck",
            "  ",
            "Bound to 10.3.3.3:53",
            "Bound to 10.4.4.4:53",
            "Index rebuild finished",
            "Mail queue drained",
            "No seat left on k77",
            "a <*> literal wildcard token",
            "a plain literal wildcard token",
            "GET /short /a/very/long/path/over/20/bytes ok",
            "GET /short /ééééééééééé ok",
        ],
    )


def test_captured_keys_are_counted_where_they_went(spark, monkeypatch):
    # templates widen until they take messages that an own template had before
    recounts = []
    split = tp._split_captured

    def spy(*args):
        recounts.append(args[1].where("captured").count())
        return split(*args)

    monkeypatch.setattr(tp, "_split_captured", spy)
    for seed in (3, 5):
        rng = random.Random(seed)
        stream = [
            " ".join(["x"] + [rng.choice("abcde") for _ in range(5)]) for _ in range(1500)
        ]
        check(spark, stream, depth=2, threshold=0.66)
    assert recounts and sum(recounts) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_streams_equal_line_by_line(spark, monkeypatch, seed):
    monkeypatch.setattr(tp, "FIRST_FOLD", 3)  # several folds per leaf
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "12", "0x1f", "<*>", "10.0.0.1"]
    stream = [
        " ".join(rng.choice(vocabulary) for _ in range(rng.choice((2, 4, 5, 7))))
        for _ in range(250)
    ]
    check(
        spark,
        stream,
        depth=rng.choice((2, 3, 4)),
        threshold=rng.choice((0.4, 0.5, 0.7)),
        max_children=rng.choice((2, 3, 100)),
    )


def test_groups_are_mined_apart(spark):
    rows = [("s1", 1, "job 1 done"), ("s2", 2, "job 2 failed badly"), ("s1", 3, "job 4 done")]
    df = spark.createDataFrame(rows, "source string, line bigint, message string")
    mined = tp.mine_templates(df, by=["source"])
    got = sorted((r.source, r.template_id, r.pattern, r["count"]) for r in mined.templates.collect())
    assert got == [("s1", "T_1", "job <*> done", 2), ("s2", "T_1", "job <*> failed badly", 1)]


def test_placeholders_can_be_variable(spark):
    messages = ["from [IPV4:a3f2] ok", "from [IPV4:99aa] ok"]
    assert tp.mine_templates(entries(spark, messages)).templates.count() == 2
    masked = tp.mine_templates(entries(spark, messages), mask_placeholders=True)
    assert [r.pattern for r in masked.templates.collect()] == ["from <*> ok"]


def test_similarity_and_merge(spark):
    cases = [
        ("Door opened now", "Door opened now", 1.0, "Door opened now"),
        ("Door opened now", "Door opened late", 2 / 3, "Door opened <*>"),
        ("Door opened now", "Nothing happened", 0.0, "<*> <*> <*>"),
        ("Door <*> now", "Door 12 now", 1.0, "Door <*> now"),
    ]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases], "a string, b string")
    a, b = tk.tokenize(F.col("a")), tk.tokenize(F.col("b"))
    got = df.select(tk.similarity(a, b).alias("s"), F.array_join(tk.merge(a, b), " ").alias("m"))
    for row, (_, _, s, m) in zip(got.collect(), cases):
        assert row.s == pytest.approx(s) and row.m == m
    empty = df.limit(1).select(
        tk.similarity(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e"),
        tk.similarity(a, F.array().cast("array<string>")).alias("o"),
    ).first()
    assert (empty.e, empty.o) == (1.0, 0.0)


def test_masked_frequency(spark):
    df = entries(spark, ["x 1 y", "x\t2  y", "x z y", " "])
    got = {r.pattern: r["count"] for r in tp.template_frequency(df).collect()}
    assert got == {"x <*> y": 2, "x z y": 1}


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(tp, "KEY_BLOCK", 7)
    monkeypatch.setattr(tp, "TEMPLATE_BLOCK", 3)
    rng = random.Random(11)
    stream = [" ".join(["x"] + [rng.choice("abcdefg") for _ in range(5)] + [rng.choice(["1", "<*>", "z"])]) for _ in range(1200)]
    check(spark, stream, threshold=0.7)


def test_a_leaf_of_templates_that_never_merge(spark):
    n = 20_000
    word = lambda salt: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256), 1, 6)
    lines = spark.range(1, n + 1, 1, 4).select(
        F.col("id").alias("line"), F.concat_ws(" ", F.lit("a b c"), *[F.concat(F.lit("g"), word(s)) for s in "pqrstuv"]).alias("message")
    )
    # every line founds a template of the one leaf, and comes a second time
    twice = lines.unionByName(lines.withColumn("line", F.col("line") + n))
    mined = tp.mine_templates(twice)
    assert mined.templates.agg(F.count("*"), F.min("count"), F.max("count")).first() == (n, 2, 2)


def test_no_row_holds_a_leaf(spark):
    keys = spark.createDataFrame(
        [("3 a b c", "a b c d", 1, 9, False, False)], "leaf string, key string, first_seq bigint, last_seq bigint, active boolean, covered boolean"
    )
    templates = spark.createDataFrame([("3 a b c", 0, 1, ["a", "b", "c", "d"], [9, 9, 9, 9])], "leaf string, idx int, born bigint, init array<string>, wild array<bigint>")
    plan = tp._check(keys, templates, (), 0.5)._jdf.queryExecution().executedPlan().toString()
    # pairs of blocks are dealt, not leaves
    assert re.search(r"hashpartitioning\(leaf#\d+, block#\d+L, part#\d+L", plan)


def test_equal_messages_are_folded_once():
    rng = random.Random(5)
    words = [[rng.choice("abc") for _ in range(5)] for _ in range(40)]
    order = np.array([rng.randrange(40) for _ in range(3_000)])
    one, many, added = fold.Leaf(0.7), fold.Leaf(0.7), []
    want = [one.add(words[i], 0) for i in order.tolist()]
    add = many.add
    many.add = lambda *a: added.append(1) or add(*a)
    places, founded = many.add_all(words, order)
    assert places.tolist() == want and many.patterns() == one.patterns()
    assert founded == [want.index(t) for t in range(one.count)] and len(added) < 600
