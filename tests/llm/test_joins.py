"""Joins whose small side is copied: what of it goes through the driver."""

import pytest
from pyspark.sql import functions as F
from timberline.llm.common import dealt_join, salted_join
from timberline.session import materialize


@pytest.fixture
def threshold(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    yield
    spark.conf.set(key, before)


def joined(rows, side, join, **options):
    out = join(rows, side, ["k"], ["x"], **options)
    found = {tuple(r) for r in out.select("k", "x", "y").collect()}
    return found, out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("join", [salted_join, dealt_join])
@pytest.mark.parametrize("n", [500, 4_000])
def test_copies_of_a_side_are_not_sent_to_every_task(spark, threshold, join, n):
    # one key has half of the rows
    k = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % n)
    rows = materialize(spark.range(20_000).select(k.alias("k"), F.col("id").alias("x")), "rows")
    side = spark.range(n).select(F.col("id").alias("k"), F.xxhash64("id").alias("y"))
    want = {(k := 0 if i % 2 == 0 else i % n, i) for i in range(20_000)}
    # by the file's size alone, and by what an aggregate turns out to be
    grouped = materialize(side.crossJoin(spark.range(40).select("id")), "grouped").groupBy("k").agg(F.max("y").alias("y"))
    for part in (materialize(side, "side"), grouped):
        found, plan = joined(rows, part, join, **({"busy": 100} if join is dealt_join else {}))
        assert {x[:2] for x in found} == want and len(found) == len(want)
        assert "BroadcastHashJoin" not in plan or "Generate" not in plan


def test_a_side_without_rows(spark, threshold):
    rows = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("x"))
    side = materialize(spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("y")), "none")
    for join in (salted_join, dealt_join):
        assert join(rows, side, ["k"], ["x"]).count() == 0
        assert {tuple(r) for r in join(rows, side, ["k"], ["x"], "left").collect()} == {(i, i, None) for i in range(10)}
