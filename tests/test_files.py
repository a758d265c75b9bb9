"""File names are what the file system says, whatever characters they hold."""

import pytest
from pyspark.sql import functions as F

import timberline as tl
from timberline.sources.text import sequence_number

NAMES = ["my file.log", "a%20b.log", "x[1].log", "p+q.log", "ü{2}.log"]


@pytest.fixture
def folder(tmp_path):
    for i, name in enumerate(NAMES):
        (tmp_path / name).write_text("".join(f"ERROR line {j}\n" for j in range(i + 1)))
    return tmp_path


def test_names(spark, folder):
    want = {str(folder / name): i + 1 for i, name in enumerate(NAMES)}
    for path in (f"{folder}/*.log", str(folder), [f"{folder}/[!x]*.log", f"{folder}/x*"]):
        got = tl.read_logs(spark, path).groupBy("file").agg(F.max("line").alias("n")).collect()
        assert {r.file: r.n for r in got} == want
    with pytest.raises(FileNotFoundError):
        tl.read_logs(spark, f"{folder}/*.txt")


def test_tail_and_follow(spark, folder, tmp_path_factory):
    # Spark's stream source lists files twice beside one whose name looks like a pattern
    plain = [(i, name) for i, name in enumerate(NAMES) if not set(name) & set("[{")]
    for name in set(NAMES) - {name for _, name in plain}:
        (folder / name).unlink()
    seen = []
    query = tl.tail_and_follow(
        spark, str(folder), lambda batch, number: seen.append(sorted((r.file, r.message) for r in batch.collect())),
        str(tmp_path_factory.mktemp("state")), lines=2,
    )
    query.processAllAvailable()
    query.stop()
    want = [(str(folder / name), f"line {j}") for i, name in plain for j in range(max(0, i - 1), i + 1)]
    assert seen == [sorted(want)]


def test_sequence_has_limits(spark):
    rows = spark.createDataFrame([(1 << 23, 1)], "file_no bigint, line bigint")
    with pytest.raises(Exception, match="too many files"):
        rows.select(sequence_number(F.col("file_no"), F.col("line"))).collect()
