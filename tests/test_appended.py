"""Growing files: every appended line arrives once, with its number, also after a restart."""

import pytest
from pyspark.sql import functions as F
from timberline.streaming import appended as ap


class Follower:
    """Follows a folder in steps; every step is a new start of the query on the same checkpoint."""

    def __init__(self, spark, root, piece=ap.PIECE, pattern="*"):
        self.spark, self.root, self.piece, self.pattern = spark, root, piece, pattern
        self.folder = root / "in"
        self.folder.mkdir()

    def append(self, name, text):
        with open(self.folder / name, "ab") as f:
            f.write(text if isinstance(text, bytes) else text.encode())

    def step(self):
        got = []
        query = (
            ap.follow_appended(self.spark, str(self.folder), self.pattern, self.piece)
            .writeStream.foreachBatch(ap.number_lines(lambda b, i: got.extend((r.file.split("/")[-1], r.line, r.raw) for r in b.collect()), f"{self.root}/lines"))
            .option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
        return sorted(got)


def test_appended_lines_arrive_once(spark, tmp_path):
    f = Follower(spark, tmp_path)
    f.append("a.log", "one\n\ntwo\r\nthr")
    f.append("b.log", "eins\n")
    assert f.step() == [("a.log", 1, "one"), ("a.log", 2, ""), ("a.log", 3, "two"), ("b.log", 1, "eins")]
    # the begun line is whole now, and a file is new
    f.append("a.log", "ee\nfour\n")
    f.append("c.log", b"\xff\xc3\xa9\n")
    assert f.step() == [("a.log", 4, "three"), ("a.log", 5, "four"), ("c.log", 1, "�é")]
    assert f.step() == []
    f.append("b.log", "zwei\ndrei\n")
    assert f.step() == [("b.log", 2, "zwei"), ("b.log", 3, "drei")]
    # replaced by a shorter file
    (f.folder / "a.log").write_text("new\n")
    (f.folder / "c.log").unlink()
    assert f.step() == [("a.log", 1, "new")]
    f.append("a.log", "newer\n")
    assert f.step() == [("a.log", 2, "newer")]


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_cut_no_line(spark, tmp_path, piece):
    f = Follower(spark, tmp_path, piece, "*.log")
    lines = ["x" * (n % 23) for n in range(60)]
    f.append("a.log", "\n".join(lines[:40]) + "\n")
    f.append("other.txt", "not followed\n")
    assert f.step() == [("a.log", n, text) for n, text in enumerate(lines[:40], 1)]
    f.append("a.log", "\n".join(lines[40:]) + "\n")
    assert f.step() == [("a.log", n, text) for n, text in enumerate(lines[40:], 41)]


def test_long_lines_and_batches(spark, tmp_path, monkeypatch):
    f = Follower(spark, tmp_path, 1 << 16)
    lines = ["y" * 300_000, *(f"line {n}" for n in range(20_000)), "z" * 200_000]
    f.append("big.log", "\n".join(lines) + "\n")
    got = f.step()
    assert [x[1:] for x in got] == list(enumerate(lines, 1))


def test_lost_state_is_an_error(spark, tmp_path):
    f = Follower(spark, tmp_path)
    f.append("a.log", "one\n")
    f.step()
    (tmp_path / "lines").rename(tmp_path / "elsewhere")
    f.append("a.log", "two\n")
    with pytest.raises(Exception, match="do not belong together"):
        f.step()


def test_parsed_entries(spark, tmp_path):
    f = Follower(spark, tmp_path)
    f.append("a.log", "2024-01-01 00:00:00 ERROR disk full\n\n2024-01-01 00:00:01 INFO ok\n")
    got = []
    deliver = ap.parsed_batches(lambda b, i: got.extend(b.select("line", "level", "message").collect()), min_level="warn")
    query = (
        ap.follow_appended(spark, str(f.folder)).writeStream.foreachBatch(ap.number_lines(deliver, f"{tmp_path}/n"))
        .option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert [(r.line, r.level) for r in got] == [(1, "ERROR")]


def test_a_grown_file_is_many_tasks(spark, tmp_path):
    f = Follower(spark, tmp_path, 1_000)
    f.append("a.log", "some line\n" * 1_000)
    parts = []
    query = (
        ap.follow_appended(spark, str(f.folder), piece=1_000)
        .writeStream.foreachBatch(lambda b, i: parts.append(b.select(F.spark_partition_id().alias("p")).distinct().count()))
        .option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert parts == [10]
