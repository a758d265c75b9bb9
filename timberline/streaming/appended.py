"""Files that grow: what is appended to them arrives once, with exact line numbers.

The source's offset is the number of bytes of each file that were handed over, always up to the end of a line.
A micro-batch is the bytes between two offsets, cut into pieces on a fixed grid, one task each, so a replayed
batch has the same pieces and rows, and one much grown file is many tasks. The driver lists the folder and looks for the last
line end of each file; it reads no content beyond that.

Rows know their piece and their number in it. ``number_lines`` turns these into line numbers: the lines of
earlier pieces are counted per batch, those of earlier batches are kept per file in a small table for each batch.

Defined cases: a last line without its line end waits until it has one; blank lines count for the numbers; a file
that has become shorter was replaced and is read from its start, its lines being numbered from 1 again; a file that has gone is forgotten; bytes that are
no UTF-8 become replacement characters. Paths may have any scheme that Arrow's file systems know, and must be reachable from
all executors.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from timberline.operators.filters import tail_filter
from timberline.operators.parse import parse_logs
from timberline.session import configure

# bytes that one task reads
PIECE = 32 << 20
# bytes looked at in a step while searching for the last line end
TAIL = 1 << 16
# rows and bytes of a batch of lines
ROWS, BYTES = 8_192, 4 << 20

SCHEMA = "file string, fresh boolean, piece bigint, nth bigint, raw string"


@dataclass
class Piece(InputPartition):
    """The lines of ``file`` that begin in [start, stop); ``fresh`` if the file is read from its start."""

    file: str
    start: int
    stop: int
    origin: int  # where the batch begins in the file, at the start of a line
    fresh: bool


def _last_line_end(files: pa.fs.FileSystem, path: str, size: int) -> int:
    """The number of bytes up to and with the last line end."""
    with files.open_input_file(path) as f:
        stop = size
        while stop > 0:
            start = max(0, stop - TAIL)
            at = f.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, piece: int):
        self.folder, self.pattern, self.piece = folder, pattern, piece

    def _open(self) -> tuple[pa.fs.FileSystem, str]:
        if "://" in self.folder or self.folder.startswith("file:"):
            return pa.fs.FileSystem.from_uri(self.folder)
        return pa.fs.LocalFileSystem(), self.folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from fnmatch import fnmatch

        files, root = self._open()
        found = {}
        for info in files.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
            if info.type == pa.fs.FileType.File and fnmatch(posixpath.basename(info.path), self.pattern):
                found[info.path] = _last_line_end(files, info.path, info.size)
        return found

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, stop in sorted(end.items()):
            origin = start.get(file, 0)
            origin = origin if stop >= origin else 0
            out += [
                Piece(file, at, min(at + self.piece, stop), origin, origin == 0) for at in range(origin, stop, self.piece)
            ]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = self._open()
        with files.open_input_file(partition.file) as source:
            # a line belongs to the piece in which it begins
            at = partition.start if partition.start == partition.origin else partition.start - 1
            source.seek(at)
            lines = io.BufferedReader(source, 1 << 20)
            if at != partition.start:
                at += len(lines.readline())
            held, size, nth = [], 0, 0
            while at < partition.stop:
                line = lines.readline()
                at += len(line)
                held.append(line[:-1].removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line)
                if len(held) == ROWS or size >= BYTES:
                    yield self._batch(partition, nth, held)
                    nth, held, size = nth + len(held), [], 0
            if held:
                yield self._batch(partition, nth, held)

    def _batch(self, partition: Piece, before: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        columns = [
            pa.array([partition.file] * n), pa.array([partition.fresh] * n), pa.array([partition.start] * n, pa.int64()),
            pa.array(range(before + 1, before + n + 1), pa.int64()), pa.array(lines, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["file", "fresh", "piece", "nth", "raw"])


class AppendedFiles(DataSource):
    """Streaming source ``appended_files``; options ``path``, ``pattern`` (of file names) and ``piece`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "appended_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        own = self.options
        return _Reader(own["path"].rstrip("/"), own.get("pattern", "*"), int(own.get("piece", PIECE)))


def follow_appended(spark: SparkSession, folder: str, pattern: str = "*", piece: int = PIECE) -> DataFrame:
    """Streaming ``file, fresh, piece, nth, raw`` of all lines that the files in ``folder`` have and get."""
    import timberline.streaming.appended as own

    configure(spark)
    # the source travels with the job, so executors need no copy of this package
    cloudpickle.register_pickle_by_value(own)
    spark.dataSource.register(AppendedFiles)
    return spark.readStream.format(AppendedFiles.name()).option("pattern", pattern).option("piece", piece).load(folder)


def number_lines(on_batch: Callable[[DataFrame, int], None], state: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands ``file, line, raw`` on to ``on_batch``, blank lines included.

    ``state`` is a folder next to the query's checkpoint; it gets one small table per batch, with the number of
    lines of each file so far. A batch that is replayed after a failure writes the same table again.
    """

    def table(batch_id: int) -> str:
        return f"{state}/batch={batch_id}"

    def earlier(spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id > 0:
            try:
                return spark.read.schema("file string, lines bigint").parquet(table(batch_id - 1))
            except AnalysisException:
                # only the first batch has none before it
                raise ValueError(f"no line counts of batch {batch_id - 1} in {state}: state and checkpoint do not belong together") from None
        return spark.createDataFrame([], "file string, lines bigint")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy("file", "fresh", "piece").agg(F.count("*").alias("n"))
        before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        known = earlier(spark, batch_id)
        since = F.when(F.col("fresh"), F.lit(0)).otherwise(F.coalesce("lines", F.lit(0)))
        offsets = counts.join(known, "file", "left").select(
            "file", "fresh", "piece", "n", since.alias("_since"), (since + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("_before")
        )
        totals = offsets.groupBy("file").agg((F.max("_since") + F.sum("n")).alias("lines"))
        untouched = known.join(totals, "file", "left_anti")
        totals.unionByName(untouched).write.mode("overwrite").parquet(table(batch_id))
        numbered = batch.join(offsets.select("file", "piece", "_before"), ["file", "piece"])
        on_batch(numbered.select("file", (F.col("_before") + F.col("nth")).alias("line"), "raw"), batch_id)

    return deliver


def parsed_batches(
    on_batch: Callable[[DataFrame, int], None], min_level: str | None = None, pattern: str | None = None,
    ts_formats: Sequence[str] = (), reference_year: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """Hands the entries of numbered lines on that pass the level and pattern filters."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        on_batch(parse_logs(batch, ts_formats, reference_year).where(tail_filter(min_level, pattern)), batch_id)

    return deliver
