"""Reading log files: lines with exact numbers, without funnelling a file through one task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.text import is_blank
from timberline.operators.parse import parse_logs
from timberline.session import configure, materialize

# monotonically_increasing_id() keeps the task number above its low 33 bits
_TASK_BITS = 33
# seq = file number above 40 bits of line number
_LINE_BITS = 40


def expand_paths(spark: SparkSession, patterns: str | Sequence[str]) -> list[str]:
    """Sorted, de-duplicated files for paths and glob patterns; an error if one matches nothing."""
    if isinstance(patterns, str):
        patterns = [patterns]
    if not patterns:
        raise ValueError("no file patterns provided")
    found = set()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for pattern in patterns:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        statuses = path.getFileSystem(hadoop).globStatus(path)
        if not statuses:
            raise FileNotFoundError(f"no matches for {pattern!r}")
        found.update(str(status.getPath().toString()) for status in statuses)
    return sorted(found)


def file_name() -> Column:
    """The path a line was read from, as it is spelled in the file system."""
    # the metadata column holds a URI, in which a plus sign is only itself
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:(//)?", "")


def literal_path(path: str) -> str:
    """``path`` with the characters that would make it a pattern escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def sequence_number(file_no: Column, line: Column) -> Column:
    """Orders all lines of all files; an error beyond 8,388,608 files or 2^40 lines in one."""
    fits = (file_no < (1 << (63 - _LINE_BITS))) & (line < (1 << _LINE_BITS))
    return F.when(fits, F.shiftleft(file_no.cast("bigint"), _LINE_BITS) + line).otherwise(
        F.raise_error(F.lit("too many files or lines for one sequence")).cast("bigint")
    )


def _scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    value = F.col("value")
    return (
        spark.read.option("lineSep", "\n")
        .text([literal_path(p) for p in paths])
        .select(
            file_name().alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.when(value.endswith("\r"), F.substr(value, F.lit(1), F.length(value) - 1))
            .otherwise(value)
            .alias("raw"),
        )
    )


def _split_table(scan: DataFrame) -> DataFrame:
    """One small row per input split: where its lines and entries start in the file."""
    counted = materialize(
        scan.groupBy("file", "_block").agg(
            F.min("_row").alias("first_row"),
            F.count("*").alias("n_lines"),
            F.count_if(~is_blank(F.col("raw"))).alias("n_entries"),
        ),
        "splits",
    )
    before = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("_block").rowsBetween(*before)
    task = F.shiftright("first_row", _TASK_BITS)
    in_task = Window.partitionBy(task).orderBy("first_row").rowsBetween(*before)

    def total(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    # the file list is already held by the driver, so ranking it in one task is fine
    numbers = (
        counted.select("file").distinct()
        .select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("file_no"))
    )
    return materialize(
        counted.join(numbers, "file").select(
            "file",
            "_block",
            "file_no",
            "first_row",
            total("n_lines", in_file).alias("lines_before"),
            total("n_entries", in_file).alias("entries_before"),
            total("n_entries", in_task).alias("entries_before_in_task"),
        ),
        "split-offsets",
    )


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], numbered: bool = True
) -> DataFrame:
    """Non-blank lines as ``file, line, pos, seq, raw``.

    ``line`` is the 1-based position in the file counting blank lines, ``pos`` the
    ordinal among its non-blank lines, ``seq`` orders all lines of all files (by
    file name, then line). They come from one counting pass over the splits and a
    lookup of each split's offsets; the rows themselves are never shuffled or
    sorted. ``numbered=False`` skips that and gives ``file, raw``.
    """
    configure(spark)
    files = expand_paths(spark, paths)
    if not numbered:
        scan = _scan(spark, files)
        return scan.where(~is_blank(F.col("raw"))).select("file", "raw")

    # both passes must cut the files alike, also if executors come and go in between
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)
        )
    scan = _scan(spark, files).withColumn("_row", F.monotonically_increasing_id())
    splits = _split_table(scan)
    entries = scan.where(~is_blank(F.col("raw"))).withColumn(
        "_entry", F.monotonically_increasing_id()
    )
    task = F.shiftright("_row", _TASK_BITS)
    same_cut = F.shiftright("first_row", _TASK_BITS) == task
    first_row = F.when(same_cut, F.col("first_row")).otherwise(
        F.raise_error(F.lit("input splits changed between passes; read the files again")).cast(
            "bigint"
        )
    )
    line = (F.col("lines_before") + F.col("_row") - first_row + 1).alias("line")
    pos = (
        F.col("entries_before")
        + F.col("_entry")
        - F.shiftleft(task, _TASK_BITS)
        - F.col("entries_before_in_task")
        + 1
    ).alias("pos")
    numbered_lines = entries.join(splits, ["file", "_block"], "left").select(
        "file", line, pos, "file_no", "raw"
    )
    return numbered_lines.select(
        "file",
        "line",
        "pos",
        sequence_number(F.col("file_no"), F.col("line")).alias("seq"),
        "raw",
    )


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    ts_formats: Sequence[str] = (),
    reference_year: int | None = None,
    numbered: bool = True,
) -> DataFrame:
    """Files -> entries."""
    return parse_logs(read_lines(spark, paths, numbered), ts_formats, reference_year)


def with_sequence(entries: DataFrame) -> DataFrame:
    """Add ``seq`` to entries that carry only ``file`` and ``line``."""
    if "seq" in entries.columns:
        return entries
    if "file" not in entries.columns:
        return entries.withColumn("seq", F.col("line").cast("bigint"))
    files = materialize(entries.select("file").distinct(), "files")
    numbers = files.select(
        "file", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint").alias("file_no")
    )
    return entries.join(numbers, "file").select(
        *entries.columns,
        sequence_number(F.col("file_no"), F.col("line")).alias("seq"),
    )


def with_positions(entries: DataFrame, chunk: int = 65_536) -> DataFrame:
    """Add ``pos``, the ordinal of each entry in its file, to entries without it.

    Counts per block of lines give the offsets, so even a huge file is numbered by
    many tasks.
    """
    if "pos" in entries.columns:
        return entries
    keyed = entries.withColumn("_chunk", F.floor(F.col("line") / F.lit(chunk)))
    counts = materialize(keyed.groupBy("file", "_chunk").agg(F.count("*").alias("n")), "chunks")
    before = (
        Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "file", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("file", "_chunk").orderBy("line")
    return (
        keyed.withColumn("_nth", F.row_number().over(inside))
        .join(offsets, ["file", "_chunk"])
        .select(*entries.columns, (F.col("_before") + F.col("_nth")).alias("pos"))
    )
