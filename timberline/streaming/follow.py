"""Live logs: the batch parse and filters on a Structured Streaming source.

A stream reads a folder into which log segments arrive; a rotated log is simply a new
segment. Line numbers are not defined on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.functions import redaction as rd
from timberline.operators.filters import tail_filter
from timberline.operators.parse import parse_logs
from timberline.operators.search import last_entries
from timberline.session import configure
from timberline.sources.text import file_name, read_logs


def follow_lines(
    spark: SparkSession, folder: str, max_files_per_trigger: int | None = None, with_block: bool = False
) -> DataFrame:
    """Streaming ``file, raw`` of the segments in ``folder``; ``with_block`` adds the offset of the split."""
    configure(spark)
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    value = F.col("value")
    block = [F.col("_metadata.file_block_start").alias("_block")] if with_block else []
    return reader.load(folder).select(
        *block,
        file_name().alias("file"),
        F.when(value.endswith("\r"), F.substr(value, F.lit(1), F.length(value) - 1))
        .otherwise(value)
        .alias("raw"),
    )


def follow_logs(
    spark: SparkSession,
    folder: str,
    min_level: str | None = None,
    pattern: str | None = None,
    ts_formats: Sequence[str] = (),
    reference_year: int | None = None,
    redact: bool = False,
    max_files_per_trigger: int | None = None,
    with_block: bool = False,
) -> DataFrame:
    """Streaming entries that pass the level and pattern filters; stateless, append mode."""
    lines = follow_lines(spark, folder, max_files_per_trigger, with_block)
    entries = parse_logs(lines, ts_formats, reference_year).where(tail_filter(min_level, pattern))
    if redact:
        entries = entries.withColumn("message", rd.redact(F.col("message"))).withColumn(
            "raw", rd.redact(F.col("raw"))
        )
    return entries


def tail(
    spark: SparkSession,
    path: str,
    lines: int = 10,
    min_level: str | None = None,
    pattern: str | None = None,
    reference_year: int | None = None,
) -> DataFrame:
    """The last ``lines`` matching entries of each file, without following."""
    entries = read_logs(spark, path, reference_year=reference_year)
    return last_entries(entries, lines, tail_filter(min_level, pattern))


def tail_and_follow(
    spark: SparkSession,
    folder: str,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    lines: int = 10,
    min_level: str | None = None,
    pattern: str | None = None,
    reference_year: int | None = None,
) -> StreamingQuery:
    """Hand the last ``lines`` entries per file to ``on_batch``, then what arrives later.

    The first micro-batch holds the segments present at the start and is cut to its
    last lines; later ones are passed on whole. A restart with the same ``checkpoint``
    resumes after the segments already seen.
    """
    stream = follow_logs(
        spark, folder, min_level, pattern, reference_year=reference_year, with_block=True
    )

    def deliver(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            # rows of a split come in order, and splits of a file by their offset
            newest = Window.partitionBy("file").orderBy(F.desc("_block"), F.desc("_row"))
            batch = (
                batch.withColumn("_row", F.monotonically_increasing_id())
                .withColumn("_nth", F.row_number().over(newest))
                .where(F.col("_nth") <= lines)
                .drop("_row", "_nth")
            )
        on_batch(batch.drop("_block"), batch_id)

    return (
        stream.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .start()
    )
