"""Entries cut into chunks: around errors, by position, by time, and packed to a size.

Every function keeps one row per entry (and chunk) with ``chunk_id``, so no chunk is ever held by one task.
Files are worked on in blocks of ``BLOCK`` positions: what a block must know of earlier ones (how many chunks
began, how many lines a chunk has, the last known time) is carried over from one small row per block. A file that is one long
run of errors is many blocks, hence many tasks.

What is read several times is written once, with all columns of the entries: select those you need before.

Defined cases: chunks are numbered from 1 in each file; null levels anchor nothing; an empty table gives an empty
result. Entries need ``file`` and ``line`` (``pos`` is used if there).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.levels import LEVELS
from timberline.functions.text import estimate_tokens
from timberline.operators.windows import window_index, window_micros
from timberline.session import materialize
from timberline.sources.text import with_positions

BLOCK = 8_192
# The planned sizes of chunks.
BEFORE, AFTER = 20, 10
SIZE, OVERLAP = 30, 10


def is_error() -> Column:
    return F.col("level").isin("ERROR", "FATAL")


def _block(offset: int = 0, width: int = BLOCK) -> Column:
    return F.floor((F.col("pos") + F.lit(offset)) / F.lit(width))


def _earlier(keys: Sequence[str], at: str) -> Window:
    return Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)


def anchored_chunks(entries: DataFrame, before: int = BEFORE, after: int = AFTER, anchor: Column | None = None) -> DataFrame:
    """Entries from ``before`` entries ahead of an anchor to ``after`` behind it, with ``anchor, chunk_id``.

    Anchors are errors, unless given. Ranges that overlap or touch are one chunk. Each block has the rows of its neighbours
    that reach into it, so it decides on its own; blocks without an anchor near are not shuffled.
    """
    if before < 0 or after < 0:
        raise ValueError("before and after must not be negative")
    columns = entries.columns
    width = max(BLOCK, 4 * (before + after))
    marked = with_positions(entries).withColumn("anchor", F.coalesce(is_error() if anchor is None else anchor, F.lit(False)))

    def copied(rows: DataFrame) -> DataFrame:
        # one further back, so that a block sees whether a chunk goes on across its edge
        reached = F.sequence(_block(-before, width), _block(after + 1, width))
        return rows.withColumn("_home", _block(0, width)).withColumn("_block", F.explode(reached))

    busy = materialize(copied(marked.where("anchor").select("file", "pos")).select("file", "_block").distinct(), "busy-blocks")
    rows = copied(marked).join(busy, ["file", "_block"], "left_semi")
    ordered = Window.partitionBy("file", "_block").orderBy("pos")
    inside = (
        rows.withColumn("_in", F.max("anchor").over(ordered.rowsBetween(-after, before)))
        .withColumn("_starts", (F.col("_in") & ~F.lag("_in", 1, False).over(ordered)).cast("int"))
        .where("_in and _block = _home")
    )
    begun = materialize(inside.groupBy("file", "_block").agg(F.sum("_starts").alias("n")), "chunk-starts")
    offsets = begun.select("file", "_block", F.coalesce(F.sum("n").over(_earlier(["file"], "_block")), F.lit(0)).alias("_offset"))
    running = F.sum("_starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    numbered = inside.withColumn("_running", running).join(offsets, ["file", "_block"])
    return numbered.select(*columns, *(["pos"] if "pos" not in columns else []), "anchor", (F.col("_offset") + F.col("_running")).alias("chunk_id"))


def sliding_chunks(entries: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Entries with each ``chunk_id`` they are in: chunks of ``size`` entries that share ``overlap`` with the next.

    The last chunk of a file ends with the file and holds at least one entry that no other does.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    placed = with_positions(entries).withColumn("_block", _block())
    lengths = materialize(placed.groupBy("file").agg(F.max("pos").alias("_n")), "file-lengths")
    # a row for each block, so that no file is one key
    lengths = lengths.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / BLOCK))))
    last = F.greatest(F.ceil((F.col("_n") - size) / step), F.lit(0)) + 1
    first_of_row = F.greatest(F.ceil((F.col("pos") - size) / step), F.lit(0)) + 1
    last_of_row = F.least(F.floor((F.col("pos") - 1) / step) + 1, last)
    return placed.join(lengths, ["file", "_block"]).withColumn("chunk_id", F.explode(F.sequence(first_of_row, last_of_row))).drop("_block", "_n")


def time_chunks(entries: DataFrame, window: str | timedelta) -> DataFrame:
    """Entries with the ``chunk_id`` of their time window, counted from the file's first window.

    An entry without a time is in the chunk of the last entry before it that has one, or else of the first
    after it; a file without any times is one chunk. Windows without entries use up their number.
    """
    width = window_micros(window)
    columns = entries.columns
    placed = with_positions(entries)
    placed = placed.withColumn("_block", _block()).withColumn("_idx", F.when(F.col("ts").isNotNull(), window_index(width)))
    placed = materialize(placed, "placed")
    known = materialize(
        placed.groupBy("file", "_block").agg(
            F.max_by("_idx", F.when(F.col("_idx").isNotNull(), F.col("pos"))).alias("last"),
            F.min_by("_idx", F.when(F.col("_idx").isNotNull(), F.col("pos"))).alias("first"),
            F.min("_idx").alias("least"),
        ),
        "block-times",
    )
    whole = Window.partitionBy("file")
    carried = known.select(
        "file", "_block",
        F.last("last", True).over(_earlier(["file"], "_block")).alias("_carried"),
        F.first("first", True).over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"),
        F.min("least").over(whole).alias("_least"),
    )
    ordered = Window.partitionBy("file", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    idx = F.coalesce(F.last("_idx", True).over(ordered), F.col("_carried"), F.col("_first"), F.lit(0))
    chunk = idx - F.coalesce("_least", F.lit(0)) + 1
    placed = placed.join(carried, ["file", "_block"]).withColumn("chunk_id", chunk)
    return placed.select(*columns, *(["pos"] if "pos" not in columns else []), "chunk_id")


def pack_chunks(chunked: DataFrame, least: int, largest: int) -> DataFrame:
    """Add ``pack_id``: long chunks are split, short ones joined with their neighbours in the file.

    Every pack has at least ``least`` and at most ``largest`` entries, but the last of a file, which may have
    fewer. Chunks are cut into pieces of at most (largest - least) / 2 entries, and a pack takes the pieces that
    begin within (largest + least) / 2 entries; so a piece's pack follows from the number of entries before it, and
    that is known from sums over blocks.
    """
    piece = (largest - least) // 2
    if least < 0 or piece < 1:
        raise ValueError("the largest size must exceed the least by at least 2")
    target = largest - piece
    nth = F.row_number().over(Window.partitionBy("file", "chunk_id", "_block").orderBy("pos")) - 1
    keyed = materialize(chunked.withColumn("_block", _block()).withColumn("_nth", nth), "chunked")
    counts = materialize(keyed.groupBy("file", "chunk_id", "_block").agg(F.count("*").alias("n")), "chunk-blocks")
    sizes = counts.groupBy("file", "chunk_id").agg(F.sum("n").alias("n"))
    before = sizes.select("file", "chunk_id", F.coalesce(F.sum("n").over(_earlier(["file"], "chunk_id")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(_earlier(["file", "chunk_id"], "_block")), F.lit(0))
    offsets = counts.select("file", "chunk_id", "_block", inside.alias("_inside")).join(before, ["file", "chunk_id"])
    placed = keyed.join(offsets, ["file", "chunk_id", "_block"])
    of_chunk = F.col("_inside") + F.col("_nth")
    begins = F.col("_before") + of_chunk - F.pmod(of_chunk, F.lit(piece))
    return placed.withColumn("pack_id", F.floor(begins / target) + 1).select(*chunked.columns, "pack_id")


def chunk_table(chunked: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """One row per chunk: where it begins and ends, its times, and how many entries and of which level it has."""
    return chunked.groupBy("file", chunk).agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.count("*").alias("n_lines"), *[F.count_if(F.col("level") == name).alias(f"n_{name.lower()}") for name in LEVELS],
    )


def pack_texts(packed: DataFrame) -> DataFrame:
    """``file, pack_id, first_line, last_line, start, end, n_lines, n_<level>, text, tokens``: a text for each pack.

    A heading with lines, times and levels is followed by the distinct messages in order of their first
    entry, with how often they occur. A pack's size is bounded, so its messages fit one row.
    """
    packed = materialize(packed.select("file", "line", "pos", "ts", "level", "message", "pack_id"), "packed")
    table = chunk_table(packed, "pack_id")
    messages = packed.groupBy("file", "pack_id", "message").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "message", "n")))
    shown = F.transform(ordered, lambda m: F.concat(F.when(m["n"] > 1, F.concat(m["n"].cast("string"), F.lit("x "))).otherwise(""), m["message"]))
    bodies = messages.groupBy("file", "pack_id").agg(F.array_join(shown, "\n").alias("_body"))

    def moment(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    levels = F.concat_ws(
        ", ",
        *[F.when(F.col(f"n_{name.lower()}") > 0, F.concat(F.lit(f"{name} "), F.col(f"n_{name.lower()}").cast("string"))) for name in reversed(LEVELS)],
    )
    heading = F.concat(
        F.col("file"), F.lit(", lines "), F.col("first_line").cast("string"), F.lit(" to "), F.col("last_line").cast("string"),
        F.coalesce(F.concat(F.lit(", "), moment("start"), F.lit(" to "), moment("end")), F.lit("")), F.lit(": "), levels, F.lit("\n"),
    )
    text = F.concat(heading, F.col("_body"))
    return table.join(bodies, ["file", "pack_id"]).withColumn("text", text).drop("_body").withColumn("tokens", estimate_tokens(F.col("text")))
