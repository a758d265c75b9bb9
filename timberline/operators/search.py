"""Search with context, counts per file, and the last entries of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import materialize
from timberline.sources.text import with_positions

# entries per block when a file is worked on in pieces
BLOCK = 8_192


def search(entries: DataFrame, keep: Column) -> DataFrame:
    return entries.where(keep)


def count_matches(
    entries: DataFrame, keep: Column, files: DataFrame | None = None
) -> DataFrame:
    """``file, count``; files without a match are listed with 0.

    ``files`` (column ``file``) adds files that have no entries at all.
    """
    counts = entries.groupBy("file").agg(F.count_if(keep).alias("count"))
    if files is None:
        return counts
    return files.select("file").distinct().join(counts, "file", "left").na.fill(0, ["count"])


def search_context(
    entries: DataFrame, keep: Column, context: int, groups: bool = False
) -> DataFrame:
    """Entries within ``context`` entries of a match in the same file, as ``matched`` marks.

    With ``groups``, ``group_id`` numbers the runs per file: a match more than
    ``context`` entries after the previous one starts a new run, and an entry
    belongs to the match before it if that is near enough, else to the next.

    Files are cut into blocks of entries; rows near an edge are copied to the
    neighbouring block, so every block decides on its own, and only blocks near a
    match are shuffled at all.
    """
    if context < 0:
        raise ValueError("context must not be negative")
    hit = F.coalesce(keep, F.lit(False))
    columns = entries.columns
    if context == 0 and not groups:
        return entries.where(hit).withColumn("matched", F.lit(True))

    width = max(BLOCK, 4 * context)
    numbered = with_positions(entries).withColumn("matched", hit)

    def block(offset: int) -> Column:
        return F.floor((F.col("pos") + F.lit(offset)) / F.lit(width))

    def in_blocks(df: DataFrame) -> DataFrame:
        near = F.sequence(block(-context), block(context))
        return df.withColumn("_home", block(0)).withColumn("_block", F.explode(near))

    busy = materialize(
        in_blocks(numbered.where("matched").select("file", "pos"))
        .select("file", "_block")
        .distinct(),
        "busy-blocks",
    )
    rows = in_blocks(numbered).join(busy, ["file", "_block"], "left_semi")

    ordered = Window.partitionBy("file", "_block").orderBy("pos")
    around = F.max("matched").over(ordered.rowsBetween(-context, context))
    after = F.max("matched").over(ordered.rowsBetween(-context, 0))
    # (with no context every match is a run of its own)
    earlier = F.lit(False)
    if context:
        recent = F.max("matched").over(ordered.rowsBetween(-context, -1))
        earlier = F.coalesce(recent, F.lit(False))
    marked = (
        rows.withColumn("_near", around)
        .withColumn("_after", after)
        .withColumn("_start", F.when(F.col("matched") & ~earlier, 1).otherwise(0))
        .where("_near and _block = _home")
    )
    if not groups:
        return marked.select(*columns, "matched")

    starts = materialize(
        marked.groupBy("file", "_block").agg(F.sum("_start").alias("n")), "run-starts"
    )
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select(
        "file", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    running = F.sum("_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_running", running)
        .join(offsets, ["file", "_block"])
        .select(
            *columns,
            "matched",
            (
                F.col("_offset") + F.col("_running") + F.when(F.col("_after"), 0).otherwise(1)
            ).alias("group_id"),
        )
    )


def last_entries(entries: DataFrame, n: int, keep: Column | None = None) -> DataFrame:
    """The last ``n`` entries of each file among those that pass ``keep``."""
    if n < 0:
        raise ValueError("n must not be negative")
    kept = entries if keep is None else entries.where(keep)
    columns = entries.columns
    # count entries per block of lines, and look only at blocks that reach the last n
    keyed = kept.withColumn("_block", F.floor(F.col("line") / F.lit(BLOCK)))
    counts = materialize(keyed.groupBy("file", "_block").agg(F.count("*").alias("n")), "tail-blocks")
    later = Window.partitionBy("file").orderBy(F.desc("_block")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    wanted = counts.select(
        "file", "_block", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("_later")
    ).where(F.col("_later") < n)
    newest = Window.partitionBy("file", "_block").orderBy(F.desc("line"))
    return (
        keyed.join(wanted, ["file", "_block"])
        .withColumn("_nth", F.col("_later") + F.row_number().over(newest))
        .where(F.col("_nth") <= n)
        .select(*columns)
    )
