"""Chat formatting by perspective rotation.

Every conversation is rendered once for each participant: with that speaker as the assistant, all
others as users with their names, and a mask that covers what the assistant says, its end mark
included. System messages are no participant's and stay what they are.

A conversation is cut into segments of ``SEGMENT`` messages, so that a very long one is neither one
row nor one task: places in a conversation come from a range-partitioned sort and the sizes of its
parts, and segments are gathered by conversation and number.

Defined cases: messages are ordered by turn (null first), then speaker and text, and repeated rows
are repeated messages; a null speaker is a participant with an empty name, a null text an empty
message; rows with a null conversation are one conversation; a conversation without participants
(system messages only) gives no rows; a speaker who is silent in a segment has an empty mask there;
an empty table gives an empty result. Marks inside a message are broken up by a blank. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.functions.text import bind
from timberline.llm.common import salted_join
from timberline.session import materialize

SEGMENT = 64
SYSTEM = "system"
BEGIN, END = "<|begin|>", "<|end|>"


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with their place in the conversation, from 0."""
    order = ["key", "turn", "speaker", "text"]
    # monotonically_increasing_id numbers the rows of a part in its low 33 bits
    sorted_rows = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "messages")
    parts = parts.withColumn("_part", F.shiftright("_id", 33))
    sizes = parts.groupBy("key", "_part").agg(F.count("*").alias("n"), F.min("_id").alias("low"))
    # at most one row for each part that a conversation reaches into
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("key", "_part", (before - F.col("low")).alias("shift"))
    placed = salted_join(parts, starts, ["key", "_part"], ["_id"])
    return placed.withColumn("place", F.col("_id") + F.col("shift")).drop("_id", "_part", "shift")


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _rendered(messages: Column, viewer: Column) -> Column:
    """Struct of text, mask and number of own messages."""

    def piece(m: Column) -> Column:
        own = m["speaker"] == viewer
        head = F.when(m["system"], F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user "), _clean(m["speaker"])))
        return F.struct(
            F.concat(F.lit(BEGIN), head, F.lit("\n")).alias("head"), F.concat(_clean(m["text"]), F.lit(END + "\n")).alias("body"),
            (own & ~m["system"]).alias("own"),
        )

    def joined(pieces: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("mask"))

        def add(acc: Column, p: Column) -> Column:
            body = acc["at"] + F.length(p["head"])
            end = body + F.length(p["body"])
            span = F.array(F.struct(body.alias("start"), (end - 1).alias("end")))
            return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

        return F.struct(
            F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
            F.aggregate(pieces, start, add)["mask"].alias("mask"),
        )

    return bind(F.transform(messages, piece), joined)


def perspectives(
    messages: DataFrame, conversation_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    system: str = SYSTEM, segment: int = SEGMENT,
) -> DataFrame:
    """(conv_id, speaker, segment, n_turns, text, mask) for every participant and segment."""
    own = messages.select(
        F.xxhash64(messages[conversation_col]).alias("key"), messages[conversation_col].alias("conv_id"), messages[turn_col].alias("turn"),
        F.coalesce(messages[speaker_col].cast("string"), F.lit("")).alias("speaker"),
        F.coalesce(messages[text_col], F.lit("")).alias("text"),
    ).withColumn("system", F.col("speaker") == system)
    placed = numbered(own).withColumn("segment", F.floor(F.col("place") / segment))
    gathered = placed.groupBy("key", "conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "text", "system"))).alias("messages")
    )
    viewers = own.where(~F.col("system")).select("key", F.col("speaker").alias("viewer")).distinct()
    seen = salted_join(gathered, viewers, ["key"], ["segment"])
    return seen.select(
        "conv_id", F.col("viewer").alias("speaker"), "segment", F.size("messages").cast("bigint").alias("n_turns"),
        _rendered(F.col("messages"), F.col("viewer")).alias("r"),
    ).select("conv_id", "speaker", "segment", "n_turns", "r.text", "r.mask")
