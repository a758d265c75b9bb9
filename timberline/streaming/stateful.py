"""Windows and template mining on a stream, in event time.

Both wait for the watermark, the latest time seen less ``delay``, so that rows may arrive out of order by that
much; what is later than it is dropped. They append or update what the batch operators give for the rows that were not too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.functions import tokens as tk
from timberline.functions.levels import LEVELS
from timberline.operators import fold
from timberline.operators.stats import level_count_map, share
from timberline.operators.templates import DEPTH, THRESHOLD
from timberline.operators.windows import alignment, is_window_error, window_micros

# the lines that wait for the watermark are one Arrow table
_STATE = "patterns array<string>, counts array<bigint>, firsts array<bigint>, waiting binary"
_CHANGED = "leaf string, idx int, pattern string, count bigint, first_ts timestamp"

cloudpickle.register_pickle_by_value(fold)


def stream_windows(entries: DataFrame, window: str | timedelta, delay: str) -> DataFrame:
    """Streaming ``start, end, count, level_counts, error_count, error_percent`` of the windows that are over.

    For output mode append: a window comes once, when the watermark has passed its end. Windows are cut as in
    ``time_windows``; empty ones, and the change from the window before, need the rows around them and are left to what reads
    the result. Entries without a time are left out.
    """
    width = window_micros(window)
    cut = F.window("ts", f"{width} microseconds", startTime=f"{alignment(width)} microseconds")
    counted = (
        entries.where(F.col("ts").isNotNull()).withWatermark("ts", delay).groupBy(cut.alias("cut"))
        .agg(
            F.count("*").alias("count"), F.count_if(is_window_error()).alias("error_count"),
            *[F.count_if(F.col("level") == name).alias(f"n_{name}") for name in LEVELS],
        )
    )
    return counted.select(
        F.col("cut.start").alias("start"), F.col("cut.end").alias("end"), "count",
        level_count_map(lambda name: F.col(f"n_{name}")).alias("level_counts"), "error_count",
        share(F.col("error_count") * 100, F.col("count")).alias("error_percent"),
    )


def leaf_of(key: Column, depth: int = DEPTH) -> Column:
    """The leaf of the routing tree: the number of tokens and the first ones."""
    words = F.split(key, " ")
    first = F.transform(F.slice(words, 1, max(depth - 1, 0)), lambda t: F.when(t == tk.VARIABLE, tk.WILDCARD).otherwise(t))
    return F.concat_ws(" ", F.size(words).cast("string"), first)


def _miner(threshold: float):
    schema = pa.schema([("micros", pa.int64()), ("message", pa.large_string()), ("key", pa.large_string())])

    def packed(lines: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(lines)
        return sink.getvalue().to_pybytes()

    def mine(leaf: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        patterns, counts, firsts, held = state.get if state.exists else ([], [], [], b"")
        counts, firsts = list(counts), list(firsts)
        lines = [pa.ipc.open_stream(held).read_all()] if held else [schema.empty_table()]
        for part in rows:
            fresh = pa.Table.from_pandas(part[schema.names], schema, preserve_index=False)
            lines.append(fresh.filter(pc.greater_equal(fresh["micros"], watermark * 1000)))
        lines = pa.concat_tables(lines)
        over = pc.less(lines["micros"], watermark * 1000)
        # nothing earlier than the watermark can come any more, so these are in their final order
        ready, waiting = lines.filter(over).sort_by([("micros", "ascending"), ("message", "ascending"), ("key", "ascending")]), lines.filter(pc.invert(over))
        templates = fold.Leaf.restored(threshold, list(patterns))
        keys = ready["key"].combine_chunks().dictionary_encode()
        words = [k.split(" ") for k in keys.dictionary.to_pylist()]
        places, first = templates.add_all(words, keys.indices.to_numpy(zero_copy_only=False))
        times = ready["micros"].to_numpy()
        firsts.extend(times[first].tolist())
        counts.extend([0] * len(first))
        more = np.bincount(places, minlength=len(counts))
        counts = [n + m for n, m in zip(counts, more.tolist(), strict=True)]
        patterns = templates.patterns()
        state.update((patterns, counts, firsts, packed(waiting)))
        if waiting.num_rows:
            state.setTimeoutTimestamp(max(watermark + 1, pc.min(waiting["micros"]).as_py() // 1000))
        done = np.flatnonzero(more).tolist()
        if done:
            yield pd.DataFrame(
                {
                    "leaf": [leaf[0]] * len(done), "idx": done, "pattern": [patterns[i] for i in done], "count": [counts[i] for i in done],
                    "first_ts": pd.to_datetime([firsts[i] for i in done], unit="us", utc=True),
                }
            )

    return mine


def stream_templates(
    entries: DataFrame, delay: str, depth: int = DEPTH, threshold: float = THRESHOLD, mask_placeholders: bool = False
) -> DataFrame:
    """Streaming ``leaf, idx, pattern, count, first_ts`` of every template that changed; for output mode update.

    Messages are mined in the order of their time, equal times in the order of the message, once the watermark has
    passed them. The templates of a leaf of the routing tree, and the messages that wait, are its state; the last row of
    each ``leaf, idx`` (the one with the highest count) is the template as it stands. Nodes of the tree have no limit of children here,
    as what came first in a full node is not known before the end. Messages without a time or without tokens are left out.
    """
    key = tk.message_key(F.col("message"), mask_placeholders)
    rows = (
        entries.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
        .select("ts", F.unix_micros("ts").alias("micros"), "message", key.alias("key")).where("key <> ''")
        .withColumn("leaf", leaf_of(F.col("key"), depth))
    )
    return rows.groupBy("leaf").applyInPandasWithState(
        _miner(threshold), _CHANGED, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def current_templates(changes: DataFrame) -> DataFrame:
    """The templates as they stand, from all rows that ``stream_templates`` has given."""
    last = F.max_by(F.struct("pattern", "count", "first_ts"), "count").alias("last")
    return changes.groupBy("leaf", "idx").agg(last).select("last.pattern", "last.count", "last.first_ts")
