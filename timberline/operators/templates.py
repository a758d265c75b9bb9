"""Log-template mining with a fixed-depth routing tree (the Drain algorithm, He et al. 2017).

Messages are routed by token count and their first ``depth - 1`` tokens to a leaf. In
log order, each joins the leaf's first template that is similar enough, whose differing
positions become wildcards, or founds a new one. The result depends on the order, so a
naive distribution is wrong and a naive grouping puts a whole leaf into one task. Here:

1. Lines shrink to *message keys* (variable tokens masked). Equal keys behave alike in
   routing, similarity and merging, so a hash aggregate over the log keeps one row per
   key: how often, first and last position.
2. Per leaf, the earliest keys are folded in order into templates. A template position
   turns from literal to wildcard once, so storing *when* each did gives the exact state
   of every template at any moment.
3. All keys are checked, in blocks of keys and of templates, against the state at
   their own position. A key that its template already covers changed nothing, and
   leaving it out of the fold was right. Others join the next fold.
4. A key that an earlier template came to capture between its first and last line is
   counted again, split at the moment when that template came near enough.

It ends when every check passes, and then equals the line-by-line result exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import tokens as tk
from timberline.functions.levels import LEVELS, level_ordinal
from timberline.operators import fold
from timberline.operators.toplists import leading
from timberline.session import materialize
from timberline.sources.text import with_sequence

# The defaults, also used in place of invalid values.
DEPTH, THRESHOLD, MAX_CHILDREN = 4, 0.5, 100
MAX_EXAMPLES = 3

# Keys per leaf that the first fold takes; later folds take more.
FIRST_FOLD = 1_000
FOLD_GROWTH = 8

# Keys and templates of a leaf that are compared in one task.
KEY_BLOCK, TEMPLATE_BLOCK = 8_192, 2_048

_NEVER = fold.NEVER
_LANES = 4

# the function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(fold)


class Mined:
    """Templates of a log, and how its message keys map to them.

    ``templates``: ``*by, template_id, pattern, tokens, count, first_seq``
    ``keys``: ``*by, key, first_seq, last_seq, n, level_ord, first_ts, last_ts, template_id``
    ``counted``: the same per key before mining, with messages without tokens and the sums
    """

    def __init__(
        self,
        rows: DataFrame,
        counted: DataFrame,
        keys: DataFrame,
        templates: DataFrame,
        by: tuple[str, ...],
    ):
        self.rows, self.counted, self.keys, self.templates = rows, counted, keys, templates
        self.by = by

    def ordered(self) -> DataFrame:
        """Most frequent first; ties by first occurrence."""
        return self.templates.orderBy(*self.by, F.desc("count"), F.asc("first_seq"))

    def assignments(self) -> DataFrame:
        """Every line with tokens: ``*by, seq, message, template_id, pattern``."""
        spans = self.keys.select(
            *self.by, "key", "template_id", F.col("first_seq").alias("_lo"), F.col("last_seq").alias("_hi")
        ).join(self.templates.select(*self.by, "template_id", "pattern"), [*self.by, "template_id"])
        return (
            self.rows.join(spans, [*self.by, "key"])
            .where(F.col("seq").between(F.col("_lo"), F.col("_hi")))
            .select(*self.by, "seq", "message", "template_id", "pattern")
        )

    def examples_of(self, templates: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
        """``*by, template_id, examples``: first messages of the given templates, at most ``limit``.

        The aggregate kept, per key, the earliest position in each of a few hash
        lanes; the ``limit``-th smallest bounds where the wanted lines can be, so
        only a handful of lines per key are looked at again.
        """
        lanes = F.array_sort(F.array_compact(F.array(*[f"lane_{i}" for i in range(_LANES)])))
        bound = F.coalesce(F.get(lanes, F.lit(limit - 1)), F.col("last_seq"))
        spans = self.keys.join(
            templates.select(*self.by, "template_id"), [*self.by, "template_id"], "left_semi"
        ).select(
            *self.by, "key", "template_id", F.col("first_seq").alias("_lo"), bound.alias("_hi")
        )
        early = self.rows.select(*self.by, "seq", "message", "key").join(spans, [*self.by, "key"])
        first = leading(
            early.where(F.col("seq").between(F.col("_lo"), F.col("_hi"))),
            [*self.by, "template_id"],
            [F.col("seq")],
            limit,
            ["seq"],
        )
        return first.groupBy(*self.by, "template_id").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_nth", "message"))), lambda e: e["message"]
            ).alias("examples")
        )

    def with_examples(self, limit: int = MAX_EXAMPLES) -> DataFrame:
        """Templates with ``examples``."""
        examples = self.examples_of(self.templates, limit)
        return self.templates.join(examples, [*self.by, "template_id"], "left")

    def totals(self) -> DataFrame:
        """``template_count, total_log_count``."""
        grouped = self.templates.groupBy(*self.by) if self.by else self.templates.groupBy()
        return grouped.agg(
            F.count("*").alias("template_count"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("total_log_count"),
        )

    def template(self, template_id: str) -> DataFrame:
        return self.templates.where(F.col("template_id") == template_id)


def template_frequency(entries: DataFrame, placeholders: bool = False) -> DataFrame:
    """``pattern, count`` of the messages with their variable tokens masked."""
    return (
        entries.select(tk.mask_message(F.col("message"), placeholders).alias("pattern"))
        .where("pattern <> ''")
        .groupBy("pattern")
        .agg(F.count("*").alias("count"))
    )


def _count_keys(rows: DataFrame, group: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """One row per key; fixed-width aggregates only, so it stays a hash aggregate."""
    lane = F.pmod(F.hash("seq"), F.lit(_LANES))
    known = F.when(F.col("level_ord") < len(LEVELS) - 1, F.col("level_ord"))
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        *[F.min(F.when(lane == i, F.col("seq"))).alias(f"lane_{i}") for i in range(_LANES)],
        F.max(known).alias("level_ord"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.sum(c).alias(c) for c in sums],
    )


def _route(keys: DataFrame, by: Sequence[str], depth: int, max_children: int) -> DataFrame:
    """Add ``leaf``: the token count and the routing tokens, with overflow as wildcard."""
    words = F.split("key", " ")
    first = F.transform(
        F.slice(words, 1, max(depth - 1, 0)), lambda t: F.when(t == tk.VARIABLE, tk.WILDCARD).otherwise(t)
    )
    keys = keys.withColumn("_path", first).withColumn("leaf", F.size(words).cast("string"))
    crowded = False
    if depth > 1:
        level = F.explode(F.sequence(F.lit(0), F.size("_path") - 1)).alias("_i")
        children = keys.select(*by, "leaf", "_path", level).select(
            *by,
            F.concat_ws(" ", F.col("leaf"), F.slice("_path", F.lit(1), F.col("_i"))).alias("_node"),
            F.get("_path", F.col("_i")).alias("_child"),
        )
        fullest = children.distinct().groupBy(*by, "_node").count().agg(F.max("count"))
        crowded = (fullest.first()[0] or 0) > max_children
    if not crowded:
        return keys.withColumn("leaf", F.concat_ws(" ", "leaf", "_path")).drop("_path")

    # a full node sends new tokens to its wildcard child: keep the first to arrive
    for i in range(depth - 1):
        keys = keys.withColumn("_child", F.get("_path", F.lit(i)))
        arrival = Window.partitionBy(*by, "leaf").orderBy("_seen")
        kept = (
            keys.where("_child is not null")
            .groupBy(*by, "leaf", "_child")
            .agg(F.min("first_seq").alias("_seen"))
            .withColumn("_nth", F.row_number().over(arrival))
            .where(F.col("_nth") <= max_children)
            .select(*by, "leaf", "_child", F.lit(True).alias("_kept"))
        )
        child = F.when(F.col("_child").isNull(), None).when(
            F.col("_kept"), F.col("_child")
        ).otherwise(tk.WILDCARD)
        keys = materialize(
            keys.join(kept, [*by, "leaf", "_child"], "left")
            .withColumn("leaf", F.concat_ws(" ", F.col("leaf"), child))
            .drop("_child", "_kept"),
            "routed",
        )
    return keys.drop("_path")


def _fold(active: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Run the active keys of each leaf in order: one row per template.

    ``idx`` is the creation order in the leaf, ``born`` the position of creation,
    ``init`` the first tokens and ``wild`` the position at which each became a wildcard.
    """
    group = [*by, "leaf"]
    by_type = ", ".join(f"`{c}` {active.schema[c].dataType.simpleString()}" for c in group)
    schema = f"{by_type}, idx int, born bigint, init array<string>, wild array<bigint>"

    ordered = (
        active.select(*group, "key", "first_seq")
        .repartition(*group)
        .sortWithinPartitions(*group, "first_seq")
    )
    return ordered.mapInPandas(fold.folder(tuple(group), threshold), schema)


def _check(keys: DataFrame, templates: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Add ``idx`` (template at the key's position), ``covered``, ``captured`` and ``moment``.

    A leaf's templates and keys are cut into blocks of bounded size; each pair of blocks is compared in one task
    and gives what its templates say about a key, of which the earliest template counts. ``moment`` is when
    a template before it came near; what such a template gets is counted again from there.
    """
    group = [*by, "leaf"]
    base = keys.drop("idx", "covered", "captured", "moment")
    blocks = base.groupBy(*group).agg(F.ceil(F.count("*") / KEY_BLOCK).alias("_blocks"))
    parts = templates.groupBy(*group).agg(F.max("idx").alias("_last"))
    cut = materialize(blocks.join(parts, group), "leaf-blocks")
    every = F.lit(0).cast("bigint")
    of_keys = (
        base.join(cut, group)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")))
        .withColumn("part", F.explode(F.sequence(every, F.floor(F.col("_last") / TEMPLATE_BLOCK))))
        .select(*group, "block", "part", "key", "first_seq", "last_seq")
    )
    of_templates = (
        templates.join(cut, group)
        .withColumn("part", F.floor(F.col("idx") / TEMPLATE_BLOCK))
        .withColumn("block", F.explode(F.sequence(every, F.col("_blocks") - 1)))
        .select(*group, "block", "part", "idx", "born", "init", "wild")
    )
    at = [*group, "block", "part"]
    # the templates of a block come first
    paired = (
        of_keys.unionByName(of_templates, allowMissingColumns=True)
        .repartition(*at).sortWithinPartitions(*at, F.asc_nulls_first("key"), "idx")
    )
    by_type = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in group)
    schema = f"{by_type}, key string, first_seq bigint, part bigint, idx int, covers boolean, moment bigint"
    found = paired.mapInPandas(fold.checker(tuple(group), threshold), schema)
    some = F.col("idx") >= 0
    said = found.groupBy(*group, "key", "first_seq").agg(
        F.min(F.when(some, F.struct("idx", "part", "covers"))).alias("_first"),
        # (a number for each block that has such a template)
        F.collect_list(F.when(F.col("moment") < _NEVER, F.struct("part", "moment"))).alias("_moments"),
    )
    before = F.filter("_moments", lambda m: m["part"] <= F.col("_first.part"))
    said = said.select(
        *group, "key", "first_seq", F.col("_first.idx").alias("idx"), F.coalesce("_first.covers", F.lit(False)).alias("covered"),
        F.array_min(F.transform(before, lambda m: m["moment"])).alias("moment"),
    )
    joined = base.join(said, [*group, "key", "first_seq"], "left")
    return joined.withColumn("covered", F.coalesce("covered", F.lit(False))).withColumn("captured", F.col("moment").isNotNull())


def _activate(keys: DataFrame, group: Sequence[str], limit: int) -> DataFrame:
    """Mark as active the first ``limit`` keys of each leaf that are not covered."""
    waiting = keys.where("not active and not covered").select(*group, "key", "first_seq")
    picked = (
        leading(waiting, group, [F.col("first_seq")], limit, ["key", "first_seq"])
        .drop("_nth")
        .withColumn("_picked", F.lit(True))
    )
    return (
        keys.join(picked, [*group, "key", "first_seq"], "left")
        .withColumn("active", F.col("active") | F.coalesce("_picked", F.lit(False)))
        .drop("_picked")
    )


def _split_captured(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count captured keys again, their lines before and from the moment of the capture on."""
    piece = [*by, "key", "leaf", "active", "_from"]
    captured = keys.where("captured").select(
        *by, "key", "leaf", "active", F.col("first_seq").alias("_from"), F.col("last_seq").alias("_to"), "moment"
    )
    again = rows.join(captured, [*by, "key"]).where(F.col("seq").between(F.col("_from"), F.col("_to")))
    recounted = _count_keys(again.withColumn("_later", F.col("seq") >= F.col("moment")), [*piece, "_later"]).drop("_from", "_later")
    # the next check decides whether the new rows are covered
    return keys.where("not captured").unionByName(recounted.withColumn("covered", F.lit(True)), allowMissingColumns=True)


def _ranked(templates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``nth``: 1-based creation order among all leaves."""
    order = [*by, "born"]
    parts = materialize(
        templates.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_id", 33))
    # the rows of a part are numbered in the low bits, so its size and first number place them all
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*by, "_part").agg(F.count("*").alias("n"), F.min("_id").alias("_low"))
        .select(*by, "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_shift"))
    )
    return (
        parts.join(offsets, [*by, "_part"])
        .withColumn("nth", F.col("_id") + F.col("_shift"))
        .drop("_part", "_id", "_shift")
    )


def mine_templates(
    entries: DataFrame,
    by: Sequence[str] = (),
    depth: int = DEPTH,
    threshold: float = THRESHOLD,
    max_children: int = MAX_CHILDREN,
    mask_placeholders: bool = False,
    sums: Sequence[str] = (),
) -> Mined:
    """Mine templates from ``message`` in the order of ``seq`` (or file and line).

    ``by`` mines each combination of these columns on its own. ``mask_placeholders``
    treats redaction placeholders as variable tokens. ``sums`` are numeric columns to
    add up per message key along the way.
    """
    depth = depth if depth > 0 else DEPTH
    threshold = threshold if 0 < threshold <= 1 else THRESHOLD
    max_children = max_children if max_children > 0 else MAX_CHILDREN
    by = tuple(by)
    group = [*by, "leaf"]

    sequenced = with_sequence(entries)
    present = set(sequenced.columns)
    rows = sequenced.select(
        *by,
        "seq",
        "message",
        (level_ordinal(F.col("level")) if "level" in present else F.lit(len(LEVELS) - 1)).alias(
            "level_ord"
        ),
        (F.col("ts") if "ts" in present else F.lit(None).cast("timestamp")).alias("ts"),
        tk.message_key(F.col("message"), mask_placeholders).alias("key"),
        *sums,
    )
    # parsed and masked once: counting, recounts, examples and assignments read these narrow rows
    rows = materialize(rows, "rows")
    counted = materialize(_count_keys(rows, [*by, "key"], sums), "message-keys")
    # messages without tokens have no template
    keys = _route(counted.where("key <> ''").drop(*sums), by, depth, max_children)
    keys = keys.withColumn("active", F.lit(False)).withColumn("covered", F.lit(False))
    limit = FIRST_FOLD
    refold = True
    while True:
        if refold:
            keys = materialize(_activate(keys, group, limit), "keys")
            templates = materialize(_fold(keys.where("active"), by, threshold), "templates")
            limit *= FOLD_GROWTH
        keys = materialize(_check(keys, templates, by, threshold), "checked")
        left = keys.agg(
            F.count_if(~F.col("covered")).alias("open"), F.count_if("captured").alias("captured")
        ).first()
        if left["captured"]:
            keys = materialize(_split_captured(rows, keys, by), "recounted")
        elif not left["open"]:
            break
        refold = bool(left["open"])

    numbered = _ranked(
        templates.join(
            keys.groupBy(*group, "idx").agg(F.sum("n").alias("count")), [*group, "idx"]
        ),
        by,
    )
    current = F.zip_with(
        "init", "wild", lambda t, w: F.when(w < _NEVER, tk.WILDCARD).otherwise(t)
    )
    numbered = materialize(
        numbered.select(
            *group,
            "idx",
            F.concat(F.lit("T_"), "nth").alias("template_id"),
            F.array_join(current, " ").alias("pattern"),
            current.alias("tokens"),
            "count",
            F.col("born").alias("first_seq"),
        ),
        "numbered",
    )
    mapped = keys.join(numbered.select(*group, "idx", "template_id"), [*group, "idx"]).select(
        *by, "key", "first_seq", "last_seq", "n", "level_ord", "first_ts", "last_ts",
        *[f"lane_{i}" for i in range(_LANES)], "template_id",
    )
    return Mined(rows, counted, mapped, numbered.drop("leaf", "idx"), by)
