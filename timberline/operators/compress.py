"""A log compressed to a severity-ranked summary within a token budget.

``compress_logs`` works on the whole input or, with ``by``, on each group (source, hour,
...) in one job: redaction, template mining, and one summary document per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from timberline.functions import tokens as tk
from timberline.functions.levels import LEVELS, UNKNOWN, level_name, level_ordinal
from timberline.functions.text import estimate_tokens, truncate
from timberline.operators import templates as tp
from timberline.operators.redact import redact_entries, redacted_type_counts, redacted_values
from timberline.operators.toplists import leading
from timberline.session import discard, materialize
from timberline.sources.text import with_sequence

# Fixed values of the budget and the document.
TOKEN_LIMIT = 8_000
RESERVED_TOKENS = 200
# the shortest formatted template has 25 bytes
MIN_TEMPLATE_TOKENS = 6
EXAMPLE_WIDTH = 120
TITLE = "=== Log Analysis Summary ===\n\n"
SECTIONS = ("=== Error Summary ===\n", "=== Warning Summary ===\n", "=== Top Info Patterns ===\n")
NO_ENTRIES = "No log entries to analyze."

_ALL = "_all"
_HEAD = 3


def first_match(keys: DataFrame, templates: DataFrame, group: Sequence[str]) -> DataFrame:
    """``*group, key, template_id``: each key's most frequent template that matches it fully.

    A template matches when it has as many tokens and each is the key's or a wildcard.
    Rather than compare all pairs, a key looks up the wildcard shapes that occur under
    its at most eight possible heads, and then the masked key itself by equality.
    """
    tokens = F.col("tokens")
    head = F.array_join(F.slice(tokens, 1, _HEAD), " ")
    tail = F.slice(tokens, F.lit(_HEAD + 1), F.greatest(F.size(tokens) - _HEAD, F.lit(0)))
    mask = F.array_join(F.transform(tail, lambda t: F.when(t == tk.WILDCARD, "*").otherwise("=")), "")
    shaped = templates.select(
        *group, "template_id", "pattern", "count", "first_seq",
        F.size(tokens).alias("_len"), head.alias("_head"), mask.alias("_mask"),
    )
    shapes = shaped.select(*group, "_len", "_head", "_mask").distinct()

    words = F.split("key", " ")
    heads = F.array(F.lit(""))
    for i in range(_HEAD):
        word = F.get(words, F.lit(i))
        heads = F.when(word.isNull(), heads).otherwise(_extended(heads, word))
    key_tail = F.slice(words, F.lit(_HEAD + 1), F.greatest(F.size(words) - _HEAD, F.lit(0)))
    # few heads meet a shape, so the other tokens are cut behind the join
    probes = keys.select(
        *group, "key", F.size(words).alias("_len"), F.explode(F.array_distinct(heads)).alias("_head")
    )
    masked_tail = F.array_join(
        F.transform(
            F.col("_tail"),
            lambda w, i: F.when(F.substr(F.col("_mask"), i + 1, F.lit(1)) == "*", tk.WILDCARD).otherwise(w),
        ),
        " ",
    )
    pattern = F.when(F.size("_tail") == 0, F.col("_head")).otherwise(
        F.concat(F.col("_head"), F.lit(" "), masked_tail)
    )
    rank = F.struct(
        (-F.col("count")).alias("rank"), F.col("first_seq"), F.col("template_id")
    )
    return (
        probes.join(shapes, [*group, "_len", "_head"])
        .select(*group, "key", "_head", "_mask", key_tail.alias("_tail"))
        .select(*group, "key", pattern.alias("pattern"))
        .join(shaped, [*group, "pattern"])
        .groupBy(*group, "key")
        .agg(F.min(rank).alias("best"))
        .select(*group, "key", F.col("best.template_id").alias("template_id"))
    )


def _extended(heads: Column, word: Column) -> Column:
    """Each head followed by the word, and by a wildcard."""

    def both(head: Column) -> Column:
        return F.transform(
            F.array(word, F.lit(tk.WILDCARD)),
            lambda w: F.when(head == "", w).otherwise(F.concat(head, F.lit(" "), w)),
        )

    return F.flatten(F.transform(heads, both))


def summarize_templates(
    mined: tp.Mined, group: Sequence[str], compat: bool = False
) -> DataFrame:
    """Templates with at least one matching line: level, first and last time added.

    The level is the highest known one; ``compat`` keeps UNKNOWN throughout, as an
    ordinal comparison starting there would.
    """
    keys = mined.keys.groupBy(*group, "key").agg(
        F.max("level_ord").alias("level_ord"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    matched = first_match(keys, mined.templates, group)
    highest = F.lit(None).cast("int") if compat else F.max("level_ord")
    found = (
        keys.join(matched, [*group, "key"])
        .groupBy(*group, "template_id")
        .agg(
            F.coalesce(level_name(highest), F.lit(UNKNOWN)).alias("level"),
            F.min("first_ts").alias("first_seen"),
            F.max("last_ts").alias("last_seen"),
        )
    )
    return mined.templates.join(found, [*group, "template_id"])


def priority_score(level: Column, count: Column, compat: bool = False) -> Column:
    """Level ordinal * 1000 + count; UNKNOWN weighs least (``compat``: most)."""
    weight = level_ordinal(level)
    if not compat:
        weight = F.when(level == UNKNOWN, -1).otherwise(weight)
    return weight * 1000 + count


def section_of(level: Column) -> Column:
    """0 errors, 1 warnings, 2 others."""
    return F.when(level.isin("FATAL", "ERROR"), 0).when(level == "WARN", 1).otherwise(2)


def format_template(level: Column, pattern: Column, count: Column, examples: Column) -> Column:
    first = F.concat(
        F.lit("["), level, F.lit("] "), pattern, F.lit(" ("), count.cast("string"),
        F.lit(" occurrences)\n"),
    )
    lines = F.transform(
        examples, lambda e: F.concat(F.lit("    - "), truncate(e, EXAMPLE_WIDTH), F.lit("\n"))
    )
    return F.concat(
        first,
        F.when(F.size(examples) > 0, F.concat(F.lit("  Examples:\n"), F.array_join(lines, "")))
        .otherwise(""),
    )


def compression_ratio(total_lines: Column, total_templates: Column) -> Column:
    return F.when(total_templates > 0, total_lines / total_templates).otherwise(F.lit(1.0))


def within_budget(output: DataFrame) -> DataFrame:
    return output.withColumn("within_budget", F.col("token_count") <= F.col("token_limit"))


def templates_by_level(output: DataFrame, level: str) -> DataFrame:
    """The included templates of one level, one row each."""
    by = output.columns[: output.columns.index("summary")]
    return output.select(
        *by, F.inline(F.filter("templates", lambda t: t["level"] == level.upper()))
    )


def _named(group: Sequence[str], by: Sequence[str]) -> list[Column]:
    """Internal group columns under the caller's names."""
    return [F.col(inner).alias(outer) for inner, outer in zip(group, by)]


def _header(row: dict[str, Column]) -> Column:
    def moment(ts: Column) -> Column:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    return F.concat(
        F.lit(TITLE),
        F.when(
            row["start"].isNotNull(),
            F.concat(F.lit("Time Range: "), moment(row["start"]), F.lit(" to "), moment(row["end"]), F.lit("\n")),
        ).otherwise(""),
        F.lit("Total Lines: "), row["total_lines"].cast("string"),
        F.lit("\nUnique Patterns: "), row["total_templates"].cast("string"), F.lit("\n"),
        F.when(
            row["redacted_count"] > 0,
            F.concat(F.lit("Sensitive Values Redacted: "), row["redacted_count"].cast("string"), F.lit("\n")),
        ).otherwise(""),
        F.lit("\n"),
    )


def _documents(
    totals: DataFrame,
    candidates: DataFrame,
    group: Sequence[str],
    by: Sequence[str],
    token_limit: int,
    compat: bool,
) -> DataFrame:
    """One row per group from its totals and its (bounded) candidate templates.

    Sections are filled in turn; each takes templates in order until the first that
    does not fit, and the running token total carries over to the next section.
    """
    available = F.lit(token_limit - RESERVED_TOKENS)
    per_group = candidates.groupBy(*group).agg(
        *[
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("_section") == s,
                        F.struct(
                            "_nth", "_cum", "_text", "pattern", "count", "level", "examples",
                            "first_seen", "last_seen",
                        ),
                    )
                )
            ).alias(f"_section_{s}")
            for s in range(len(SECTIONS))
        ],
    )
    df = totals.join(per_group, list(group), "left")
    row = {c: F.col(c) for c in ("start", "end", "total_lines", "total_templates", "redacted_count")}
    df = df.withColumn("_body", _header(row)).withColumn("_used", estimate_tokens(F.col("_body")))
    included = []
    for s, title in enumerate(SECTIONS):
        listed = F.col(f"_section_{s}")
        opened = F.size(listed) > 0
        if s > 0:
            opened = opened & (F.col("_used") < available)
        taken = F.when(opened, F.filter(listed, lambda t: F.col("_used") + t["_cum"] <= available))
        df = df.withColumn(f"_taken_{s}", taken)
        taken = F.col(f"_taken_{s}")
        text = F.concat(
            F.lit(title), F.array_join(F.transform(taken, lambda t: t["_text"]), ""), F.lit("\n")
        )
        df = df.withColumn("_body", F.concat("_body", F.coalesce(text, F.lit("")))).withColumn(
            "_used",
            F.col("_used")
            + F.coalesce(F.array_max(F.transform(taken, lambda t: t["_cum"])), F.lit(0)),
        )
        included.append(F.coalesce(taken, F.filter(listed, lambda t: F.lit(False))))

    if compat:
        shown = F.lit("0")
    else:
        fixed = F.octet_length("_body") + len(f"Token Count: ~ / {token_limit}\n")
        guess = F.length(F.floor(fixed / 4).cast("string"))
        shown = F.floor((fixed + guess) / 4).cast("string")
    footer = F.concat(F.lit("Token Count: ~"), shown, F.lit(f" / {token_limit}\n"))
    empty = F.col("total_lines") == 0
    kept = F.transform(
        F.concat(*included),
        lambda t: F.struct(
            *[t[c].alias(c) for c in ("pattern", "count", "level", "examples", "first_seen", "last_seen")]
        ),
    )
    none = F.array().cast(
        "array<struct<pattern:string,count:bigint,level:string,examples:array<string>,"
        "first_seen:timestamp,last_seen:timestamp>>"
    )
    df = df.withColumn(
        "summary", F.when(empty, NO_ENTRIES).otherwise(F.concat("_body", footer))
    ).withColumn("templates", F.coalesce(kept, none))
    n = F.size("templates").cast("bigint")
    return df.select(
        *_named(group, by),
        "summary",
        "start",
        "end",
        "total_lines",
        "total_templates",
        "templates",
        "redacted_count",
        n.alias("included_templates"),
        (F.col("total_lines") / (n + 1)).alias("metadata_ratio"),
        F.when(empty, F.lit(0)).otherwise(estimate_tokens(F.col("summary"))).cast("bigint").alias("token_count"),
        F.lit(token_limit).cast("bigint").alias("token_limit"),
    )


class Compressed:
    """``output``: one row per group; ``summaries``: all its templates; ``mined``: the mining result."""

    def __init__(
        self, output, summaries, mined, entries, group, by, patterns, redaction, hash_len
    ):
        self.output, self.summaries, self.mined = output, summaries, mined
        self._entries, self._group, self._by = entries, group, by
        self._patterns, self._redaction, self._hash_len = patterns, redaction, hash_len

    def stats(self) -> DataFrame:
        """Counters per group, including templates per level among those included."""

        def of(level: str) -> Column:
            return F.size(F.filter("templates", lambda t: t["level"] == level)).cast("bigint")

        return self.output.select(
            *self._by,
            F.col("total_lines").alias("input_lines"),
            F.col("included_templates").alias("output_templates"),
            "redacted_count",
            "token_count",
            "token_limit",
            compression_ratio(F.col("total_lines"), F.col("total_templates")).alias("compression_ratio"),
            (F.col("token_count") <= F.col("token_limit")).alias("within_budget"),
            *[of(name).alias(f"{name.lower()}_count") for name in reversed(LEVELS[:-1])],
        )

    def template_lineage(self) -> DataFrame:
        """``*by, template_id, pattern, count`` of every mined template."""
        return self.mined.templates.select(
            *_named(self._group, self._by), "template_id", "pattern", "count"
        )

    def redacted_values(self) -> DataFrame:
        columns = [c for c in ("message", "raw") if c in self._entries.columns]
        values = redacted_values(
            self._entries, columns, self._patterns, self._group, self._hash_len
        )
        values = values.select(*_named(self._group, self._by), "value", "type", "placeholder")
        return values if self._redaction else values.limit(0)

    def redacted_types(self) -> DataFrame:
        return redacted_type_counts(self.redacted_values(), self._by)


def compress_logs(
    entries: DataFrame,
    by: Sequence[str] = (),
    token_limit: int = TOKEN_LIMIT,
    redaction: bool = True,
    patterns: Sequence[str] | None = None,
    depth: int = tp.DEPTH,
    threshold: float = tp.THRESHOLD,
    max_children: int = tp.MAX_CHILDREN,
    mask_placeholders: bool = False,
    hash_len: int = 4,
    compat: bool = False,
) -> Compressed:
    """Redact, mine templates and compress to ``token_limit`` tokens, per group of ``by``.

    ``compat`` reproduces three oddities: all levels UNKNOWN, UNKNOWN first in
    priority, and a token count of 0 in the footer.
    """
    token_limit = token_limit if token_limit > 0 else TOKEN_LIMIT
    by = tuple(by)
    # internal names, as a group column may be called like an entry column
    group = [f"_by_{i}" for i in range(len(by))] or [_ALL]
    columns = [c for c in ("raw", "message", "level", "ts") if c in entries.columns]
    sequenced = with_sequence(entries)
    named = [F.col(outer).alias(inner) for inner, outer in zip(group, by)]
    lines = sequenced.select(*named, "seq", *columns)
    if not by:
        lines = lines.withColumn(_ALL, F.lit(1))
    # parsed and redacted once; mining keeps rows of its own
    narrow = [c for c in ("message", "level", "ts") if c in columns]
    redacted = materialize(
        redact_entries(lines, patterns, redaction, hash_len=hash_len).select(
            *group, "seq", *narrow, "redacted_count"
        ),
        "redacted",
    )
    mined = tp.mine_templates(
        redacted, group, depth, threshold, max_children, mask_placeholders, sums=["redacted_count"]
    )
    discard(redacted)
    summaries = materialize(summarize_templates(mined, group, compat), "summaries")

    per_key = mined.counted.select(*group, "n", "first_ts", "last_ts", "redacted_count")
    if not by:
        # an empty log still gets a document
        nothing = entries.sparkSession.range(1).selectExpr(
            f"int(id + 1) as {_ALL}", "0L as n", "timestamp(null) as first_ts",
            "timestamp(null) as last_ts", "0L as redacted_count",
        )
        per_key = per_key.unionByName(nothing)
    totals = per_key.groupBy(*group).agg(
        F.sum("n").alias("total_lines"),
        F.min("first_ts").alias("start"),
        F.max("last_ts").alias("end"),
        F.sum("redacted_count").alias("redacted_count"),
    )
    n_templates = summaries.groupBy(*group).agg(F.count("*").alias("total_templates"))
    totals = totals.join(n_templates, group, "left").na.fill(0, ["total_templates"])

    # no section can hold more templates than this
    most = token_limit // MIN_TEMPLATE_TOKENS + 1
    section = section_of(F.col("level"))
    score = priority_score(F.col("level"), F.col("count"), compat)
    ranked = leading(
        summaries.withColumn("_section", section).withColumn("_score", score),
        [*group, "_section"],
        [F.desc("_score"), F.asc("first_seq")],
        most,
        ["template_id"],
    )
    shortlist = materialize(ranked, "shortlist")
    text = format_template(F.col("level"), F.col("pattern"), F.col("count"), F.col("examples"))
    in_order = _running(group)
    candidates = (
        shortlist.join(mined.examples_of(shortlist), [*group, "template_id"], "left")
        .withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
        .withColumn("_text", text)
        .withColumn("_cum", F.sum(estimate_tokens(F.col("_text"))).over(in_order))
    )
    output = _documents(totals, candidates, group, by, token_limit, compat)
    return Compressed(output, summaries, mined, lines, group, by, patterns, redaction, hash_len)


def _running(group: Sequence[str]) -> WindowSpec:
    return (
        Window.partitionBy(*group, "_section")
        .orderBy("_nth")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def quick_compress(
    entries: DataFrame, token_limit: int = TOKEN_LIMIT, redaction: bool = True
) -> DataFrame:
    return compress_logs(entries, token_limit=token_limit, redaction=redaction).output
