"""What changed between two logs: new, gone and changed message templates.

The logs are mined on their own, so one log's template may have a wildcard where the other's has a token. Two
templates are aligned if they have as many tokens and agree wherever both have one. Rather than compare all
pairs, a template is masked once for each wildcard shape that the other log has at its length, and aligned templates
are those whose masked texts are equal: an equality join whose size grows with templates times shapes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import tokens as tk
from timberline.operators.templates import mine_templates
from timberline.session import materialize

# a rate changed if it grew or shrank by this factor
FACTOR = 2.0


def _shape(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t == tk.WILDCARD, "*").otherwise("=")), "")


def _wild(shape: Column, i: Column) -> Column:
    return F.substr(shape, i + 1, F.lit(1)) == "*"


def _side(templates: DataFrame, side: str) -> DataFrame:
    total = templates.agg(F.sum("count")).first()[0]
    return materialize(
        templates.select(
            F.col("pattern").alias(f"{side}_pattern"), "tokens", F.size("tokens").alias("n"), _shape(F.col("tokens")).alias(f"{side}_shape"),
            F.col("count").alias(f"{side}_count"), (F.col("count") / F.lit(total)).alias(f"{side}_share"),
        ),
        f"templates-{side}",
    )


def _masked(templates: DataFrame, side: str, other: DataFrame, other_side: str) -> DataFrame:
    """Each template with every shape of the other log at its length, and its text under both."""
    shapes = other.select("n", f"{other_side}_shape").distinct()
    joined = templates.join(shapes, "n")
    theirs = F.col(f"{other_side}_shape")
    masked = F.transform("tokens", lambda t, i: F.when(_wild(theirs, i), tk.WILDCARD).otherwise(t))
    joined = joined.withColumn("masked", masked).withColumn("agreed", F.size(F.filter("masked", lambda t: t != tk.WILDCARD)))
    # without a token in common only equal templates are aligned, those of nothing but wildcards
    bare = (F.col("agreed") > 0) | (~F.contains(F.col(f"{side}_shape"), F.lit("=")) & ~F.contains(theirs, F.lit("=")))
    return joined.where(bare).withColumn("text", F.array_join("masked", " ")).drop("masked", "tokens")


def aligned_templates(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables with their shapes, and the pairs that are the best one of either template."""
    before, after = _side(before, "before"), _side(after, "after")
    keys = ["n", "before_shape", "after_shape", "agreed", "text"]
    pairs = _masked(before, "before", after, "after").join(_masked(after, "after", before, "before"), keys)
    same = F.col("before_pattern") == F.col("after_pattern")

    def best(side: str, other: str) -> Column:
        order = [F.desc(same), F.desc("agreed"), F.desc(f"{other}_count"), F.asc(f"{other}_pattern")]
        return F.row_number().over(Window.partitionBy(f"{side}_pattern").orderBy(*order)) == 1

    chosen = pairs.withColumn("_b", best("before", "after")).withColumn("_a", best("after", "before")).where("_b or _a")
    return before, after, materialize(chosen.drop("_b", "_a", "n", "agreed", "text"), "aligned")


def diff_templates(before: DataFrame, after: DataFrame, factor: float = FACTOR) -> DataFrame:
    """``status, before_pattern, after_pattern, before_count, after_count, before_share, after_share, change``.

    The tables have ``pattern, tokens, count``. A pair of aligned templates is ``changed`` if the patterns differ, or their
    shares of the lines by ``factor`` or more, else ``same``; a pair is listed if it is the best one (most tokens in
    common, then most lines) for either side, so that a template which was split or joined shows up with all its parts.
    Templates that are aligned with none are ``new`` or ``gone``. ``change`` is the quotient of the shares. An empty
    log makes all templates of the other one new or gone.
    """
    if factor <= 1:
        raise ValueError("the factor must exceed 1")
    before, after, pairs = aligned_templates(before, after)
    names = [f"{side}_{what}" for what in ("pattern", "count", "share") for side in ("before", "after")]
    change = F.col("after_share") / F.col("before_share")
    moved = (F.col("before_pattern") != F.col("after_pattern")) | (change >= factor) | (change * factor <= 1)
    out = pairs.select(F.when(moved, "changed").otherwise("same").alias("status"), *names)
    for status, side, table in (("gone", "before", before), ("new", "after", after)):
        alone = table.join(pairs.select(f"{side}_pattern"), f"{side}_pattern", "left_anti")
        own = [F.col(c) if c.startswith(side) else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in names]
        out = out.unionByName(alone.select(F.lit(status).alias("status"), *own))
    return out.withColumn("change", change)


def diff_logs(before: DataFrame, after: DataFrame, factor: float = FACTOR, **settings: object) -> DataFrame:
    """Mine both logs (``settings`` as in ``mine_templates``) and compare their templates."""
    mined: Sequence[DataFrame] = [mine_templates(log, **settings).templates for log in (before, after)]
    return diff_templates(*mined, factor)
