"""Merkle dataset manifest with nested-interval labels.

Every row is a leaf with a rank in its source. While a source has several nodes, each run of
``FAN_OUT`` consecutive ones becomes their hash; what remains is the source's subroot, and the
subroots form one tree of the same kind, whose top is the root of the dataset.

A node carries the interval [lo, hi] of the leaf ranks it covers and that of its parent, [plo, phi].
All of a proof follows from these intervals:

* Nodes are built and kept in bands of ``BAND`` levels. A row of a band is one subtree, the bucket
  of its lowest level, and holds at most 3 + 9 + 27 + 81 nodes, so no group grows with the data. Each
  band is a hash aggregate of the one below, an 81st of its size.
* Containment: a rank lies in the subtree of the band above whose bucket is the rank divided by the
  ranks of a subtree there. That bucket is the join key, so ancestors are attached from the top band
  down by equality joins of subtrees, and once, last, to the leaves.
* Interval difference: the siblings on a leaf's path are the nodes whose parent's interval holds the
  rank and whose own does not. Those with the lower interval stand to the left.

Ranks come from a range-partitioned sort; each part's size and first number place its rows, so the
largest source is numbered by many tasks. Texts are read once and never shuffled.

Defined cases: a null field is hashed as ``-``; a null source is a source of its own, before all
others; within a source rows go by id, null ids first, then by leaf hash, so that repeated rows are
leaves of their own next to each other; rows that agree in source, id and leaf are interchangeable,
and each has the proof of its own place. An empty table gives an empty result. A table of one row has
the leaf as root and an empty proof. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import salted_join
from timberline.session import materialize

FAN_OUT = 3
BAND = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PER_TREE = FAN_OUT**BAND
_NODE = "struct<level:int,lo:bigint,hi:bigint,plo:bigint,phi:bigint,digest:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each led by its length in bytes."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[framed(f) for f in fields]))


def _ranked(rows: DataFrame, tree: list[str], order: list[str], rank: str) -> DataFrame:
    """Add ``rank`` from 0 within ``tree`` by ``order``; rows of a hot key are spread by the order."""
    keys = [*tree, *order]
    parts = materialize(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_id", 33))
    runs = parts.groupBy(*tree, "_part").agg(F.count("*").alias("n"), F.min("_id").alias("_low"))
    before = Window.partitionBy(*tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select(*tree, "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    return parts.join(shift, [*tree, "_part"]).withColumn(rank, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def _hash_run(nodes: Column, k: Column) -> Column:
    run = F.slice(nodes, (k * FAN_OUT + 1).cast("int"), FAN_OUT)
    return digest(F.array_join(run, ""))


def _band(nodes: DataFrame, base: int) -> DataFrame:
    """Subtrees over the nodes of level ``base``: ``tree, bucket, size, nodes, top``.

    ``nodes`` has ``tree, idx, digest, size`` (leaves of the tree). Levels stop at the tree's only node.
    """
    bucket = F.floor(F.col("idx") / _PER_TREE)
    rows = nodes.groupBy("tree", "size", bucket.alias("bucket")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("level0")
    )
    for k in range(1, BAND + 1):
        below = F.col(f"level{k - 1}")
        whole = F.col("size") <= FAN_OUT ** (base + k - 1)  # the level below is the tree's only node
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FAN_OUT).cast("int") - 1)
        rows = rows.withColumn(f"level{k}", F.when(whole, below).otherwise(F.transform(runs, lambda i: _hash_run(below, i))))
    every = []
    for k in range(BAND):
        covered, above = FAN_OUT ** (base + k), FAN_OUT ** (base + k + 1)
        first = F.col("bucket") * FAN_OUT ** (BAND - k)

        def node(x: Column, i: Column) -> Column:
            lo = (first + i) * covered
            plo = lo - F.pmod(lo, F.lit(above))
            hi, phi = F.least(lo + covered, "size") - 1, F.least(plo + above, "size") - 1
            return F.struct(F.lit(base + k), lo, hi, plo, phi, x).cast(_NODE)

        kept = F.when(F.col("size") > covered, F.col(f"level{k}")).otherwise(F.array().cast("array<string>"))
        every.append(F.transform(kept, node))
    return rows.select("tree", "bucket", "size", F.concat(*every).alias("nodes"), F.col(f"level{BAND}")[0].alias("top"))


def _with_steps(rows: DataFrame, nodes: str, rank: Column, name: str) -> DataFrame:
    """Add what stands before and after the node that holds ``rank``, for each level of ``nodes``."""
    siblings = F.filter(
        nodes, lambda x: (x["plo"] <= rank) & (rank <= x["phi"]) & ~((x["lo"] <= rank) & (rank <= x["hi"]))
    )

    def side(level: Column, left: bool) -> Column:
        own = F.filter("_siblings", lambda x: (x["level"] == level) & ((x["hi"] < rank) if left else (x["lo"] > rank)))
        return F.array_join(F.transform(own, lambda x: x["digest"]), "")

    # (the levels are those of the nodes, as the last node of a level may be a run of its own, without siblings)
    levels = F.array_distinct(F.transform(nodes, lambda x: x["level"]))
    steps = F.transform(levels, lambda k: F.struct(side(k, True).alias("before"), side(k, False).alias("after")))
    return rows.withColumn("_siblings", siblings).withColumn(name, steps).drop("_siblings")


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest over ``tree, idx, digest``: the lowest subtrees with the steps above them, and the roots.

    The first is ``tree, bucket, nodes, above, root``, the second ``tree, root``.
    """
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("size"))
    nodes = salted_join(leaves.select("tree", "idx", "digest"), sizes, ["tree"], ["idx"])
    bands, roots, base = [], None, 0
    while True:
        band = materialize(_band(nodes, base), "band")
        bands.append(band)
        base += BAND
        done = band.where(F.col("size") <= FAN_OUT**base).select("tree", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionAll(done)
        nodes = band.where(F.col("size") > FAN_OUT**base).select("tree", F.col("bucket").alias("idx"), F.col("top").alias("digest"), "size")
        if nodes.isEmpty():
            break
    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    done = None
    for b in reversed(range(len(bands))):
        covered = FAN_OUT ** (BAND * (b + 1))
        own = bands[b].where(F.col("size") <= covered).select("tree", "bucket", "nodes", no_steps.alias("above"), F.col("top").alias("root"))
        if done is not None:
            # the subtree above holds this one's interval, whose first rank is bucket * covered
            upper = done.select("tree", F.col("bucket").alias("_upper"), F.col("nodes").alias("_nodes"), F.col("above").alias("_above"), "root")
            below = bands[b].where(F.col("size") > covered).withColumn("_upper", F.floor(F.col("bucket") / _PER_TREE))
            held = _with_steps(below.join(upper, ["tree", "_upper"]), "_nodes", F.col("bucket") * covered, "own")
            own = own.unionByName(held.select("tree", "bucket", "nodes", F.concat("own", "_above").alias("above"), "root"))
        done = materialize(own, "subtrees")
    return done, roots


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None,
) -> DataFrame:
    """Leaves with their inclusion proofs: ``id, leaf, subroot, root, steps, folded_root``.

    ``changed`` replaces fields before the leaf that is folded is hashed, to see whether the proof
    still leads to the root; without it the leaf itself is folded. ``steps`` lists, level by level to the
    root, the sibling digests before and after the path's node.
    """
    columns = {name: docs[name] for name in fields}
    leaf = leaf_hash(list(columns.values()))
    # a null group comes before all others, the empty name included
    group = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    other = leaf_hash([(changed or {}).get(name, column) for name, column in columns.items()])
    rows = docs.select(
        docs[id_col].alias("id"), group.alias("tree"), leaf.alias("digest"), (other if changed else F.lit(None).cast("string")).alias("other")
    )
    # rows alike in all that orders them are told apart by where they were read
    leaves = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    ranked = materialize(_ranked(leaves, ["tree"], ["id", "digest", "_row"], "idx").drop("_row"), "ranked")
    subtrees, subroots = _tree(ranked)
    tops = materialize(_ranked(subroots.withColumn("all", F.lit(0)), ["all"], ["tree"], "idx"), "subroots")
    upper, _ = _tree(tops.select(F.lit("").alias("tree"), "idx", F.col("root").alias("digest")))
    upper = upper.select(F.col("bucket").alias("_bucket"), "nodes", "above", F.col("root").alias("top"))
    of_group = _with_steps(tops.withColumn("_bucket", F.floor(F.col("idx") / _PER_TREE)).join(upper, "_bucket"), "nodes", F.col("idx"), "own")
    of_group = of_group.select("tree", F.concat("own", "above").alias("last"), "top")
    attached = salted_join(subtrees, of_group, ["tree"], ["bucket"]).select(
        "tree", "bucket", "nodes", F.concat("above", "last").alias("above"), F.col("root").alias("subroot"), F.col("top").alias("root")
    )
    placed = ranked.withColumn("bucket", F.floor(F.col("idx") / _PER_TREE)).join(materialize(attached, "attached"), ["tree", "bucket"])
    paths = _with_steps(placed, "nodes", F.col("idx"), "own").withColumn("steps", F.concat("own", "above"))
    return paths.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "steps",
        fold(F.coalesce("other", "digest"), F.col("steps")).alias("folded_root"),
    )


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))
