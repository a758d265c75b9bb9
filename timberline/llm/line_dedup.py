"""Line dedup with a log-template tree, in DataFrame operations only.

A line's tokens are its words; words with a digit are variable at once, unless fewer than
``MIN_CONSTANTS`` others are left, as numbers alone say nothing of what a line is. The tree has a fixed depth:
the first level is the number of tokens, the next ones the ``DEPTH`` leading tokens. Within a leaf,
the line that most documents have (ties: the earliest document, then the text) leads; lines that
share at least ``SIMILARITY`` of its tokens after the leading ones, variable ones aside, belong to its template, in which
positions that differ are variable. What is left of the leaf finds further templates in the same way, until
all lines lead or follow; a line that follows none is a template of its own. The first ``BLOCK`` lines of a leaf, twice as many in each
round up to ``BLOCKS_MOST``, find their leaders at once, and all lines of the leaf are compared with these.

A template recurs if it stands in at least ``MIN_DOCS`` documents, or ``LONG_MIN_DOCS`` if it has
``LONG_TOKENS`` tokens or more, as a long line does not recur by chance. Recurring lines stay in
the first document that has them and are dropped from all others. A document that loses more than
``MAX_DROPPED`` of its characters is depleted: a copy of earlier ones.

With ``runs``, neighbouring lines are also compared as they are, digits included: a run of lines with
``LONG_TOKENS`` tokens or more that an earlier document has is dropped, whatever the length of its
lines. The shortest runs from and up to each line are enough, as together they cover any longer one.
Blank lines do not end a run.

Defined cases: a null text stays null, a blank one stays as it is; lines of fewer than
``MIN_TOKENS`` tokens are never dropped; the first document is the one with the smallest id, null
last; a line that only documents without an id have leads no template; rows that share an id are one document, whose
texts may differ; repeats of a line within a document stay; an empty table gives an empty result. Only the named columns are
read; the others pass through ``deduplicated``, which refuses a name for its own that is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import bind
from timberline.llm.common import salted_join, squeezed
from timberline.session import discard, materialize

DEPTH = 4
SIMILARITY = 0.6
MIN_TOKENS = 5
MIN_CONSTANTS = 3
MIN_DOCS = 3
LONG_TOKENS = 20
LONG_MIN_DOCS = 2
MAX_DROPPED = 0.7
# lines of a leaf that find their leaders in one row, at first and at most; Spark cuts a window to so many rows before its shuffle
BLOCK = 64
BLOCKS_MOST = 1000


def masked(line: Column) -> Column:
    def variable(line: Column) -> Column:
        # a variable token is three characters
        return bind(F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>"), lambda m: F.when(
            F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
            - (F.length(m) - F.length(F.replace(m, F.lit("<*>"), F.lit("")))) / 3 >= MIN_CONSTANTS, m
        ).otherwise(line))

    line = squeezed(line)
    return F.when(line.rlike("[0-9]"), variable(line)).otherwise(line)


def _lines(docs: DataFrame, depth: int, *more: str) -> DataFrame:
    """(doc_id, line_no, line, key, leaf, n) of lines that are long enough; ``line`` is masked."""
    line = docs.select(
        "doc_id", *more, F.posexplode(F.transform(F.split("text", "\n"), masked)).alias("line_no", "line")
    )
    line = line.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    line = line.where((F.col("n") >= MIN_TOKENS) & (F.col("line") != ""))
    return line.withColumns({
        "key": F.xxhash64("line"),
        "leaf": F.xxhash64("n", F.substring_index("line", " ", depth)),
    })


def _follows(line: Column | str, leader: Column | str, depth: int, similarity: float) -> Column:
    """Whether enough tokens after the leading ones agree, where one of both is constant."""
    rest = [F.slice(F.split(x, " "), F.lit(depth + 1), F.size(F.split(x, " "))) for x in (line, leader)]
    pairs = F.filter(F.arrays_zip(rest[0].alias("x"), rest[1].alias("y")), lambda p: (p["x"] != "<*>") | (p["y"] != "<*>"))
    return F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) >= F.size(pairs) * similarity


def _leaders(members: DataFrame, size: int, depth: int, similarity: float) -> DataFrame:
    """(leaf, place, leader, template) of the lines that lead templates among the first ``size`` of each leaf."""
    order = [F.col("docs").desc(), "carrier", "line", "key"]
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("leaf").orderBy(*order))).where(F.col("place") <= size)
    in_order = F.array_sort(F.collect_list(F.struct("place", F.col("line").alias("leader"), F.col("key").alias("template"))))
    block = first.groupBy("leaf").agg(in_order.alias("lines"))
    led = F.aggregate("lines", F.slice("lines", 1, 0), lambda found, x: F.when(
        F.exists(found, lambda y: _follows(x["leader"], y["leader"], depth, similarity)), found
    ).otherwise(F.concat(found, F.array(x))))
    return block.select("leaf", F.explode(led).alias("x")).select("leaf", "x.*")


def line_templates(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, of, line_no, n, template) of every line that is long enough; ``docs`` has doc_id and text.

    ``of`` is the hash of the text. Lines travel as hashes. Texts are only fetched for leaves with several
    different lines, one carrier document for each line.
    """
    own = docs.withColumn("of", F.xxhash64("text"))
    lines = materialize(_lines(own, depth, "of").select("doc_id", "of", "line_no", "n", "key", "leaf"), "lines")
    keys = (
        lines.select("doc_id", "key", "leaf").distinct()
        .groupBy("key", "leaf").agg(F.count("*").alias("docs"), F.min("doc_id").alias("carrier"))
    )
    leaves = keys.groupBy("leaf").agg(F.count("*").alias("keys")).where(F.col("keys") > 1).select("leaf")
    mixed = materialize(salted_join(keys, leaves, ["leaf"], ["key"]), "mixed")
    # (as many ids as documents, where most lines are few; so they are not sent to every task while there are few)
    carriers = mixed.select(F.col("carrier").alias("doc_id")).distinct().hint("merge")
    texts = _lines(docs.join(carriers, "doc_id", "left_semi"), depth).select(F.col("doc_id").alias("carrier"), "key", "line").distinct()
    members = materialize(mixed.join(texts, ["carrier", "key"]), "members")
    found, size = [], BLOCK
    while True:
        leaders = materialize(_leaders(members, size, depth, similarity), "leaders")
        pairs = salted_join(members, leaders, ["leaf"], ["key"]).where(
            (F.col("key") == F.col("template")) | _follows("line", "leader", depth, similarity)
        )
        # the first leader is the one to follow; a leader is like none before it
        first = pairs.groupBy("leaf", "key").agg(F.min(F.struct("place", "template")).alias("first"))
        led = materialize(first.select("leaf", "key", F.col("first.template").alias("template")), "led")
        found.append(led)
        left = materialize(members.join(led.select("leaf", "key"), ["leaf", "key"], "left_anti"), "members")
        discard(members, leaders)
        members, size = left, min(2 * size, BLOCKS_MOST)
        if left.isEmpty():
            discard(left)
            break
    every = reduce(DataFrame.unionAll, found)
    templates = materialize(
        salted_join(lines, every.where("key <> template").select("key", "template"), ["key"], ["doc_id"], "left")
        .select("doc_id", "of", "line_no", "n", F.coalesce("template", "key").alias("template")),
        "templates",
    )
    discard(lines, mixed, *found)
    return templates


def _shortest_runs(lines: Column) -> Column:
    """(key, first, last) of the shortest runs of ``LONG_TOKENS`` tokens from and up to each of ``lines`` (no, key, n)."""

    def enough(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"))
        taken = F.aggregate(part, start, lambda a, x: F.when(a["n"] >= LONG_TOKENS, a).otherwise(
            F.struct((a["n"] + x["n"]).alias("n"), (a["lines"] + 1).alias("lines"))
        ))
        # a single line has its template's rule
        return bind(taken, lambda t: F.when((t["n"] >= LONG_TOKENS) & (t["lines"] > 1), F.slice(part, 1, t["lines"])))

    places = F.sequence(F.lit(1), F.size(lines))
    # a line has a token at least
    onward = F.transform(places, lambda i: bind(F.slice(lines, i, LONG_TOKENS), enough))
    back = F.transform(places, lambda i: bind(
        F.reverse(F.slice(lines, F.greatest(i - LONG_TOKENS + 1, F.lit(1)), F.least(i, F.lit(LONG_TOKENS)))), enough
    ))
    found = F.filter(F.concat(onward, F.transform(back, F.reverse)), lambda run: run.isNotNull())
    runs = F.transform(found, lambda run: F.struct(
        F.xxhash64(F.transform(run, lambda x: x["key"])).alias("key"),
        run[0]["no"].alias("first"), F.element_at(run, -1)["no"].alias("last"),
    ))
    return F.when(F.size(lines) > 0, F.array_distinct(runs))


def shared_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, of, line_no) of the lines in runs that an earlier document has; ``of`` is the hash of the text."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), squeezed(x).alias("line")))
    hashed = F.transform(F.filter(line, lambda x: x["line"] != ""), lambda x: F.struct(
        x["no"].alias("no"), F.xxhash64(x["line"]).alias("key"),
        (F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(" "), F.lit(""))) + 1).alias("n"),
    ))
    runs = materialize(docs.select("doc_id", F.xxhash64("text").alias("of"), F.explode(bind(hashed, _shortest_runs)).alias("run")).select("doc_id", "of", "run.*"), "runs")
    shared = (
        runs.select("doc_id", "key").distinct()
        .groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("holder")).where(F.col("docs") > 1)
        .select("key", "holder")
    )
    later = salted_join(runs, shared, ["key"], ["doc_id"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return later.select("doc_id", "of", F.explode(F.sequence("first", "last")).alias("line_no"))


def recurring_lines(docs: DataFrame, runs: bool = False, **options) -> DataFrame:
    """(doc_id, of, line_no) of the lines to drop; ``of`` is the hash of the text."""
    lines = line_templates(docs, **options)
    recurring = (
        lines.select("doc_id", "template", "n").distinct()
        .groupBy("template", "n").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
        .where(F.col("docs") >= F.when(F.col("n") >= LONG_TOKENS, LONG_MIN_DOCS).otherwise(MIN_DOCS))
        .select("template", "first")
    )
    gone = salted_join(lines, recurring, ["template"], ["doc_id"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("first"))
    ).select("doc_id", "of", "line_no")
    return gone.unionAll(shared_runs(docs)) if runs else gone


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: str = "deduped", **options
) -> DataFrame:
    """The columns of ``docs`` as they are and a struct ``added``: text, n_lines, n_dropped, depleted."""
    if added in docs.columns:
        raise ValueError(f"there is a column {added} already")
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    dropped = recurring_lines(narrow, **options).groupBy("doc_id", "of").agg(F.collect_set("line_no").alias("gone"))
    same = docs[id_col].eqNullSafe(dropped["doc_id"]) & (F.xxhash64(docs[text_col]) == dropped["of"])
    joined = docs.join(dropped, same, "left")
    text, gone = docs[text_col], dropped["gone"]

    def rebuilt(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))

    deduped = F.struct(
        bind(F.split(text, "\n"), rebuilt).alias("text"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    lost = F.coalesce(F.length("d.text") < F.length("t") * (1 - MAX_DROPPED), F.lit(False))
    packed = joined.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), deduped.alias("d"), text.alias("t"))
    return packed.select("row.*", F.col("d").withField("depleted", lost).alias(added))
