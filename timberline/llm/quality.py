"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text: number of words and how many of them lie in repeated three-word
windows. The corpus rule counts, for each host, the distinct documents that a normalised line
(lower case, digits levelled, single spaces) occurs in. A line in more documents than the limit is
boilerplate; a document that loses more than ``MAX_REMOVED`` of its words with such lines is
depleted and rejected. The limit is a share of the host's documents, so that it means the same
at every size, with a floor for small hosts.

Defined cases: a null text is an empty one (no words, base rules fail); a null host is a host of
its own; rows that share a ``doc_id`` are one document for the line counts and are judged together
as to depletion, each with its own base figures; a null ``doc_id`` is a document like any other;
an empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import bind
from timberline.llm.common import lower_ascii, salted_join, split_words, squeezed
from timberline.session import materialize

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
SYMBOLS = "#*$%&|<>"
# A line is boilerplate of a host beyond this many documents and this share of its documents.
LINE_DOCS = 5
LINE_SHARE = 0.01
MAX_REMOVED = 0.7


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more in the array ``words``.

    Windows are sorted with their positions, so equal ones stand side by side: n log n.
    """

    def covered(at: Column) -> Column:
        # sorted starts of windows: each adds the words that the one before it doesn't cover
        gaps = F.transform(at, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(at, i - 1), x - 3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def in_sorted(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, i: x["w"].eqNullSafe(F.get(s, i - 1)["w"]) | x["w"].eqNullSafe(F.get(s, i + 1)["w"])
        )
        return bind(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def in_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.alias("i")),
        )
        return F.when(F.size(w) >= 3, bind(F.sort_array(windows), in_sorted)).otherwise(F.lit(0))

    return bind(words, in_words)


def base_figures(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    words = split_words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).cast("bigint").alias("n_repeat_words"),
    ]


def normalised(line: Column) -> Column:
    return squeezed(F.regexp_replace(lower_ascii(line), "[0-9]+", "0"))


def hashed_lines(text: Column, host: Column) -> Column:
    """(key, words) of every line with a word; the key is a hash of host and normalised line."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(host, x).alias("key"),
            (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"),
        ),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """One row per document: doc_id, base figures, ``removed_words``, ``base_failed`` and ``kept``.

    The text is read once; all else works on a narrow table of figures and line hashes.
    """
    host = F.xxhash64(docs[host_col])
    figures = materialize(
        docs.select(
            docs[id_col].alias("doc_id"), host.alias("host"), *base_figures(docs[text_col]),
            hashed_lines(F.coalesce(docs[text_col], F.lit("")), docs[host_col]).alias("lines"),
        ),
        "figures",
    )
    lines = figures.select("doc_id", "host", F.explode("lines").alias("x")).select("doc_id", "host", "x.key", "x.words")
    hosts = figures.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counts = lines.select("host", "key", "doc_id").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    frequent = (
        counts.where(F.col("n") > line_docs).join(hosts, "host").where(F.col("n") > F.col("docs") * line_share).select("key")
    )
    hits = salted_join(lines.select("doc_id", "key", "words"), frequent, ["key"], ["doc_id"])
    removed = (
        figures.select("doc_id", "n_words", F.lit(0).alias("words"))
        .unionAll(hits.select("doc_id", F.lit(0).alias("n_words"), "words"))
        .groupBy("doc_id")
        .agg(F.sum("n_words").alias("all_words"), F.sum("words").alias("removed_words"))
        .withColumnRenamed("doc_id", "_doc")
    )
    own = figures.drop("lines", "host")
    judged = own.join(removed, own["doc_id"].eqNullSafe(removed["_doc"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = F.col("removed_words") > F.col("all_words") * max_removed
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("removed_words").cast("bigint").alias("removed_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )
