"""Every operator as a query over the driver's tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import redaction as rd
from timberline.functions import tokens as tk
from timberline.functions.levels import level_name, level_ordinal, parse_level
from timberline.functions.text import estimate_tokens, truncate
from timberline.functions.timestamps import CLF
from timberline.operators import anomalies
from timberline.operators import chunks as ck
from timberline.operators import compress as cp
from timberline.operators import filters, redact, search, stats, vectors, windows
from timberline.operators import templates as tp
from timberline.operators.diff import diff_logs
from timberline.operators.parse import detect_format, parse_logs
from timberline.operators.prompts import TASKS, build_prompts
from timberline.plans.rendered import YEAR, event_lines, event_logs, render_lines
from timberline.session import configure, materialize, shared_dir, spread
from timberline.sources import sinks
from timberline.sources.text import read_logs
from timberline.streaming import appended, stateful
from timberline.streaming.follow import follow_logs, tail_and_follow

CONTEXT = 3
TAIL = 25
NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)
REDACTED = rd.DEFAULT_NAMES + ("credit_card",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def flat(df: DataFrame) -> DataFrame:
    """Times without zone and rounded ratios, to compare by value."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        out.append(column.alias(field.name))
    return df.select(*out)


def map_text(column: str) -> Column:
    """A map as sorted ``key=value`` text."""
    pairs = F.transform(
        F.array_sort(F.map_entries(column)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return F.array_join(pairs, ",")


LINE = ("file", "line", "level", "message")


# -- parsing

def parse_entries(spark, folder):
    return flat(
        event_logs(spark, folder).select(
            "file", "line", "raw", "format", "ts", "level", "message", "source"
        )
    )


def parse_fields(spark, folder):
    return event_logs(spark, folder).select("line", F.explode("fields").alias("key", "value"))


def format_counts(spark, folder):
    return (
        detect_format(event_lines(spark, folder)).groupBy("format").agg(F.count("*").alias("count"))
    )


SPELLINGS = (
    "debug", "DBG", "Info", "inf", "WARN", "warning", "error", "Err", "fatal", "CRITICAL", "crit",
    "", "trace", "notice", "x", "information",
)


def level_spellings(spark, folder):
    nth = F.col("event_id") % len(SPELLINGS)
    word = F.get(F.array(*[F.lit(w) for w in SPELLINGS]), nth.cast("int"))
    return table(spark, folder, "events").groupBy(parse_level(word).alias("level"), nth.alias("spelling")).agg(
        F.count("*").alias("count")
    )


def _micros(lines: DataFrame, **options) -> DataFrame:
    """Times far beyond the calendar compare as numbers."""
    return parse_logs(lines, **options).select("line", F.unix_micros("ts").alias("micros"))


def json_times(spark, folder):
    """Numeric times: seconds, milliseconds, around their border, before 1970, too large."""
    e = F.col("event_id")
    number = (
        F.when(e % 8 == 0, 1700000000 + e).when(e % 8 == 1, 1700000000000 + e).when(e % 8 == 2, 500000000000 + e)
        .when(e % 8 == 3, F.lit(1000000000000)).when(e % 8 == 4, -(300000000000 + e)).when(e % 8 == 5, 1000000000001 + e)
        .when(e % 8 == 6, 1600000000 + e).otherwise(F.lit(9223372036854775807))
    ).cast("string")
    # some with a fraction, which is cut off
    number = F.when(e % 8 == 6, F.concat(number, F.lit(".75"))).otherwise(number)
    raw = F.concat(F.lit('{"ts": '), number, F.lit(', "msg": "x"}'))
    return _micros(table(spark, folder, "events").select(e.alias("line"), raw.alias("raw")))


def generic_times(spark, folder):
    """Zone offsets, US dates, fractions, formats of the user, and months that are none."""
    e, at = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(e % 7 == 0, F.concat(F.lit("x "), iso, F.lit("-05:00 INFO a")))
        .when(e % 7 == 1, F.concat(F.date_format(at, "MM/dd/yyyy HH:mm:ss"), F.lit(" ERROR b")))
        .when(e % 7 == 2, F.concat(F.lit("["), iso, F.lit(".25Z] c")))
        .when(e % 7 == 3, F.concat(F.date_format(at, "dd.MM.yyyy HH-mm-ss"), F.lit(" d")))
        .when(e % 7 == 4, F.concat(F.date_format(at, "dd/"), F.lit("an /"), F.date_format(at, "yyyy:HH:mm:ss"), F.lit(" +0000 e")))
        .when(e % 7 == 5, F.concat(F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0130 f")))
        .otherwise(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" g")))
    )
    lines = table(spark, folder, "events").select(e.alias("line"), raw.alias("raw"))
    return _micros(lines, ts_formats=["dd.MM.yyyy HH-mm-ss", CLF])


def read_files(spark, folder):
    """Rendered lines written as text files, read back with exact line numbers."""
    path = f"{shared_dir(spark)}/timberline/files-{uuid.uuid4().hex}"
    event_lines(spark, folder).repartitionByRange("file", "seq").sortWithinPartitions("seq").select(
        "file", F.col("raw").alias("value")
    ).write.partitionBy("file").text(path)
    entries = read_logs(spark, path, reference_year=YEAR)
    per_file = entries.groupBy("file").agg(
        F.count("*").alias("n"),
        F.count_distinct("line").alias("lines"),
        F.min("line").alias("first"),
        F.max("line").alias("last"),
        F.count_if(F.col("line") == F.col("pos")).alias("same"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
    )
    return per_file.agg(
        F.sum("n").alias("total_lines"),
        F.sum("lines").alias("distinct_lines"),
        F.max("first").alias("first_line"),
        F.sum(F.col("last") - F.col("n")).alias("missing_lines"),
        F.sum("same").alias("equal_positions"),
        F.sum("errors").alias("errors"),
    )


def read_glob(spark, folder):
    """Two of the three files, chosen by one pattern."""
    path = f"{shared_dir(spark)}/timberline/glob-{uuid.uuid4().hex}"
    event_lines(spark, folder).select("file", F.col("raw").alias("value")).write.partitionBy("file").text(path)
    entries = read_logs(spark, f"{path}/file=f[01]*", reference_year=YEAR, numbered=False)
    return entries.groupBy("level").agg(F.count("*").alias("count"))


# -- filters and search

def _kept(keep):
    return lambda spark, folder: event_logs(spark, folder).where(keep()).select(*LINE)


def count_matches(spark, folder):
    return search.count_matches(event_logs(spark, folder), filters.matches(r"took 4\d\d ms"))


def search_context(spark, folder):
    got = search.search_context(
        event_logs(spark, folder), filters.matches(r"took 49\d ms"), CONTEXT
    )
    return got.select(*LINE, "matched")


def context_groups(spark, folder):
    got = search.search_context(
        event_logs(spark, folder), filters.search_filter(level="fatal"), CONTEXT, groups=True
    )
    return got.select("file", "line", "matched", "group_id")


def last_entries(spark, folder):
    return search.last_entries(
        event_logs(spark, folder), TAIL, filters.tail_filter("warn", "user")
    ).select(*LINE)


def last_many_entries(spark, folder):
    return search.last_entries(event_logs(spark, folder), 1_500).select(*LINE)


# -- statistics

def compute_stats(spark, folder):
    row = stats.compute_stats(event_logs(spark, folder), 5)
    top = F.transform(
        "top_messages", lambda m: F.concat(m["message"], F.lit("="), m["count"].cast("string"))
    )
    return flat(
        row.withColumn("level_counts", map_text("level_counts")).withColumn(
            "top_messages", F.array_join(top, "|")
        )
    )


# -- windows

def _windows(width):
    def query(spark, folder):
        got = windows.time_windows(event_logs(spark, folder), width)
        return flat(got.withColumn("level_counts", map_text("level_counts")))

    return query


# -- sinks

def entry_json(spark, folder):
    return sinks.json_lines(event_logs(spark, folder))


# -- redaction

def redact_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return redact.redact_column(docs, "text", REDACTED)


def sensitive_documents(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        rd.is_sensitive(text, REDACTED).alias("is_sensitive"),
        rd.count_sensitive(text, REDACTED).alias("sensitive_values"),
    )


def redacted_values(spark, folder):
    return redact.redacted_values(
        table(spark, folder, "documents"), ["text"], REDACTED
    ).select("value", "type", "placeholder")


def redacted_types(spark, folder):
    return redact.redacted_type_counts(redacted_values(spark, folder))


def redact_entries(spark, folder):
    return redact.redact_entries(event_logs(spark, folder)).select(
        "file", "line", "message", "raw", "redacted_count"
    )


def redact_all_patterns(spark, folder):
    """A text with one value of every pattern for each customer, redacted and with redaction off."""
    c = F.col("c_custkey")

    def padded(value, width):
        return F.lpad(value.cast("string"), width, "0")

    text = F.concat(
        F.lit("from 10."), c % 250, F.lit(".0.7 and 2001:db8::"), c % 99 + 1, F.lit(" by u"), c, F.lit("@example.org token=abcdefgh"), c,
        F.lit(" AKIA"), padded(c, 16), F.lit(" eyJ"), c, F.lit(".eyJ"), c, F.lit(".sig -----BEGIN EC PRIVATE KEY----- 00:1b:44:11:3a:"),
        padded(c % 90 + 10, 2), F.lit(" 4000-1234-5678-"), padded(c % 10000, 4), F.lit(" 123e4567-e89b-12d3-a456-"), padded(c, 12),
    )
    rows = table(spark, folder, "customer").select("c_custkey", text.alias("text"))
    done = redact.redact_column(rows, "text", list(rd.CATALOGUE))
    off = redact.redact_entries(rows.select("c_custkey", F.col("text").alias("message")), enabled=False)
    return done.join(off.select("c_custkey", F.col("message").alias("switched_off")), "c_custkey")


def redact_pages(spark, folder):
    pages = table(spark, folder, "pages")
    done = redact.redact_column(pages.select("page_id", "html"), "html", ["email", "ipv4"])
    return done.select("page_id", "redacted_count", F.sha2("html", 256).alias("html_hash"))


# -- tokens

def token_estimates(spark, folder):
    text = F.col("text")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        estimate_tokens(text).alias("tokens"),
        F.size(tk.tokenize(text)).cast("bigint").alias("words"),
        truncate(tk.normalize_blanks(text), 60).alias("short_text"),
    )


def template_frequency(spark, folder):
    return tp.template_frequency(event_logs(spark, folder))


def document_frequency(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("text").alias("message"))
    return tp.template_frequency(docs)


def turn_similarity(spark, folder):
    """Each turn against the next of its conversation."""
    talks = table(spark, folder, "conversations")
    this = talks.select("conv_id", "turn", tk.tokenize(F.col("text")).alias("a"))
    following = talks.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), tk.tokenize(F.col("text")).alias("b")
    )
    pairs = this.join(following, ["conv_id", "turn"])
    similar = tk.similarity(F.col("a"), F.col("b"))
    return flat(
        pairs.select(
            "conv_id", "turn",
            similar.alias("similarity"),
            (similar >= 0.5).alias("matches"),
            F.array_join(tk.merge(F.col("a"), F.col("b")), " ").alias("merged"),
        )
    )


def short_hashes(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        rd.short_hash(F.col("c_name")).alias("hash4"),
        rd.normalize_value(F.col("c_name"), "EMAIL").alias("normalized"),
        rd.placeholder(F.col("c_name"), "EMAIL", normalize=True).alias("placeholder"),
    )


# -- templates and compression

def mine_templates(spark, folder):
    mined = tp.mine_templates(event_logs(spark, folder))
    return mined.with_examples().select(
        "template_id", "pattern", "count", F.array_join("examples", "|").alias("examples")
    )


def template_assignments(spark, folder):
    mined = tp.mine_templates(event_logs(spark, folder))
    return mined.assignments().select("seq", "template_id", "pattern")


def template_totals(spark, folder):
    mined = tp.mine_templates(event_logs(spark, folder))
    return mined.totals()


def crowded_templates(spark, folder):
    """Other settings: a node of the tree has two children, and more than half of the tokens must agree."""
    mined = tp.mine_templates(event_logs(spark, folder), threshold=0.8, max_children=2)
    return mined.templates.select("template_id", "pattern", "count")


def template_lookup(spark, folder):
    return tp.mine_templates(event_logs(spark, folder)).template("T_2").select("template_id", "pattern", "count")


def _masked_templates(entries: DataFrame) -> DataFrame:
    """Masked messages as templates, for the operators that start from a template table."""
    rows = entries.select(
        tk.mask_message(F.col("message")).alias("pattern"), "seq", "level", "ts"
    )
    return rows.groupBy("pattern").agg(
        F.count("*").alias("count"), F.min("seq").alias("first_seq")
    )


def first_match(spark, folder):
    entries = event_logs(spark, folder)
    templates = materialize(_masked_templates(entries), "masked").select(
        F.col("pattern").alias("template_id"), "pattern",
        F.split("pattern", " ").alias("tokens"), "count", "first_seq",
    )
    keys = entries.select(tk.message_key(F.col("message")).alias("key")).distinct()
    return cp.first_match(keys, templates, []).select(
        F.translate("key", tk.VARIABLE, "#").alias("key"), F.col("template_id").alias("pattern")
    )


def template_priority(spark, folder):
    entries = event_logs(spark, folder)
    known = F.when(F.col("level") != "UNKNOWN", level_ordinal(F.col("level")))
    grouped = (
        entries.select(tk.mask_message(F.col("message")).alias("pattern"), known.alias("k"))
        .groupBy("pattern")
        .agg(F.count("*").alias("count"), F.max("k").alias("k"))
        .withColumn("level", F.coalesce(level_name(F.col("k")), F.lit("UNKNOWN")))
    )
    level, count = F.col("level"), F.col("count")
    return flat(
        grouped.select(
            "pattern", "level",
            cp.priority_score(level, count).cast("bigint").alias("score"),
            cp.section_of(level).alias("section"),
            cp.format_template(
                level, F.col("pattern"), count, F.array(F.col("pattern"))
            ).alias("formatted"),
            cp.compression_ratio(count, F.lit(4)).alias("ratio"),
        )
    )


def compress_all(spark, folder):
    done = cp.compress_logs(event_logs(spark, folder))
    return done.output.select("summary", "total_templates", "included_templates", "token_count")


def compress_by_file(spark, folder):
    done = cp.compress_logs(event_logs(spark, folder), by=["file"], token_limit=4_000)
    return flat(
        done.output.select(
            "file", "summary", "start", "end", "total_lines", "total_templates", "included_templates", "redacted_count",
            "token_count", "token_limit",
        )
    )


def templates_by_level(spark, folder):
    done = cp.compress_logs(event_logs(spark, folder), by=["file"], token_limit=4_000)
    return cp.templates_by_level(done.output, "error").select("file", "pattern", "count", "level")


def template_lineage(spark, folder):
    return cp.compress_logs(event_logs(spark, folder), by=["file"]).template_lineage()


def compress_stats(spark, folder):
    return flat(cp.compress_logs(event_logs(spark, folder), by=["level"]).stats())


def compress_redacted_types(spark, folder):
    """What compression reports as redacted, without the mining."""
    return redact.redacted_type_counts(redact.redacted_values(event_logs(spark, folder)))


def prompts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("summary"))
    built = build_prompts(
        docs, "root_cause", files=F.array("source"), level="error", window="5m", strict=False
    )
    return built.select("doc_id", F.posexplode("messages").alias("n", "m")).select(
        "doc_id", "n", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def task_prompts(spark, folder):
    """Every task on every turn of the conversations, with the second pass for structured output."""
    turns = table(spark, folder, "conversations").where("text <> ''").select("conv_id", "turn", F.col("text").alias("summary"))
    out = None
    for task in TASKS:
        reply = F.concat(F.lit("It is "), F.col("turn")) if task == "structured_output" else None
        built = build_prompts(turns, task, question="Why?", files=["a.log", "b.log"], first_response=reply)
        rows = built.select("conv_id", "turn", F.lit(task).alias("task"), F.posexplode("messages").alias("n", "m"))
        out = rows if out is None else out.unionAll(rows)
    return out.select("conv_id", "turn", "task", "n", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def question_prompts(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("summary")
    )
    built = build_prompts(
        turns, "natural_language_query", question="What failed?", pattern=F.col("turn").cast("string")
    )
    return built.select("conv_id", "turn", F.get("messages", F.lit(1))["content"].alias("content"))


# -- streaming

def follow_stream(spark, folder):
    """Rendered lines arriving as text segments, parsed and filtered by a streaming query."""
    base = f"{shared_dir(spark)}/timberline/stream-{uuid.uuid4().hex}"
    event_lines(spark, folder).select(F.col("raw").alias("value")).write.text(f"{base}/in")
    stream = follow_logs(
        spark, f"{base}/in", min_level="error", pattern=r"10\.0\.", reference_year=YEAR
    )
    query = (
        stream.select("format", "ts", "level", "message", "source")
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return flat(spark.read.parquet(f"{base}/out"))


def tail_then_follow(spark, folder):
    """The last errors of every file that is there at the start, then all errors that arrive later."""
    base = f"{shared_dir(spark)}/timberline/tail-{uuid.uuid4().hex}"
    lines = event_lines(spark, folder).withColumn("value", F.col("raw"))
    later = F.col("line") % 5 == 0

    def arrive(rows):
        ordered = rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "value")
        ordered.write.mode("append").partitionBy("file").text(f"{base}/in")

    def keep(batch, number):
        batch.select("level", "message", F.lit(number > 0).alias("followed")).write.mode("append").parquet(f"{base}/out")

    arrive(lines.where(~later))
    query = tail_and_follow(spark, f"{base}/in", keep, f"{base}/state", lines=TAIL, min_level="error", reference_year=YEAR)
    query.processAllAvailable()
    arrive(lines.where(later))
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{base}/out")


# a stream's last row, which lets the watermark pass all others
LAST_LINE = "2030-01-01 00:00:00 INFO end of all lines"
LATE_DAYS = 10


def _in_steps(spark, folder, name, operator, mode):
    """Lines arriving in three parts of ten days, with some of the first part's too late in the last."""
    base = f"{shared_dir(spark)}/timberline/{name}-{uuid.uuid4().hex}"
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01"))
    late = (F.col("event_id") % 50 == 0) & (days < LATE_DAYS)
    part = F.when(late, 2).otherwise(F.least(F.floor(days / LATE_DAYS), F.lit(2)))
    lines = materialize(render_lines(table(spark, folder, "events").withColumn("part", part), "part"), "parts")
    arriving = [lines.where(F.col("part") == k).select(F.col("raw").alias("value")) for k in range(3)]
    for rows in [*arriving, spark.createDataFrame([(LAST_LINE,)], "value string")]:
        rows.write.mode("append").text(f"{base}/in")
        query = (
            operator(follow_logs(spark, f"{base}/in", reference_year=YEAR))
            .writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{base}/out"))
            .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_windows(spark, folder):
    """Windows of a stream in append mode; rows beyond the watermark are left out."""
    got = _in_steps(spark, folder, "windows", lambda entries: stateful.stream_windows(entries, "2h", "30 minutes"), "append")
    return flat(got.withColumn("level_counts", map_text("level_counts")))


def stream_templates(spark, folder):
    """Templates mined on a stream, as they stand at its end."""
    got = _in_steps(spark, folder, "mined", lambda entries: stateful.stream_templates(entries, "30 minutes"), "update")
    return flat(stateful.current_templates(got))


def follow_appended(spark, folder):
    """Files that grow twice, followed by two starts of one query, with line numbers."""
    base = f"{shared_dir(spark).removeprefix('file:')}/timberline/grown-{uuid.uuid4().hex}"
    e = F.col("line")
    lines = event_lines(spark, folder).withColumn("name", F.concat(F.lit("app"), e % 64, F.lit(".log")))

    def grow(rows, before):
        # written from where the file ended before, so that a task that runs again writes the same
        ends = before.groupBy("name").agg(F.sum(F.octet_length("raw") + 1).alias("end"))
        placed = rows.join(ends, "name", "left").select("name", F.coalesce("end", F.lit(0)).alias("end"), "line", "raw")
        placed.repartition("name").sortWithinPartitions("name", "line").foreachPartition(appender(f"{base}/in"))

    def keep(batch, number):
        batch.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", "level", "message").write.mode("append").parquet(f"{base}/out")

    numbered = appended.number_lines(appended.parsed_batches(keep, "warn", reference_year=YEAR), f"{base}/lines")
    first, second = lines.where(e % 5 > 0), lines.where(e % 5 == 0)
    for rows, before in ((first, first.limit(0)), (second, first)):
        grow(rows, before)
        query = (
            appended.follow_appended(spark, f"{base}/in").writeStream.foreachBatch(numbered)
            .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def appender(folder):
    """Appends a partition's rows (name, end, line, raw) to the files they name, which have ``end`` bytes."""

    def run(rows):
        import itertools
        import os

        os.makedirs(folder, exist_ok=True)
        for (name, end), own in itertools.groupby(rows, lambda r: (r["name"], r["end"])):
            with open(f"{folder}/{name}", "r+b" if end else "wb") as f:
                f.seek(end)
                f.writelines(r["raw"].encode() + b"\n" for r in own)

    return run


# -- chunks and vectors

def chunk_errors(spark, folder):
    return ck.anchored_chunks(event_logs(spark, folder)).select("file", "line", "anchor", "chunk_id")


def chunk_sliding(spark, folder):
    return ck.sliding_chunks(event_logs(spark, folder)).select("file", "line", "chunk_id")


def chunk_hours(spark, folder):
    return ck.time_chunks(event_logs(spark, folder).select("file", "line", "ts"), "1h").select("file", "line", "chunk_id")


def chunk_packs(spark, folder):
    """Chunks around fatal errors, packed to 25 to 60 lines."""
    around = ck.anchored_chunks(event_logs(spark, folder).select("file", "line", "level"), 4, 2, F.col("level") == "FATAL")
    return ck.pack_chunks(around, 25, 60).select("file", "line", "chunk_id", "pack_id")


def chunk_texts(spark, folder):
    """Hours of each file, packed to 20 to 100 lines, as texts."""
    entries = event_logs(spark, folder).select("file", "line", "ts", "level", "message")
    packed = ck.pack_chunks(ck.time_chunks(entries, "1h"), 20, 100)
    return flat(ck.pack_texts(packed).select("file", "pack_id", "first_line", "last_line", "n_lines", "n_fatal", "text", "tokens"))


def rate_scores(spark, folder):
    """How every kind of user message departs from the days before, in 4 hours."""
    kind = F.regexp_extract("message", "^user [0-9]+ ([a-z ]+) [0-9]", 1)
    return flat(anomalies.rate_scores(event_logs(spark, folder), "4h", key=kind))


def rate_anomalies(spark, folder):
    return flat(anomalies.rate_anomalies(event_logs(spark, folder), "12h"))


def template_diff(spark, folder):
    """The templates of the first half of the month against those of the second."""
    events = table(spark, folder, "events")
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    halves = [parse_logs(render_lines(events.where(keep)), reference_year=YEAR) for keep in (first, ~first)]
    return flat(diff_logs(*halves))


NEAREST = 10


def _vector_queries(spark, folder):
    rows = table(spark, folder, "embeddings")
    return vectors.build_index(rows, "vec_id", "embedding"), rows.where("vec_id % 20 = 0")


def vector_top_k(spark, folder):
    """The nearest vectors of every twentieth row among all rows, exactly."""
    index, queries = _vector_queries(spark, folder)
    return index.search(queries, NEAREST, "vec_id", "embedding", exact=True).withColumnsRenamed({"id": "vec_id", "rank": "place"})


def vector_recall(spark, folder):
    """How many of them the lists near a query hold."""
    index, queries = _vector_queries(spark, folder)
    found = index.search(queries, NEAREST, "vec_id", "embedding")
    return vectors.recall(found, index.search(queries, NEAREST, "vec_id", "embedding", exact=True))


def _of(operator, *args):
    return lambda spark, folder: flat(operator(event_logs(spark, folder), *args))


QUERIES = {
    "parse_entries": parse_entries,
    "parse_fields": parse_fields,
    "format_counts": format_counts,
    "level_spellings": level_spellings,
    "json_times": json_times,
    "generic_times": generic_times,
    "read_files": read_files,
    "read_glob": read_glob,
    "search_pattern": _kept(lambda: filters.search_filter(pattern=r"took 4\d\d ms")),
    "search_inverted": _kept(lambda: filters.search_filter(pattern=r"took \d+ ms", invert=True)),
    "search_level": _kept(lambda: filters.search_filter(level="warning")),
    "search_combined": _kept(
        lambda: filters.search_filter(
            pattern="bought item", level="info", since="2024-01-05", until="2024-01-20T12:00:00Z"
        )
    ),
    "time_range": _kept(lambda: filters.in_time_range("5d12h", "2024-01-18 06:00:00", now=NOW)),
    "min_level": _kept(lambda: filters.entry_filter(min_level="error")),
    "exact_level": _kept(
        lambda: filters.entry_filter(min_level="fatal", exact_level=True, pattern="s5 ", invert=True)
    ),
    "tail_level": _kept(lambda: filters.tail_filter("warn", "10.0.")),
    "count_matches": count_matches,
    "search_context": search_context,
    "context_groups": context_groups,
    "last_entries": last_entries,
    "last_many_entries": last_many_entries,
    "total_lines": _of(stats.total_lines),
    "level_counts": _of(stats.level_counts),
    "time_span": _of(stats.time_span),
    "error_rate": _of(stats.error_rate),
    "top_messages": _of(stats.top_messages, 20),
    "compute_stats": compute_stats,
    "group_by_level": _of(stats.group_by, "level", 3),
    "group_by_message": _of(stats.group_by, "message", 15),
    "group_by_source": _of(stats.group_by, "source", 10),
    "hourly_windows": _windows("1h"),
    "weekly_windows": _windows("7d"),
    "minute_windows": _windows("1m"),
    "window_levels": _of(windows.window_levels, "6h"),
    "text_lines": lambda s, f: sinks.text_lines(event_logs(s, f), with_file=True),
    "entry_json": entry_json,
    "table_rows": lambda s, f: sinks.table_rows(event_logs(s, f)),
    "redact_documents": redact_documents,
    "sensitive_documents": sensitive_documents,
    "redacted_values": redacted_values,
    "redacted_types": redacted_types,
    "redact_entries": redact_entries,
    "redact_pages": redact_pages,
    "redact_all_patterns": redact_all_patterns,
    "token_estimates": token_estimates,
    "template_frequency": template_frequency,
    "document_frequency": document_frequency,
    "turn_similarity": turn_similarity,
    "short_hashes": short_hashes,
    "mine_templates": mine_templates,
    "template_assignments": template_assignments,
    "template_totals": template_totals,
    "crowded_templates": crowded_templates,
    "template_lookup": template_lookup,
    "first_match": first_match,
    "template_priority": template_priority,
    "compress_all": compress_all,
    "compress_by_file": compress_by_file,
    "compress_stats": compress_stats,
    "templates_by_level": templates_by_level,
    "template_lineage": template_lineage,
    "compress_redacted_types": compress_redacted_types,
    "prompts": prompts,
    "task_prompts": task_prompts,
    "question_prompts": question_prompts,
    "chunk_errors": chunk_errors,
    "chunk_sliding": chunk_sliding,
    "chunk_hours": chunk_hours,
    "chunk_packs": chunk_packs,
    "chunk_texts": chunk_texts,
    "rate_scores": rate_scores,
    "rate_anomalies": rate_anomalies,
    "template_diff": template_diff,
    "vector_top_k": vector_top_k,
    "vector_recall": vector_recall,
    "follow_stream": follow_stream,
    "follow_appended": follow_appended,
    "stream_windows": stream_windows,
    "stream_templates": stream_templates,
    "tail_then_follow": tail_then_follow,
}
