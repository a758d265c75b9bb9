"""Edge cases of the operators on small tables: nulls, empty texts, ties, repeated rows, clashing columns."""

import random
import weakref

import pytest
from pyspark.sql import functions as F
from timberline.llm import bpe, chat, decontam, line_dedup, quality, toxicity

DOCS = "doc_id bigint, text string, source string, n_words bigint, line string, key string, deduped string, _salt int, hit int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "l", "k", "d", 1, 2) for i, t, s in rows], DOCS)


ODD = [(1, None, None), (1, "", "a"), (None, "word", "a"), (2, " \n\t\n", "a"), (3, "x " * 40_000, "b"), (3, "x " * 40_000, "b")]


def test_quality_odd_rows(spark):
    got = quality.quality_rules(documents(spark, ODD)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed) for r in got) == [
        (0, 1, True), (1, 0, True), (1, 0, True), (2, 0, True), (3, 40_000, True), (3, 40_000, True)
    ]
    assert quality.quality_rules(documents(spark, ODD).limit(0)).count() == 0


def test_quality_boilerplate(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("w%x" % rng.randrange(10**9) for _ in range(n)).replace("w", "q")
    menu = "Home Menu " * 30
    rows = [(i, prose(60) + "\n" + menu.strip() + f" {i}", "h") for i in range(20)]
    rows += [(100 + i, menu.strip() + f" {i}\n" + prose(20), "h") for i in range(10)]
    rows += [(200, menu.strip() + " 7\n" + prose(20), "other")]
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert all(got[i].removed_words == 61 and not got[i].base_failed == got[i].kept for i in range(20))
    assert all(got[i].removed_words == 61 and not got[i].kept for i in range(100, 110))
    assert got[200].removed_words == 0


def test_repeated_words(spark):
    def brute(words):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)})

    rng = random.Random(2)
    texts = [[rng.choice("abcdé") for _ in range(rng.randrange(30))] for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w array<string>")
    got = {r.i: r.n for r in docs.select("i", quality.repeated_words(F.col("w")).alias("n")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def kept_texts(spark, rows, **options):
    got = line_dedup.deduplicated(documents(spark, rows), added="out", **options)
    return [r.text for r in got.orderBy("doc_id").select("out.text").collect()]


def test_lines_that_are_no_duplicates_stay(spark):
    # nothing but the leading tokens in common
    fruit = [(i, f"the total value of {f}", "s") for i, f in enumerate(["apples", "pears", "plums", "figs", "dates"])]
    # nothing but numbers
    numbers = [(10 + i, f"{i} {i + 1} {7 * i} {i * i} {90 - i}", "s") for i in range(5)]
    # the variable token alone is alike
    mixed = [(20 + i, f"we had some of {i} {f}", "s") for i, f in enumerate(["red", "blue", "green", "black"])]
    rows = fruit + numbers + mixed
    assert kept_texts(spark, rows) == [t for _, t, _ in rows]


def test_a_leaf_has_several_templates(spark):
    one = [f"at noon the server {w} was up and well again" for w in ("alpha", "beta", "gamma")]
    two = [f"at noon the server said {w} loud and very clear" for w in ("hi", "ho", "hu")]
    rows = [(i, t, "s") for i, t in enumerate(one + two)] + [(10, "at noon the server left no word for us all", "s")]
    assert kept_texts(spark, rows) == [one[0], "", "", two[0], "", "", rows[-1][1]]


def test_templates_behind_a_lone_leader(spark):
    lone = "at noon the server left no word for us all"
    two = [f"at noon the server said {w} loud and very clear" for w in ("hi", "ho", "hu")]
    rows = [(i, lone, "s") for i in range(2)] + [(10 + i, t, "s") for i, t in enumerate(two)]
    assert kept_texts(spark, rows) == [lone, lone, two[0], "", ""]


def test_templates_are_those_of_a_line_by_line_search(spark, monkeypatch):
    rng = random.Random(5)
    lines = sorted({"at noon the server " + " ".join(rng.choice(["aa", "bb", "cc", "dd", "x1"]) for _ in range(5)) for _ in range(400)})
    rows = [(i, "\n".join(rng.sample(lines, 3)), "s") for i in range(250)]
    keys = {r.line: (-r.n, r.first) for r in spark.createDataFrame(rows, "doc_id bigint, text string, source string").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", line_dedup.masked(F.col("line")))
        .groupBy("line").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first")).collect()}

    def alike(a, b):
        pairs = [(x, y) for x, y in zip(a.split(" ")[4:], b.split(" ")[4:], strict=True) if (x, y) != ("<*>", "<*>")]
        return sum(x == y for x, y in pairs) >= 0.6 * len(pairs)

    leaders, template = [], {}
    for line in sorted(keys, key=lambda x: (*keys[x], x)):
        template[line] = next((x for x in leaders if alike(line, x)), line)
        if template[line] == line:
            leaders.append(line)
    docs = documents(spark, rows)
    own = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", line_dedup.masked(F.col("line")))
    # one round, and many
    for block, most in ((2048, 2048), (2, 8)):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "BLOCKS_MOST", most)
        got = line_dedup.line_templates(docs.select("doc_id", "text")).join(own, ["doc_id", "line_no"]).select("line", "template").distinct().collect()
        hashes = {r.line: r.h for r in own.select("line", F.xxhash64("line").alias("h")).distinct().collect()}
        assert len(leaders) > 20 and {r.line: r.template for r in got} == {x: hashes[t] for x, t in template.items() if x in hashes}


def test_exact_lines_of_numbers_are_duplicates(spark):
    rows = [(i, "3 1 4 1 5\n" + f"own {i}", "s") for i in range(3)]
    assert kept_texts(spark, rows) == [rows[0][1], "own 1", "own 2"]


def test_one_id_with_two_texts(spark):
    rows = [(1, "a line that is shared here\nfirst", "s"), (2, "a line that is shared here\nsecond", "s")]
    rows += [(2, "PRECIOUS own words only here\nmore", "s"), (3, "x\na line that is shared here", "s")]
    got = line_dedup.deduplicated(documents(spark, rows), added="out").select("text", "out.text").collect()
    assert {r[0]: r[1] for r in got} == {rows[0][1]: rows[0][1], rows[1][1]: "second", rows[2][1]: rows[2][1], rows[3][1]: "x"}


def test_a_taken_name_is_refused(spark):
    with pytest.raises(ValueError, match="deduped already"):
        line_dedup.deduplicated(documents(spark, ODD))


def test_line_dedup_odd_rows(spark):
    docs = documents(spark, ODD)
    got = line_dedup.deduplicated(docs, added="out")
    assert got.columns == [*docs.columns, "out"]
    rows = got.select("doc_id", "text", F.col("out").alias("d")).collect()
    assert sorted((r.doc_id or 0, r.d["n_lines"], r.d["n_dropped"]) for r in rows) == [(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, 3, 0), (3, 1, 0), (3, 1, 0)]
    assert all(r.d["text"] == r.text for r in rows)
    assert line_dedup.deduplicated(documents(spark, ODD).limit(0), added="out").count() == 0


def test_line_dedup_templates(spark):
    one = "Order {} was shipped to the {} office by the night train"
    rows = [(i, one.format(i, city) + "\nown line " + " ".join(chr(97 + i) * k for k in range(1, 9)), "a")
            for i, city in enumerate(["north", "south", "west", "east"])]
    rows += [(10, "a much longer line " + " ".join(f"w{chr(97 + i)}" for i in range(20)), "a"), (11, "a much longer line " + " ".join(f"w{chr(97 + i)}" for i in range(20)) + "\nrest", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.deduped for r in line_dedup.deduplicated(docs).collect()}
    assert got[0].text == rows[0][1] and got[1].text.startswith("own line") and got[1].n_dropped == 1 and not got[1].depleted
    assert got[10].n_dropped == 0 and got[11].text == "rest" and got[11].depleted


def test_decontamination_blocks(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (None, "four five"), (1, "six seven eight"), (3, " ".join("abcdefghijklmn"))], "item_id bigint, text string")
    docs = documents(spark, [*ODD, (7, "x Six, SEVEN eight; one two", "a"), (8, "four  five", "a"), (9, "z " + " ".join("bcdefghijkl"), "a")])
    for block in (1 << 18, 8):
        got = docs.select("doc_id", "text", decontam.contamination(items, docs["text"], block_bytes=block).alias("h")).where("h.n_hit > 0").collect()
        found = {r.doc_id: (r.h["n_hit"], r.h["items"], [r.text[s.start : s.end] for s in r.h["spans"]]) for r in got}
        assert found == {7: (3, ["1"], ["Six, SEVEN eight"]), 8: (2, [""], ["four  five"]), 9: (11, ["3"], [" ".join("bcdefghijkl")])}
    assert decontam.decontaminate(docs, items).count() == len(ODD)
    assert decontam.decontaminate(docs, items.limit(0)).columns == docs.columns


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(120)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if i % 5 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "foul", "nasty"]))
        rows.append((i, " ".join(text), "a"))
        labels.append((i, int(i % 5 == 0)))
    docs = documents(spark, [*rows, *((i, t, s) for i, t, s in ODD)])
    known = spark.createDataFrame([*labels, (None, 1), (5000, None), (7, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    scored = docs.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.differences(model, docs["text"], docs)["score"].alias("s"))
    got = scored.collect()
    assert len(got) == 606 and all(0 <= r.s <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id >= 10]
    assert len(held) > 100 and sum((r.s >= 0.3) == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)


def test_toxicity_vocabulary(spark):
    rows = [(i, f"common words and w{'abcdefghij'[i % 10] * (1 + i // 10)}", "a") for i in range(80)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("f")).collect()}
    counted = {w for i, t, _ in rows if fold[i] not in (toxicity.HELD_OUT, toxicity.CALIBRATION) for w in t.split()}
    assert set(toxicity.fit(docs, labels).vocabulary) == counted and len(counted) > 20


@pytest.mark.parametrize("toxic", [[], [0, 0], [1]])
def test_toxicity_without_classes(spark, toxic):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic)], "doc_id bigint, toxic int")
    score = toxicity.differences(toxicity.fit(docs, labels), docs["text"], docs)["score"]
    want = 0.5 if not toxic else float(toxic[0])
    assert all(abs(r.s - want) < 1e-6 for r in docs.select(score.alias("s")).collect())


def test_chat(spark):
    rows = [(1, 0, "system", "be good", "x"), (1, 1, "ann", "hi <|end|>", "x"), (1, 2, "bob", "yes", "x"), (1, 3, None, None, "x"), (1, 3, None, None, "x"), (None, 1, "ann", "alone", "x"), (2, 1, "system", "nobody", "x")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, key string")
    got = {(r.conv_id, r.speaker, r.segment): r for r in chat.perspectives(messages).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "", 0), (None, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann.text.startswith("<|begin|>system\nbe good<|end|>\n<|begin|>assistant\nhi < |end|><|end|>\n<|begin|>user bob\nyes<|end|>\n")
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi < |end|><|end|>"] and ann.n_turns == 5
    assert [got[1, "", 0].text[m.start : m.end] for m in got[1, "", 0].mask] == ["<|end|>", "<|end|>"]
    assert chat.perspectives(messages.limit(0)).count() == 0


def test_chat_long(spark):
    rows = [(c, t, "abc"[t % 3], f"{c}-{t}") for c in range(5) for t in range(1000 if c == 2 else 7)]
    random.Random(1).shuffle(rows)
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = chat.perspectives(messages, segment=10).collect()
    long = sorted((r.segment, r.text) for r in got if r.conv_id == 2 and r.speaker == "a")
    assert [s for s, _ in long] == list(range(100))
    assert [x.split("\n")[1].removesuffix("<|end|>") for _, t in long for x in t.split("<|begin|>")[1:]] == [f"2-{i}" for i in range(1000)]
    assert len(got) == 100 * 3 + 4 * 3


def test_python_gets_whole_texts_in_small_batches(spark):
    def sizes(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    docs = spark.range(5000, numPartitions=1).withColumn("text", F.lit("some text"))
    got = [r.n for r in docs.mapInPandas(sizes, "n bigint").collect()]
    assert sum(got) == 5000 and max(got) <= 1000


def test_other_operators_free_what_bpe_keeps_in_a_worker(spark):
    tokens = [bytes([i]) for i in range(256)]
    for other in (
        lambda: list(toxicity._distinct(iter([]))),
        lambda: list(toxicity._bigrams(spark.sparkContext.broadcast({}))(iter([]))),
        lambda: list(toxicity._unigrams(spark.sparkContext.broadcast({}))(iter([]))),
    ):
        kept = weakref.ref(bpe._mine(bpe.Encoder, "own", tokens, r"\S+"))
        # later tasks of the operator itself find it
        assert kept() is not None and bpe._mine(bpe.Encoder, "own") is kept()
        other()
        assert kept() is None
