"""The pipeline against a brute-force version of every stage on small tables."""

import random
import re

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_jaccard import brute as jaccard_brute
from timberline.llm import bpe, toxicity
from timberline.llm.queries import ORACLE

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(7)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(200)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    menu = " ".join(prose(25))
    items = [" ".join(prose(20)) for _ in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.randrange(30, 120))
        if i % 6 == 0:
            for _ in range(5):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "foul"]))
        if i % 11 == 0:
            text += rng.choice(items).upper().split()
        if i % 7 == 0:
            text += ["\n" + menu]
        labels.append((i, i % 2, int(i % 6 == 0)))
        rows.append((i, " ".join(text).replace(" \n", "\n"), "en", f"src{i % 3}"))
        if i % 10 == 3:  # copies, some with edits all over
            for k in range(3):
                own = list(text)
                for at in range(k, len(own), 90):
                    own[at] = "edited"
                rows.append((1000 + 10 * i + k, " ".join(own).replace(" \n", "\n"), "en", "src0"))
    rows += [(5000, None, None, None), (5001, "", "en", "src1"), (5002, " \n ", "en", "src1")]
    path = tmp_path_factory.mktemp("tables")
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    docs["n_chars"] = docs["text"].map(lambda t: None if t is None else len(t)).astype("Int64")
    docs.to_parquet(path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(path / "labels.parquet")
    pd.DataFrame({"item_id": range(5), "text": items}).to_parquet(path / "benchmark.parquet")
    return str(path)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    # toxicity: the model's own scores decide, and it is right about its rows
    first = corpus_pipeline.drop_toxic(spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = dict(zip(docs.toPandas()["doc_id"], model.scores(model.differences(docs.toPandas()["text"])), strict=True))
    got = first.toPandas()
    assert first.columns == columns and set(got["doc_id"]) == {i for i, s in score.items() if s < 0.3}
    assert sum(i % 6 == 0 for i in got["doc_id"] if i < 240) <= 6 and sum(i % 6 != 0 for i in got["doc_id"] if i < 240) >= 190

    # line dedup: its SQL
    second = corpus_pipeline.dedup_lines(spark, first, folder)
    assert second.columns == columns
    con = duckdb.connect()
    con.register("documents", got)
    want = con.execute(ORACLE["op2_line_dedup"]).df()
    want = {r.doc_id: r.text for r in want.itertuples() if not r.depleted}
    got = second.toPandas()
    text = {r.doc_id: r.text for r in got.itertuples()}
    assert {i: t for i, t in text.items() if t} == {i: t for i, t in want.items() if t} and set(text) == set(want)
    assert all(r.n_chars == len(r.text) for r in got.itertuples() if r.text)

    # one document of each group
    third = corpus_pipeline.dedup_documents(spark, second, folder)
    kept = {i for i, _, first_id in jaccard_brute([(i, t if isinstance(t, str) else None) for i, t in text.items()]) if i == first_id}
    assert set(third.toPandas()["doc_id"]) == kept and len(kept) < len(text)

    # no document with ten words of an item, or all words of a shorter one
    fourth = corpus_pipeline.drop_contaminated(spark, third, folder)
    items = [words(t) for t in pd.read_parquet(f"{folder}/benchmark.parquet")["text"]]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}

    def clean(t):
        own = words(t)
        return not any(tuple(own[i : i + len(w)]) == w for w in windows for i in range(len(own) - len(w) + 1))

    left = {i for i in kept if clean(text[i])}
    assert set(fourth.toPandas()["doc_id"]) == left and len(left) < len(kept)

    # tokens
    last = corpus_pipeline.tokenize(spark, fourth, folder).toPandas()
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(corpus_pipeline.VOCABULARY))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.round_trip and list(r.ids) == known.encode_ordinary(t if isinstance(t := text[r.doc_id], str) else "") for r in last.itertuples())
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == list(last.columns)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(last["doc_id"])
    assert whole.where(F.col("n_tokens") == 0).count() == (last["n_tokens"] == 0).sum()


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def write(path, rows):
    docs = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(lang="en", source="s")
    docs["n_chars"] = docs["text"].str.len()
    docs.to_parquet(path / "documents.parquet")
    return str(path)


def test_own_text_beside_a_passage(spark, tmp_path):
    passage = " ".join(f"p{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(90))
    rows = [(1, passage + "\nfirst of all"), (2, "words of its own\n" + passage), (3, passage), (4, passage + "\n \n")]
    folder = write(tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, folder).collect()}
    assert got == {1: rows[0][1], 2: "words of its own"}


def test_copies_are_gone(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    wrapped = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    rows = []
    for i in range(4):
        long, short, own = prose(150), prose(2), prose(8)
        one = " ".join(long[:100]) + "\n" + " ".join(short) + "\n" + wrapped(long[100:])
        near = one.replace(long[40], "edited").replace(long[120], "edited") + "\n" + " ".join(own)
        rows += [(10 * i, one), (10 * i + 1, one), (10 * i + 2, near)]
    passage = prose(60)
    rows += [(100, wrapped(prose(60) + passage)), (101, "\n".join([" ".join(prose(15)), wrapped(passage), "the end"]))]
    rows += [(102, "\n".join(["8 1 2 3 4"] * 6)), (103, "\n".join(["8 1 2 3 5"] * 6))]
    folder = write(tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    second = corpus_pipeline.dedup_lines(spark, docs, folder)
    text = {r.doc_id: r.text for r in second.collect()}
    assert text[101] == rows[-3][1].split("\n")[0] + "\nthe end"
    assert not {1, 11, 21, 31} & set(text) and {102, 103} <= set(text)
    third = corpus_pipeline.dedup_documents(spark, second, folder)
    assert {r.doc_id for r in third.collect()} == {0, 10, 20, 30, 100, 101, 102, 103}


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rng = random.Random(12)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    rows = [(1, prose), (1, prose), (2, prose), (3, other), (3, other), (4, None), (4, None), (5, ""), (None, "no id here"), (None, None), (6, "x " * 60_000)]
    folder = write(tmp_path, rows)
    docs = pd.read_parquet(f"{folder}/documents.parquet").astype({"doc_id": "Int64", "n_chars": "Int64"})
    # names that the stages use inside
    docs = docs.assign(deduped="d", _dropped_lines=1, class_=2, again=3, first="f", of=4)
    docs.to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}).to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [None]}).astype({"text": "string"}).to_parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "round_trip").collect()
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    assert ids == [(False, 0), (False, 0), (True, 1), (True, 3), (True, 4), (True, 5), (True, 6)]
    assert all(r.round_trip for r in got)
