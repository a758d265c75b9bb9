"""BPE against the tiktoken library."""

import random

import pandas as pd
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from timberline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABETS = ["abcdefgh ", "the and ing tion er\n", "ab", "a", "éàçñß ", "漢字仮名 。", "\U0001f600\U0001f468‍ ", " \t\n\r ", "0123456789.,;!?'\"()", "еёжзи ", "aAbB'sre 'll've"]


@pytest.fixture(scope="module")
def tokens():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def known(tokens):
    ranks = {t: i for i, t in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    for _ in range(1500):
        own = rng.choice(ALPHABETS) if rng.random() < 0.7 else "".join(ALPHABETS)
        yield "".join(rng.choice(own) for _ in range(rng.choice([0, 1, 5, 30, 200])))
    yield from ("a" * 3000, "ab" * 2000, " " * 3000, "\n" * 999, "x" * 1001, "é" * 999, "the" * 800)


def test_equals_library(tokens, known):
    encoder, decoder = bpe.Encoder(tokens, P.PATTERN), bpe.Decoder(tokens)
    for text in texts():
        ids = encoder.encode(text)
        assert ids == known.encode_ordinary(text), text
        assert decoder.decode(ids) == text


def test_splitting(tokens):
    encoder = bpe.Encoder(tokens, P.PATTERN)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab '\u00e9\u00d7\u00b2\u00bd\u00aa\x85\xa0\x1c\n\t 12-_$s'reldvmt!") for _ in range(rng.randrange(40)))
        assert encoder.split(text) == encoder.split_any(text), text


def test_documents(tokens, known):
    encoder = bpe.Encoder(tokens, P.PATTERN)
    for text in pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"]:
        assert encoder.encode(text) == known.encode_ordinary(text)


def test_runs_of_a_letter(tokens, known):
    own = bpe.Transducer(tokens)
    for letter in "abcdefghijklmnopqrstuvwxyz=-_.é":
        for n in range(1, 70):
            for piece in (letter * n, " w" + letter * n, letter * n + "x"):
                for part in regex.findall(P.PATTERN, piece):
                    assert own.encode(part.encode()) == known.encode_ordinary(part), part


def test_few_states(tokens, known):
    small = bpe.Transducer(tokens, max_states=50)
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeèthing") for _ in range(rng.randrange(1, 40))).encode()
        want = [t for t in [small.ranks.get(piece)] if t is not None] or small.merged(piece)
        assert small.encode(piece) == want
        assert len(small.states) < 150


def test_long_pieces_are_emitted_early(tokens, known):
    own = bpe.Transducer(tokens)
    rng = random.Random(5)
    for alphabet in ("a", "ab", "thinger", "éa"):
        piece = "".join(rng.choice(alphabet) for _ in range(5000))
        assert own.encode(piece.encode()) == known.encode_ordinary(piece)


def test_broken_bytes_and_blocks(tokens):
    decoder = bpe.Decoder(tokens)
    ids = [decoder.tokens.index(bytes([b])) for b in "aé漢\U0001f600".encode()]
    assert decoder.decode(ids) == "aé漢\U0001f600"
    assert decoder.decode(ids[:-1]) == "aé漢�"
    assert len(list(decoder.blocks(ids * 5000))) > 1 and "".join(decoder.blocks(ids * 5000)) == "aé漢\U0001f600" * 5000


def test_blocks_equal_whole(tokens, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH_TOKENS", 3)
    decoder, rng = bpe.Decoder(tokens), random.Random(6)
    odd = [i for i, x in enumerate(decoder.odd) if x]
    for _ in range(2000):
        ids = [rng.choice(odd) if rng.random() < 0.5 else rng.randrange(len(tokens)) for _ in range(rng.randrange(20))]
        assert decoder.decode(ids) == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def test_tables(spark, tokens):
    rows = [(1, None, None), (1, "", "x"), (2, "hello world", "y"), (2, "hello world", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    ids = bpe.encode(spark, docs["text"], tokens, P.PATTERN)
    got = docs.select("doc_id", ids.alias("t")).select("doc_id", "t", bpe.decode(spark, F.col("t"), tokens).alias("d"))
    assert sorted((r.doc_id, len(r.t), r.d) for r in got.collect()) == [(1, 0, ""), (1, 0, ""), (2, 3, "hello world"), (2, 3, "hello world")]
    assert docs.limit(0).select(ids).count() == 0
