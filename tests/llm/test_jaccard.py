"""Jaccard components against all pairs."""

import random
import re

import numpy as np
from timberline.llm import jaccard


def sets(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(own)):
        for y in range(x):
            a, b = own[x][1], own[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    groups = {}
    for x, (i, _) in enumerate(own):
        groups.setdefault(find(x), []).append(i)
    return sorted((i, len(s), min(groups[find(x)])) for x, (i, s) in enumerate(own))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "Ünd", "THE", "the"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(40) for _ in range(3)]
    texts = [None, "", "  \t", "one", "one", "ONE two", "one two", "a b c d", "a  b\tc\nd"]
    for _ in range(25):
        base = prose(rng.randrange(5, 120))
        if rng.random() < 0.5:
            base += rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                own += prose(rng.randrange(30))
            texts.append(" ".join(own))
    texts += [texts[-1]] * 5
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_equals_all_pairs(spark):
    for seed, cold in ((1, 8), (2, 2), (3, 3)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, class string").repartition(5)
        got = jaccard.jaccard_components(docs, cold=cold, table_bits=12 if seed == 3 else 22)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id bigint, text string")
    got = jaccard.jaccard_components(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (3, 3)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_hashes():
    rng = random.Random(4)
    texts = [t for _, t in corpus(9)] + ["x" * 100_000, "é" * 3, " ".join(["a"] * 1000)]
    rng.shuffle(texts)
    for together, alone, text in zip(jaccard.shingle_sets(texts), (jaccard.shingle_sets([t])[0] for t in texts), texts, strict=True):
        assert np.array_equal(together, alone) and len(alone) == len(sets(text))


def test_sketches_never_part_linked_sets(spark):
    rng = random.Random(8)
    for _ in range(50):
        one = np.array(sorted(rng.sample(range(1 << 60), 200)), np.uint64)
        other = np.union1d(one[rng.randrange(40) :], np.array(rng.sample(range(1 << 60), rng.randrange(1, 40)), np.uint64))
        apart = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in jaccard.sketch(one) ^ jaccard.sketch(other))
        assert apart <= len(np.setxor1d(one, other))
    assert len(jaccard.sketch(np.zeros(0, np.uint64))) == jaccard.SKETCH


def test_a_large_group_of_near_copies(spark):
    # any two link with an even chance, and others share a passage with them that makes up most of their text
    rng = random.Random(9)
    base = ["b%d" % rng.randrange(10**6) for _ in range(150)]
    passage = ["p%d" % rng.randrange(10**6) for _ in range(60)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(150), 3):
            own[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(passage + ["u%d" % rng.randrange(10**6) for _ in range(12 + i % 9)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = jaccard.jaccard_components(docs, cold=3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_rows_of_busy_keys_are_joined_in_parts(spark):
    from timberline.llm.common import dealt_join

    rows = spark.range(100).selectExpr("if(id < 50, 0, id) k", "id")
    side = spark.range(100).selectExpr("id k", "id * 2 twice")
    joined = dealt_join(rows, side, ["k"], ["id"], busy=40)
    assert sorted(tuple(r) for r in joined.select("id", "twice").collect()) == [(i, 0 if i < 50 else 2 * i) for i in range(100)]


def test_members_whose_own_text_is_more_than_a_quarter_make_no_pairs(spark):
    # long sets, of which sketches of everything say nothing: a passage and own text; two of them do link
    rng = random.Random(10)
    words = lambda mark, n: [f"{mark}{rng.randrange(10**9)}" for _ in range(n)]
    passage = words("p", 700)
    texts = [passage + words(f"u{i}x", 500) for i in range(12)]
    texts.append(texts[0][:1150] + words("v", 50))
    found = jaccard.shingle_sets([" ".join(t) for t in texts])
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    common = sorted(set.intersection(*(set(s.tolist()) for s in found)))[:20]
    many = [(signed(key), i, len(s), place) for i, s in enumerate(found) for place, key in enumerate(common)]
    many = spark.createDataFrame(many, "key bigint, class bigint, n bigint, place int")
    labels = spark.createDataFrame([], "node bigint, label bigint")
    sets_ = spark.createDataFrame(
        [(i, bytearray(s.tobytes()), *map(int, jaccard.sketch(s))) for i, s in enumerate(found)],
        "class bigint, own binary, " + ", ".join(f"w{k} bigint" for k in range(jaccard.SKETCH)),
    )
    pairs = jaccard._residual(many, labels, sets_)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 12)]
    assert [(r.a, r.b) for r in jaccard._verified(pairs, sets_).collect()] == [(0, 12)]


def test_a_passage_of_many_components_makes_one_row_a_shingle(spark):
    # 40 components hold a passage; what is foreign is the passage, and two sets of one component share more than that
    rng = random.Random(11)
    number = lambda: rng.randrange(1, 1 << 64)
    passage, twins = [number() for _ in range(90)], [number() for _ in range(10)]
    found = [np.array(sorted(passage + (twins if i < 2 else [number() for _ in range(10)])), np.uint64) for i in range(40)]
    found.append(np.array(sorted(passage + [number() for _ in range(31)]), np.uint64))
    label = [0, 0, *range(2, 41)]
    rows = jaccard._ends(found, label)
    assert rows.num_rows == 90 + 10 + 38 * 10 + 31
    holders = {}
    for own, of in zip(found, label, strict=True):
        for x in own.astype(np.int64).tolist():
            holders.setdefault(x, set()).add(of)
    got = {r["shingle"]: (r["low"], r["high"]) for r in rows.to_pylist()}
    assert got == {x: (min(of), max(of)) for x, of in holders.items()}

    own = spark.createDataFrame(
        [(place, i, of, place) for i, of in enumerate(label) for place in range(i % 3, 3)], "key bigint, class bigint, label bigint, place int"
    )
    sets_ = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(found)], "class bigint, own binary")
    left = {r["class"]: r for r in jaccard._foreign(own, sets_, 22).collect()}
    # 90 of 121 are less than three quarters
    assert set(left) == set(range(40)) and {r.e for r in left.values()} == {90}
    words = [int(w) for w in jaccard.sketch(np.array(sorted(passage), np.uint64))]
    assert all([r[f"w{k}"] for k in range(jaccard.SKETCH)] == words for r in left.values())


def test_rounds_of_components_count_busy_links_once(spark, monkeypatch):
    from timberline.llm import common, components

    written = []

    def counted(df, name="table"):
        written.append(name)
        return materialize(df, name)

    materialize = common.materialize
    monkeypatch.setattr(common, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(160, 101), (7, 7)]
    got = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3))
    assert {r.node: r.label for r in got.collect()} == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 161)}
    rounds = written.count("least")
    assert rounds > 1 and written.count("busy") == rounds + 1
