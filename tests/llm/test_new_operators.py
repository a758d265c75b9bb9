"""Manifest, quality votes and importance resampling: brute force and odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from timberline.llm import importance, merkle, neighbours

# names that the operators use inside stand in the tables as well
DOCS = (
    "doc_id bigint, text string, source string, lang string, n_chars int, tree string, idx int, digest string, id string, "
    "row int, score int, rank int, n_words int, nodes string, steps string, _part int"
)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None if t is None else len(t), "x", 7, "x", "x", 1, 2, 3, 4, "x", "x", 5) for i, t, s in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- manifest

def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def brute_manifest(rows, tampered=()):
    def leaf(i, t, s):
        fields = (i, s, "en", None if t is None else len(t), t)
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    groups = defaultdict(list)
    for i, t, s in rows:
        other = t.replace("\n", "") if i in tampered and t else t
        n = None if t is None else len(t)
        fields = (i, s, "en", n, other)
        changed = sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))
        groups[s].append((i is not None, i or 0, leaf(i, t, s), changed, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for place, (_, _, own, changed, i) in enumerate(sorted(groups[s])):
            steps = path(trees[s], place) + path(top, k)
            folded = changed
            for before, after in steps:
                folded = sha(before + folded + after)
            out.append((i, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded))
    return out


def manifest_rows(docs, tampered=()):
    text = F.when(docs["doc_id"].isin(*tampered), F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    proofs = merkle.manifest(docs, changed={"text": text} if tampered else None)
    return [
        tuple(r) for r in proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("p"), "folded_root").collect()
    ]


def order(rows):
    return sorted(rows, key=str)


def test_manifest_against_brute_force(spark):
    rng = random.Random(4)
    # sizes around the powers of three, one source beyond two bands, more sources than one run
    sizes = {None: 2, "": 1, "a": 3, "b": 4, "c": 9, "d": 10, "é": 27, "e": 81, "f": 82, "g": 700}
    rows = [(i, f"line {rng.random()}\nend", s) for s, n in sizes.items() for i in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    tampered = {r[0] for r in rows if r[0] % 2}
    assert order(manifest_rows(documents(spark, rows), tampered)) == order(brute_manifest(rows, tampered))


def test_manifest_odd_rows(spark):
    rows = [(1, None, None), (1, "", "a"), (None, "word", "a"), (None, "word", "a"), (2, "x " * 50_000, "b"), (3, "same", "b"), (3, "same", "b"), (3, "other", "b")]
    got = manifest_rows(documents(spark, rows))
    assert order(got) == order(brute_manifest(rows))
    assert all(r[3] == r[5] for r in got)
    assert manifest_rows(documents(spark, rows).limit(0)) == []
    (alone,) = manifest_rows(documents(spark, rows[:1]))
    assert alone[1] == alone[2] == alone[3] and alone[4] == sha("")


def test_manifest_without_change_always_verifies(spark):
    rows = [(i, f"t{i}", f"s{i % 4}") for i in range(300)]
    got = manifest_rows(documents(spark, rows))
    assert len(got) == 300 and all(r[3] == r[5] for r in got) and len({r[3] for r in got}) == 1


# -- importance resampling

def brute_resample(rows, target, min_words=20, percent=10, ngram=1, size=10_000):
    def features(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        return len(words), [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]

    def counts(texts):
        return Counter(crc32(f.encode()) % size for t in texts for f in features(t)[1])

    s, t = counts(x[1] for x in rows), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(text):
        b = crc32(text.encode()) % size
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size))))

    scored = []
    for i, text, _ in rows:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    fit = sorted((r for r in scored if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return [(*r[:4], r[5]) for r in scored]


@pytest.mark.parametrize(("percent", "sketch", "ngram"), [(10, 10_000, 1), (37, 3, 2), (100, 100, 1), (0, 100, 1)])
def test_resample_against_brute_force(spark, percent, sketch, ngram):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Apfel", "pear", "fig9", "Ähre", "kiwi"]) + rng.choice([" ", ", "]) for _ in range(rng.randrange(5, 60))), "s") for i in range(400)]
    # copies of a row share id and score
    rows += [rows[7]] * 30 + [(None, "pear " * 30, "s"), (None, None, "s"), (500, "", "s"), (501, "fig9 " * 30_000, "s")]
    target = ["pear pear kiwi", None, "Ähre!", ""]
    items = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id int, text string, score int")
    got = importance.resample(documents(spark, rows), items, percent=percent, sketch=sketch, ngram=ngram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(tuple(r) for r in got.collect()) == order(brute_resample(rows, target, percent=percent, ngram=ngram))


def test_resample_empty_tables(spark):
    items = spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(documents(spark, []), items).collect() == []
    rows = [(i, "a b c " * 10, "s") for i in range(20)]
    got = importance.resample(documents(spark, rows), items).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_cutoff_widens_its_bracket(spark):
    # most scores are equal, so that a narrow bracket misses
    rows = spark.createDataFrame([(i, 5 if i % 10 else i, 0, 0, i) for i in range(500)], "id bigint, score bigint, weight bigint, n_features bigint, row bigint")
    every = sorted(((-r.score, r.id) for r in rows.collect()))
    for drawn in (1, 30, 250, 499):
        last = importance.cutoff(rows, drawn, 500, sketch=50)
        assert (-last["score"], last["id"]) == every[drawn - 1]


# -- quality votes

def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "light", "garden", "quiet", "window"]) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    return " ".join(rng.choice(["BUY", "NOW", "CHEAP"]) + rng.choice(["!!", "$$"]) for _ in range(n))


def test_votes_on_held_out_rows(spark):
    rng = random.Random(6)
    rows = [(i, (prose if i % 4 else junk)(rng, rng.randrange(8, 80)), "s") for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id bigint, quality int")
    model = neighbours.fit(docs, labels)
    assert len(model.voters) == sum(crc32(str(i).encode()) % 4 != 2 for i in range(400))
    got = docs.select("doc_id", neighbours.scores(model, docs["text"], docs).alias("s")).collect()
    held = [r for r in got if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and all((r.s >= 0.7) == (r.doc_id % 4 > 0) for r in held)


def test_votes_are_exact(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "bb", "C!", "d9"], rng.integers(1, 30))) for _ in range(300)] + [None, ""]
    voters = rng.standard_normal((5000, 8)).astype(np.float32)
    voters /= np.linalg.norm(voters, axis=1, keepdims=True)
    axes = rng.standard_normal((neighbours.TERMS, 8)).astype(np.float32)
    y, weight = rng.integers(0, 2, 5000), rng.random(5000)
    model = neighbours.Model(np.ones(neighbours.TERMS), axes, voters, y, weight, 0.25)
    want = []
    for text in texts:
        similar = (model.latent([text]) @ voters.T)[0].astype(np.float64)
        best = sorted(range(5000), key=lambda k: (-similar[k], k))[: neighbours.NEIGHBOURS]
        votes = {k: max(0.0, similar[k]) ** neighbours.SHARPNESS * weight[k] for k in best}
        want.append(sum(v * y[k] for k, v in votes.items()) / sum(votes.values()) if sum(votes.values()) else 0.25)
    assert np.allclose(model.scores(texts), want, atol=1e-4)


def test_votes_odd_rows(spark):
    rows = [(1, None, None), (1, "", "a"), (None, "word", "a"), (3, "x " * 60_000, "b"), (3, "x " * 60_000, "b"), (4, "plain words", "b"), (5, "\x00퟿", "b")]
    docs = documents(spark, rows)

    def scored(labels):
        model = neighbours.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, text string"))
        return {(r.doc_id, r.text): r.s for r in docs.select("doc_id", "text", neighbours.scores(model, docs["text"], docs).alias("s")).collect()}

    assert set(scored([]).values()) == {0.5}
    got = scored([(3, 0, "t"), (3, 1, "t"), (4, 0, "t"), (None, 1, "t"), (4, None, "t"), (99, 1, "t")])
    assert got[1, None] == got[1, ""] == 2 / 3
    assert got[3, "x " * 60_000] > 0.9
    assert set(scored([(3, 1, "t")]).values()) == {1.0}
    model = neighbours.fit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert docs.limit(0).select(neighbours.scores(model, docs["text"], docs)).collect() == []
