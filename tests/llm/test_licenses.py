"""License scans against exact containment over all windows."""

import math
import random
import re

from timberline.llm import licenses


def brute(text):
    words = [w for w in re.split("[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    pairs = list(zip(words, words[1:], strict=False))
    found = set()
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        own = [w for w in re.split("[^a-z0-9]+", template.lower()) if w]
        need = set(zip(own, own[1:], strict=False))
        step = licenses._length_class(len(own))
        for start in range(0, max(1, len(pairs)), step):
            share = len(need & set(pairs[start : start + 2 * step - 1])) / len(need)
            if share >= licenses.CONTAINMENT:
                found.add((name, k, start, share))
    return found


def test_probability():
    for _, text in licenses.TEMPLATES:
        n = len([w for w in re.split("[^a-z0-9]+", text.lower()) if w])
        step = licenses._length_class(n)
        assert step >= n or n < 4
        assert 2 * step - 1 <= licenses.SPREAD * (n - 1) or n < 4
    assert licenses.collision_probability(licenses.CONTAINMENT / licenses.SPREAD) > 0.9999


def test_equals_brute_force(spark):
    rng = random.Random(3)
    common = "the of and a license under this public work in permission copy licensed version to terms".split()
    rows = [(0, None, 1), (1, "", 1), (2, "one", 1), (3, "All rights reserved.", 1), (3, "All rights reserved.", 1)]
    for i in range(10, 160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += rng.choices(common, k=rng.randrange(120))
            own = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "changed"
            parts += own
        rows.append((i, " ".join(parts), i))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license bigint")
    got = {(r.doc_id, r.license, r.template, r.first_word, round(r.containment, 9)) for r in licenses.license_windows(docs).collect()}
    want = {(i, name, k, start, round(share, 9)) for i, text, _ in rows for name, k, start, share in brute(text)}
    assert got == want and len(want) > 300
    assert licenses.licenses(docs).where("doc_id = 3").collect()[0].n_windows == math.ceil(1)
    assert licenses.licenses(docs.limit(0)).count() == 0
