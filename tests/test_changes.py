"""Rate anomalies and template differences against brute force and planted cases."""

import random
import statistics
from datetime import datetime, timedelta, timezone
from itertools import product

import pytest
from timberline.operators import anomalies, diff

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def entries(spark, rows):
    return spark.createDataFrame([(START + timedelta(minutes=m) if m is not None else None, text, 1) for m, text in rows], "ts timestamp, message string, n int")


def test_planted_spikes_and_drops(spark):
    rng = random.Random(1)
    rows = [(h * 60 + rng.randrange(60), f"disk {rng.randrange(9)} slow") for h in range(60) for _ in range(rng.randrange(8, 13))]
    rows += [(h * 60 + rng.randrange(60), "user 1 logged in") for h in range(60) if h != 41 for _ in range(rng.randrange(95, 106))]
    rows += [(30 * 60 + rng.randrange(60), "disk 7 slow") for _ in range(400)]
    rows += [(50 * 60, f"panic at {k}") for k in range(40)] + [(None, "user 1 logged in")] * 500
    got = anomalies.rate_anomalies(entries(spark, rows), "1h").collect()
    found = {(r.pattern, (r.start.replace(tzinfo=timezone.utc) - START) // timedelta(hours=1), r.direction, r.severity) for r in got}
    assert found == {
        ("disk <*> slow", 30, "spike", "CRITICAL"), ("user <*> logged in", 41, "drop", "HIGH"), ("panic at <*>", 50, "spike", "CRITICAL")
    }


@pytest.mark.parametrize("history", [6, 9, 24])
def test_scores_against_brute_force(spark, history):
    rng = random.Random(2)
    rows = [(rng.randrange(40 * 60), rng.choice(["a b", "a 1", "c"])) for _ in range(300)] + [(39 * 60, "late")]
    counts = {}
    for minute, text in rows:
        text = text.replace("1", "<*>")
        counts[text, minute // 60] = counts.get((text, minute // 60), 0) + 1
    first = min(h for _, h in counts)
    want = {}
    for text in {t for t, _ in counts}:
        for h in range(first + anomalies.MIN_HISTORY, 40):
            past = [counts.get((text, i), 0) for i in range(max(first, h - history), h)]
            n = counts.get((text, h), 0)
            if n or sum(past):
                median = statistics.median(past)
                apart = statistics.median(abs(x - median) for x in past)
                want[text, h] = (n - median) / max(1.4826 * apart, median**0.5, 1)
    got = anomalies.rate_scores(entries(spark, rows), "1h", history).collect()
    found = {(r.pattern, (r.start.replace(tzinfo=timezone.utc) - START) // timedelta(hours=1)): r.score for r in got}
    assert found == pytest.approx(want)


def test_anomalies_of_nothing(spark):
    assert anomalies.rate_anomalies(entries(spark, []), "1h").collect() == []
    assert anomalies.rate_anomalies(entries(spark, [(None, "a"), (0, ""), (0, None)]), "1h").collect() == []
    with pytest.raises(ValueError, match="history"):
        anomalies.rate_scores(entries(spark, []), "1h", 3)


def templates(spark, rows):
    return spark.createDataFrame([(p, p.split(" "), n) for p, n in rows], "pattern string, tokens array<string>, count bigint")


def brute_diff(before, after, factor):
    totals = [sum(n for _, n in side) for side in (before, after)]

    def agreed(a, b):
        a, b = a.split(" "), b.split(" ")
        if len(a) != len(b) or any(x != y and "<*>" not in (x, y) for x, y in zip(a, b, strict=True)):
            return None
        common = sum(x != "<*>" and y != "<*>" for x, y in zip(a, b, strict=True))
        return common if common or a == b else None

    def best(own, others):
        fits = [(own != p, -agreed(own, p), -n, p) for p, n in others if agreed(own, p) is not None]
        return min(fits)[3] if fits else None

    pairs = {(p, best(p, after)) for p, _ in before} | {(best(p, before), p) for p, _ in after}
    n_before, n_after = dict(before), dict(after)
    out = set()
    for b, a in pairs:
        if b is None or a is None:
            if a is not None and not any(x == a and y is not None for y, x in pairs):
                out.add(("new", None, a, None))
            if b is not None and not any(y == b and x is not None for y, x in pairs):
                out.add(("gone", b, None, None))
            continue
        change = (n_after[a] / totals[1]) / (n_before[b] / totals[0])
        moved = a != b or change >= factor or change * factor <= 1
        out.add(("changed" if moved else "same", b, a, round(change, 9)))
    return out


def found(df):
    return {(r.status, r.before_pattern, r.after_pattern, None if r.change is None else round(r.change, 9)) for r in df.collect()}


def test_diff_by_shape(spark):
    before = [("user <*> logged in", 50), ("disk sda full", 5), ("cache hit", 40), ("job <*> done in <*>", 20), ("<*> <*>", 3), ("old thing happened", 1)]
    after = [("user <*> logged in", 60), ("disk <*> full", 9), ("cache hit", 4), ("job 7 done in <*>", 10), ("job 8 done in <*>", 9), ("<*> <*>", 2), ("new thing started", 2)]
    got = found(diff.diff_templates(templates(spark, before), templates(spark, after)))
    assert got == brute_diff(before, after, 2.0)
    assert {(s, b, a) for s, b, a, _ in got} == {
        ("same", "user <*> logged in", "user <*> logged in"), ("changed", "disk sda full", "disk <*> full"), ("changed", "cache hit", "cache hit"),
        ("changed", "job <*> done in <*>", "job 7 done in <*>"), ("changed", "job <*> done in <*>", "job 8 done in <*>"), ("same", "<*> <*>", "<*> <*>"),
        ("gone", "old thing happened", None), ("new", None, "new thing started"),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diff_against_brute_force(spark, seed):
    rng = random.Random(seed)
    every = [" ".join(t) for n in (1, 2, 3) for t in product(["a", "b", "<*>"], repeat=n)]
    before, after = ([(p, rng.randrange(1, 50)) for p in rng.sample(every, 15)] for _ in range(2))
    assert found(diff.diff_templates(templates(spark, before), templates(spark, after), 3.0)) == brute_diff(before, after, 3.0)


def test_diff_with_nothing(spark):
    some, none = templates(spark, [("a b", 2)]), templates(spark, [])
    assert found(diff.diff_templates(some, none)) == {("gone", "a b", None, None)}
    assert found(diff.diff_templates(none, some)) == {("new", None, "a b", None)}
    assert found(diff.diff_templates(none, none)) == set()


def test_diff_of_logs(spark):
    def log(messages):
        return spark.createDataFrame([("f", i, m, "INFO") for i, m in enumerate(messages, 1)], "file string, line bigint, message string, level string")

    before = log(["service web started on 1"] * 4 + ["queue empty now ok"] * 2)
    after = log(["service web started on 2", "service web started on 3"] + ["queue full now bad"])
    got = {(r.status, r.before_pattern, r.after_pattern) for r in diff.diff_logs(before, after).collect()}
    assert got == {("same", "service web started on <*>", "service web started on <*>"), ("gone", "queue empty now ok", None), ("new", None, "queue full now bad")}
