"""Secret and personal data spans against plain regular expressions."""

import random
import re

import pytest
from timberline.llm import pii, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
BRUTE_SECRETS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}
BRUTE_PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: pii.is_card(m[0])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def brute(kinds, text):
    return {k: [m.span() for m in p.finditer(text) if ok(m)] for k, (p, ok) in kinds.items()}


PIECES = [
    "password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIA0123456789ABCD",
    "deadbeef", "0123456789abcdef", "ABCDEFGH12345678", "a", "é", "漢", "\U0001f600", ".", "-", "/", "\n", "@", "a@b.c", "x.org",
    "1.2.3.4", "300.1.1.1", "+49 30 1234567", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890", "(", "eyJab.eyJcd.ef",
    "ghp_" + "a1" * 18, "ſecret=abcdefghijklmnop",
]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner.of(secrets.RULES)


@pytest.mark.parametrize("block", range(4))
def test_equals_brute_force(scanner, block):
    for seed in range(block * 300, block * 300 + 300):
        check(scanner, random.Random(seed))


def check(scanner, rng):
    text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60)))
    got = secrets.find(scanner, text)
    for kind, want in brute(BRUTE_SECRETS, text).items():
        assert [(s, e) for k, s, e in got if k == kind] == want, (kind, text)
    assert [x[1] for x in got] == sorted(x[1] for x in got)
    found = pii.find(text)
    for kind, want in brute(BRUTE_PII, text).items():
        assert [(s, e) for k, s, e, _ in found if k == kind] == want, (kind, text)


def test_other_rules(scanner):
    text = "x ghp_" + "zQ" * 18 + " eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abc -----BEGIN RSA PRIVATE KEY-----"
    assert [k for k, _, _ in secrets.find(scanner, text)] == ["github", "jwt", "pem"]


def test_context_and_checksums():
    assert [(k, x) for k, _, _, x in pii.find("my card 4111 1111 1111 1111")] == [("card", 0.95)]
    assert [(k, x) for k, _, _, x in pii.find("4111 1111 1111 1111")] == [("card", 0.6)]
    assert [k for k, *_ in pii.find("IBAN GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert pii.find("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert [k for k, *_ in pii.find("ssn 123-45-6789")] == ["ssn"] and pii.find("no. 123-45-6789") == []


def test_long_runs(scanner):
    for run in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "token=" + "x" * 200_000):
        secrets.find(scanner, run)
        pii.find(run)


def test_empty(scanner):
    assert secrets.find(scanner, None) == secrets.find(scanner, "") == pii.find(None) == pii.find("") == []


def test_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "x"), (1, "token = abcdefghijklmnop", "y"), (1, "token = abcdefghijklmnop", "y"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string")
    got = docs.select(F.size(secrets.secret_spans(spark, docs["text"])).alias("n"), F.size(pii.pii_spans(docs["text"])).alias("m"))
    assert sorted(r.n for r in got.collect()) == [0, 0, 1, 1]
    assert docs.limit(0).select(secrets.secret_spans(spark, docs["text"]), pii.pii_spans(docs["text"])).count() == 0


def test_iban_before_other_words():
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"{iban} BIC COBADEFF", f"{iban} 17 EUR", f"AB12 CDEF GHIJ KLM {iban}", f"DE00 3704 0044 0532 0130 00 {iban} X"):
        at = text.index(iban)
        assert [(s, e) for k, s, e, _ in pii.find(text) if k == "iban"] == [(at, at + len(iban))]
    assert not [x for x in pii.find(iban + "A") if x[0] == "iban"]
