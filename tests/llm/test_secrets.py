"""Rules that run in linear time against their plain expressions."""

import random
import re
import time

from helixframe.llm import secrets
from tests.llm.test_operators import table

RULES = {r.kind: r for r in secrets.RULES}


def test_linear_rules_match_as_their_patterns_do():
    rng = random.Random(5)
    parts = {
        "jwt": ["eyJ", "eyJ", "abcdefgh", "a", ".", ".", "-", " ", "eyJabcdefgh.", "eyJabcdefgh.eyJ01234567.xyzxyzxy", "é"],
        "url": ["http", "s3", "://", "u", ":", "p", "@", "/", " ", "a+b", ".", "-", "https://me:pw@", "!", "é"],
    }
    for kind, pool in parts.items():
        rule, some = RULES[kind], 0
        for _ in range(20_000):
            text = "".join(rng.choices(pool, k=rng.randint(1, 14)))
            want = [(m.start(), m.end(), m.end() - m.start()) for m in re.compile(rule.pattern, re.ASCII).finditer(text)]
            assert rule.matches(text) == want, text
            some += bool(want)
        assert some > 100


def test_crafted_texts_take_linear_time(spark):
    n = 1_000_000
    crafted = ["eyJ" * n, "eyJ" + "eyJabcdefgh.eyJ" * (n // 5), "a" * 3 * n, "ab://" + "c" * 3 * n + ":", "x://y" * (n // 2), "ghp_" * n, "-----BEGIN " + "A " * n, "token" + " " * 3 * n, "f" * 31 + "g" + "AKIA" * n]
    start = time.time()
    found = secrets.find(table(spark, crafted)).selectExpr("doc_id", "size(spans) n").collect()
    assert len(found) == len(crafted) and time.time() - start < 60


def test_schemes_of_any_kind(spark):
    texts = ["postgresql+psycopg2://u:p@h", "s3://key:secret@x", "HTTPS://u:p@h", "(averyveryverylongscheme://u:p@h)"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find(table(spark, texts)).collect()}
    assert got == {0: [("url", 0, 26)], 1: [("url", 0, 16)], 2: [("url", 0, 12)], 3: [("url", 1, 31)]}
