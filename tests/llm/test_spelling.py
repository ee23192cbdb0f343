"""Spelling variants against brute force: all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import common, queries, spelling

FOLD = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, n long, word string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "w", 2) for i, x in rows], SCHEMA).repartition(3)


def brute_counts(rows, every=97):
    out = Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    form, out = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n[w], out[w], n.get(form.get(w))))
    return rows


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abé", k=rng.randint(4, 7))) for _ in range(60)] + ["Straße", "STRASSE", "straßen", "ÀÉÎõü", "àéîõü", "naïve×÷", "aaaaaa", "aaaaa", "aaaaaaa", "aabbaa", "aabaa"]
    texts = [rng.choice([" ", "\n", "-", "日本", "."]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 200))) for _ in range(40)]
    texts += [None, "", " ", "1234", texts[0], "z" * 3000, "z" * 3000 + "y", ("z" * 2999 + " ") * 5, ("z" * 3000 + " ") * 3, ("z" * 3000 + "y ") * 3, "x" * 700 + " ", "ünder " * 4000]
    return [(k if k % 9 else None if k % 2 else 4, x) for k, x in enumerate(texts)]


def test_against_all_pairs(spark, rows):
    want = brute_counts(rows)
    counts = spelling.word_counts(frame(spark, rows))
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    assert got(spelling.variants(counts)) == brute_variants(want)
    plain = spelling.word_counts(frame(spark, rows), every=None)
    assert {r["word"]: r["n"] for r in plain.collect()} == brute_counts(rows, None)


def test_words_that_lose_a_letter_often(spark, rows):
    """Every other run loses one: many variants of few words, ties of n, chains of forms."""
    want = brute_counts(rows, 2)
    counts = spelling.word_counts(frame(spark, rows), every=2)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    assert got(spelling.variants(counts)) == brute_variants(want)


def test_the_query_on_a_small_table(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.queries()["op11_spelling"](spark, str(tmp_path))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and [t for _, t in df.dtypes[3:]] == ["bigint"] * 3
    assert got(df) == brute_variants(brute_counts(rows))


def test_no_words(spark):
    for rows in ([], [(1, None), (None, ""), (2, "a b c")]):
        assert got(spelling.variants(spelling.word_counts(frame(spark, rows)))) == set()
    lone = spark.createDataFrame([("hello", 3), ("world", 9)], "word string, n long")
    assert got(spelling.variants(lone)) == {("hello", None, "hello", 3, 0, None), ("world", None, "world", 9, 0, None)}


def test_chains_lead_to_the_last_form(spark):
    words = [("a" * k + "b" * (20 - k), 2**k) for k in range(20)]
    df = spelling.variants(spark.createDataFrame(words, "word string, n long"))
    assert got(df) == brute_variants(dict(words)) and {r["root"] for r in df.collect()} == {"a" * 19 + "b"}


def test_numbers_that_collide_give_no_wrong_pairs(spark, monkeypatch, rows):
    """Node numbers cut down to two bits: pairs are held against letters."""
    words = spark.createDataFrame(sorted(brute_counts(rows[:8], 2).items()), "word string, n long").coalesce(1)
    want = brute_variants({r["word"]: r["n"] for r in words.collect()})
    numbers, nodes = spelling.numbered, spelling.nodes
    held = numbers(words)
    few = nodes(held).withColumns({"p": F.pmod("p", F.lit(2)), "s": F.pmod("s", F.lit(2))})
    monkeypatch.setattr(spelling, "numbered", lambda _: held)
    monkeypatch.setattr(spelling, "nodes", lambda _: few)
    assert got(spelling.variants(words)) == want


def test_tries_number_equal_paths_alike():
    words = ["abc", "abd", "b", "", "abcabc" * 40, "xbc"] + ["ab"] * 30
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    prefix, suffix = spelling.tries(letters, np.cumsum(sizes) - sizes, sizes)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    names: dict = {}
    for side, numbers in (("p", prefix), ("s", suffix)):
        for w, b in zip(words, base.tolist(), strict=True):
            for k in range(len(w) + 1):
                names.setdefault(w[:k] if side == "p" else w[k:][::-1], set()).add(int(numbers[b + k]))
    assert all(len(x) == 1 for x in names.values()) and len({next(iter(x)) for x in names.values()}) == len(names)


def test_fragments_cut_before_borders_only():
    data = np.frombuffer(b"aa bb cc" * 9 + b"a" * 50 + b" b" + b"x" * 30, np.uint8)
    at = np.array([0, 0, 72, 72, 124, 154], np.int64)
    border = np.zeros(256, bool)
    border[32] = True
    for limit in (1, 5, 10, 60, 1000):
        seen = {}
        for row, part, own in common.fragments(data, at, border, limit):
            for r, a, b in zip(row.tolist(), own[:-1].tolist(), own[1:].tolist(), strict=True):
                seen.setdefault(r, []).append(part[a:b].tobytes())
        assert all(b"".join(seen.get(r, [])) == data[at[r] : at[r + 1]].tobytes() for r in range(5))
        assert all(x[:1] == b" " for parts in seen.values() for x in [y for y in parts if y][1:])
