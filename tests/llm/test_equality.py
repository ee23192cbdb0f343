"""Words, units and lines count as equal by what they hold, not by their hashes."""

import numpy as np
import pytest

from helixframe.llm import common, decontaminate, licenses, tokencount
from tests.llm.test_operators import brute_hits, table


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


ONE, TWO = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_long_words_of_equal_sums(spark):
    bench = spark.createDataFrame([(1, TWO), (2, f"{ONE} x y")], "item_id long, text string")
    docs = [ONE, TWO, f"{ONE} x y", f"{TWO} x y"]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(table(spark, docs), bench).collect()}
    assert got == {k: brute_hits(x, [(1, TWO), (2, f"{ONE} x y")]) for k, x in enumerate(docs)}
    assert [s["label"] for r in licenses.scan(table(spark, [f"{ONE} q r"]), (), (("l", f"{TWO} q r"),)).collect() for s in r["spans"]] == []
    vocabulary = [b"ab", b"ba", b"aba", b"bb", b"abba"]
    n = [r["n_tokens"] for r in tokencount.count(table(spark, [ONE, TWO, f"{ONE}\n{TWO}"]), vocabulary).orderBy("doc_id").collect()]
    assert n[0] != n[1] and n[2] == n[0] + n[1] + 1


def test_vocabulary_of_colliding_hashes(monkeypatch):
    """Hashes that collide under some seeds: another one is taken; words that collide with the vocabulary's aren't found."""
    true = common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda d, s, e, seed=0: true(d, s, e, seed) & np.uint64(1 if seed < 2 else 0xFF))
    words = common.words_of(["one two three", "two four", None])
    v = common.Vocabulary(words)
    assert v.seed >= 2 and len(set(v.numbers.tolist())) == 4 and v.numbers[1] == v.numbers[3]
    other = common.words_of([" ".join(f"w{k}" for k in range(2000)) + " four ONE"])
    found = v.find(other)
    assert (found[:-2] == -1).all() and found[-2:].tolist() == [v.numbers[4], v.numbers[0]]


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
def test_spans_of_any_length(size):
    raw = np.frombuffer(bytes(range(1, 251)) * 60, np.uint8)
    a, b = np.array([0, 250, 1]), np.array([size, 250 + size, 1 + size])
    h = common.span_hashes(raw, a, b)
    assert h[0] == h[1] and (size == 0 or h[0] != h[2])
    same = common.same_spans(raw, a[[0, 0]], raw, a[[1, 2]], np.array([size, size]))
    assert same.tolist() == [True, size == 0]
