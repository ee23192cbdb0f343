"""Very long and repetitive texts, and many languages: results, seconds and memory."""

import random
import resource
import time
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import decontaminate, langid, licenses, quality, tokencount
from helixframe.llm.common import Words, text_bytes

SIZE = 5_000_000


def raw(text):
    return text_bytes(pa.array([text], pa.large_string()))


@contextmanager
def bounded(seconds=60, mb=1000):
    start, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    yield
    assert time.time() - start < seconds
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - before < mb


def test_windows_that_repeat_in_items_and_texts():
    block = decontaminate.block_of(["1", "2", None], ["word " * 1000, "word " * 11, "word " * 12], 10)
    data, at = raw("word " * (SIZE // 5))
    with bounded():
        words = Words(data, at)
        marks, row, item = decontaminate.search_block(words, block)
        assert (row.tolist(), [block.names[i] for i in item.tolist()]) == ([0, 0], ["1", "2"])
        assert decontaminate.spans_of(marks, words, at)[0].tolist() == [SIZE // 5]


def test_windows_of_two_words(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choices("ab", k=3000)) + " "
    block = decontaminate.block_of([str(k) for k in range(30)], [text[k * 50 : k * 50 + 4000] for k in range(30)], 10)
    for size in (1 << 20, 1000):
        monkeypatch.setattr(decontaminate, "AT_ONCE", size)
        data, at = raw(text * (40 if size > 1000 else 3))
        words = Words(data, at)
        marks, row, item = decontaminate.search_block(words, block)
        windows = {text[k : k + 19] for x in range(30) for k in range(x * 50, x * 50 + 3981, 2)}
        whole = text * 2
        hit = np.zeros(len(text) // 2, bool)
        for k in range(0, len(text), 2):
            if whole[k : k + 19] in windows:
                hit[(np.arange(k // 2, k // 2 + 10)) % len(hit)] = True
        n = decontaminate.spans_of(marks, words, at)[0][0]
        assert len(item) == 30 and n == hit.sum() * len(data) // len(text)


def test_licenses_one_after_the_other():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    notice = "Released under the MIT License. "
    data, at = raw(notice * (SIZE // len(notice)))
    with bounded():
        known = scanner.vocabulary.find(Words(data, at))
        assert (known >= 0).all()
        places, matches = [], []
        scanner.scan(known.tolist(), 0, places, matches)
        chains = scanner.chained(matches)
    assert len(chains) == SIZE // len(notice) and all(a[1] <= b[0] for a, b in zip(chains, chains[1:]))


def test_tokens_of_texts_without_spaces():
    automaton = tokencount.Automaton(tokencount.load())
    rng = random.Random(1)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(SIZE // 3)), "".join(rng.choices("ABCDEFabcdef0123456789+/", k=SIZE)), "word " * (SIZE // 5)):
        data, at = raw(text)
        with bounded():
            starts, ends = tokencount.units(data, at)
            assert automaton.counts(data, starts, ends).sum() > SIZE // 6
    # The same pieces whether units are stepped together or alone.
    texts = ["".join(rng.choices("abcé文 ", k=rng.randint(0, 40))) for _ in range(300)]
    data, at = text_bytes(pa.array(texts, pa.large_string()))
    starts, ends = tokencount.units(data, at)
    assert automaton.counts(data, starts, ends).tolist() == [int(automaton.counts(data, starts[k : k + 1], ends[k : k + 1])[0]) for k in range(len(starts))]


def test_a_long_text_through_the_network(monkeypatch):
    net = quality.train(["good text here"] * 4 + ["bad words there"] * 4, [1] * 4 + [0] * 4, 2)
    data, at = raw("The quick brown fox. " * (4 * SIZE // 21))
    with bounded(mb=400):
        quality.pooled_long(net, data)
    for blocks in (1, 2, 5):
        monkeypatch.setattr(quality, "LONG_BLOCKS", blocks)
        for n in (0, 1, 7, 8, 9, 15, 16, 17, 40, 100):
            own = data[:n]
            assert quality.pooled_long(net, own) == pytest.approx(quality.pooled(net, *quality.chunks(own, np.array([0, n]))), abs=1e-5)


def test_a_long_text_in_many_languages(monkeypatch):
    rng = random.Random(3)
    models = langid.train_all({f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop ", k=2000))] for k in range(64)})
    scorer = langid.Scorer(models)
    data, at = raw("".join(rng.choices("abcdefghijklmnopqr ", k=SIZE)))
    with bounded():
        whole = scorer.costs(data, at)
    assert whole.shape == (1, 64)
    # Slices of any size, rows of any length.
    texts = ["".join(rng.choices("abcé z", k=rng.randint(0, 30))) for _ in range(40)] + [""]
    data, at = text_bytes(pa.array(texts, pa.large_string()))
    want = np.array([scorer.costs(*raw(x))[0] for x in texts])
    for size in (8, 24, 80, 1 << 22):
        monkeypatch.setattr(langid, "COSTS", size)
        assert scorer.costs(data, at) == pytest.approx(want, rel=1e-5)


def test_three_hundred_languages(spark):
    rng = random.Random(2)
    syllables = [[rng.choice("bdfgklmnprstvz") + rng.choice("aeiouäöü") + rng.choice("nrslk") for _ in range(4)] for _ in range(300)]
    make = lambda k: " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(30))
    rows = [(300 * j + k, make(k), f"l{k:03d}") for j in range(3) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for chars in (24_000_000, 300 * 100):
        models = langid.fit(docs, all_chars=chars)
        assert [x for m in models for x in m.languages] == [f"l{k:03d}" for k in range(300)]
        got = langid.predict(docs, models).select("lang", "lang_pred").collect()
        assert sum(a == b for a, b in got) > 0.95 * len(got)


def test_twenty_blocks_write_hits_only(spark, tmp_path, monkeypatch):
    """A benchmark of twenty blocks: the same rows as by one, and the texts are written once, whatever the number of blocks."""
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(pool, k=14))) for k in range(60)] + [(k, "same words in many items over and over again here now") for k in range(60, 90)]
    texts = [" ".join(rng.choices(pool, k=80)) for _ in range(60)]
    texts = [x + " " + items[k][1] + " " + x[:50] if k % 3 == 0 else x for k, x in enumerate(texts)] + [None, "", items[70][1], f"{items[3][1][:40]} {items[61][1]} {items[3][1][40:]}"]
    docs = spark.createDataFrame([(k, x, len(x or ""), "a", 1) for k, x in enumerate(texts)], "doc_id long, text string, n_chars long, `a.b` string, pairs int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    written = []
    plain = decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", lambda df: written.append(df.columns) or plain(df))
    few, many = (decontaminate.find(docs, bench, block_bytes=n) for n in (16 << 20, 300))
    assert decontaminate.blocks_of(bench, 10, 300).count() >= 15 and few.columns == many.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert sum("text" in c for c in written) == 1
    one, two = (decontaminate.find(docs, bench, block_bytes=n, clean=True) for n in (16 << 20, 300))
    assert decontaminate.find(two, bench).where("n_hit > 0").count() == 0 and two.columns == docs.columns
    cut_ = {r["doc_id"]: r for r in two.collect()}
    assert all((r["text"] == cut_[r["doc_id"]]["text"]) == (few_hit == 0) or few_hit for r, few_hit in ((r, r["n_hit"]) for r in few.collect()))
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut_.values()) and cut_[60]["text"] is None
    same = {r["doc_id"]: r["text"] for r in one.collect()}
    assert sum(same[k] == r["text"] for k, r in cut_.items()) > 60
