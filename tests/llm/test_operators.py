"""Each operator against a brute-force version, on small tables with every awkward case."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import common, decontaminate, langid, licenses, linedup, mixing, quality, secrets, simhash, tokencount, topk
from helixframe.llm.fmindex import FMIndex

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, _gone string, key int"


def words(text):
    return re.findall(WORD, (text or "").translate(FOLD))


def table(spark, texts, ids=None, langs=None, sources=None):
    rows = [(k if ids is None else ids[k], x, None if langs is None else langs[k], None if sources is None else sources[k], None if x is None else len(x), 1, "z", 2) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    names = ["alpha", "beta", "Γάμμα", "delta", "épsilon", "zeta", "x9", "CC", "by"]
    line = lambda: " ".join(rng.choices(names, k=rng.randint(0, 12)))
    out = ["\n".join(line() for _ in range(rng.randint(1, 9))) for _ in range(40)]
    return [*out, out[0], out[0], out[1] + " tail", None, "", " ", "\n\n", "." * 50, "word " * 30_000, "a" * 70_000, "𝄞 é ß"]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = np.concatenate(([0], rng.integers(0, 4, 3000), [0])).astype(np.int64)
    text[500:900] = text[1500:1900]
    fm = FMIndex(text, 3)
    patterns = rng.integers(1, 4, (60, 6))
    lengths = rng.integers(1, 7, 60)
    patterns[np.arange(6) >= lengths[:, None]] = 0
    low, high = fm.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_fm_index_of_a_short_text():
    for text in ([0, 0], [0, 1, 0], [0, 1, 1, 0], [0, 1, 0, 2, 0]):
        fm = FMIndex(np.array(text, np.int64), 2)
        low, high = fm.search(np.array([[1], [2]]), np.array([1, 1]))
        assert (high - low).tolist() == [text.count(1), text.count(2)]


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for i, x in items:
        v = words(x)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit.update(range(j, j + n))
                    found |= set() if i is None else {str(i)}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_decontamination(spark, texts, block):
    items = [(10, texts[2]), (9, "Beta ALPHA"), (9, texts[3]), (7, None), (None, "zeta zeta"), (8, "...")]
    docs = [x for x in texts if x is None or len(x) < 5000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(table(spark, docs), bench, block_bytes=block).collect()}
    assert got == {k: brute_hits(x, items) for k, x in enumerate(docs)}
    clean = decontaminate.find(table(spark, docs), bench, clean=True)
    assert clean.columns == table(spark, docs).columns
    for r in clean.collect():
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        if got[r["doc_id"]][1] == 0:
            assert r["text"] == docs[r["doc_id"]]
    none = decontaminate.find(table(spark, docs), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and decontaminate.find(table(spark, []), bench).count() == 0


@pytest.mark.parametrize("block", [16 << 20, 20])
def test_no_window_is_left_across_cuts(spark, block):
    item = " ".join(f"w{k}" for k in range(10))
    texts = [f"a w0 w1 w2 w3 w4 {item} w5 w6 w7 w8 w9 b", f"w0 w1 {item} w2 w3 {item}, w4 w5 w6 w7 w8 w9", "w0 w1 clean", f"é{item}é", ""]
    bench = spark.createDataFrame([(1, item), (2, "b c")], "item_id long, text string")
    clean = decontaminate.find(table(spark, [*texts, "a b b c c d", None]), bench, block_bytes=block, clean=True)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert decontaminate.find(clean, bench).where("n_hit > 0").count() == 0
    assert [words(got[k][0]) for k in range(7)] == [["a", "b"], [], ["w0", "w1", "clean"], words(texts[3]), [], ["a", "d"], []]
    assert got[2][0] == texts[2] and got[6][0] is None and all(x is None or n == len(x) for x, n in got.values())


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fp):
    group = list(range(len(fp)))
    for a in range(len(fp)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                group = [group[b] if g == group[a] else g for g in group]
    return group


def test_simhash_components(spark, texts, monkeypatch):
    ids = [k if k % 7 else None if k == 14 else k for k in range(len(texts))]
    ids[3] = ids[2]

    fp = [brute_fingerprint(x) for x in texts]
    group = brute_groups(fp)
    least = {g: min((i for i, h in zip(ids, group, strict=True) if h == g and i is not None), default=None) for g in group}
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(table(spark, texts, ids)).collect())
    assert got == sorted((str(i), f, str(least[g])) for i, f, g in zip(ids, fp, group, strict=True))
    order = lambda k: (ids[k] is None, ids[k] or 0)
    for limit in (common.BROADCAST_ROWS, 1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        kept = simhash.keep_first(table(spark, texts, ids).union(table(spark, texts[:3], ids[:3])))
        assert kept.columns == SCHEMA.replace(",", "").split()[::2]
        rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
        places = [min(k for k in range(len(texts)) if (ids[k], texts[k]) == r) for r in rows]
        assert sorted(group[k] for k in places) == sorted(set(group))
        assert all(order(k)[0] == min(map(order, same := [j for j in range(len(texts)) if group[j] == group[k]]))[0] and (ids[k] is None or ids[k] == min(ids[j] for j in same if ids[j] is not None)) for k in places)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_links_are_all_pairs_within_four_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_fp = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for x in base for _ in range(8)} | {0, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in all_fp]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    for blocks in (None, 7, 8, 10):
        found = [tuple(r) for r in simhash.links(frame, blocks=blocks).collect()]
        assert set(found) == want and len(found) == len(want)
    assert [simhash.blocks_for(n) for n in (10**3, 10**7, 10**8, 10**10)] == [6, 6, 7, 8]
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(1, 61)} | {(101, 100)}


def brute_runs(rows, min_chars=30):
    """(texts, runs): texts without the longest run at each line that has an earlier copy, and those runs that no other
    one of their text covers. rows: (order key, text) of distinct documents."""
    places, out = [(key, i, text.split("\n")) for key, text in sorted(rows) for i in range(text.count("\n") + 1)], {}
    gone, runs, done = set(), set(), {}
    for at, (key, i, own) in enumerate(places):
        longest = 0
        for _, j, other in places[:at]:
            n = 0
            while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                n += 1
            longest = max(longest, n)
        if longest and len(run := "\n".join(own[i : i + longest])) >= min_chars:
            gone |= {(key, k) for k in range(i, i + longest)}
            if i + longest > done.get(key, 0):
                done[key] = i + longest
                runs.add((key, i, longest, len(run)))
    for key, text in rows:
        out[key] = "\n".join(x for i, x in enumerate(text.split("\n")) if (key, i) not in gone)
    return out, runs


def test_line_dedup_of_maximal_runs(spark, texts):
    two = "\n".join("p" * 29 + str(k) for k in range(2)) + "\nshort"
    three = "\n".join(f"{k}" + "q" * 28 for k in range(3))
    words_ = "\n".join(f"w{k:02}" for k in range(60))
    rows = ["\n".join([f"head {k}", x, f"tail {k}"]) for x in (two, three, words_) for k in range(2)]
    got = {r["doc_id"]: r["text"] for r in linedup.dedup(table(spark, rows), report=True).collect()}
    assert [got[k] for k in range(6)] == [rows[0], "head 1\ntail 1", rows[2], "head 1\ntail 1", rows[4], "head 1\ntail 1"]
    rng = random.Random(8)
    pool = [f"{k}" + "x" * rng.choice([0, 3, 8, 17, 40]) for k in range(7)] + ["", "", "a"]
    docs = ["\n".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(60)]
    docs += ["\n" * k for k in (3, 29, 30, 31, 70)] + ["\n".join(rng.choices(["", "a"], k=60)) for _ in range(6)]
    docs += ["\n".join(["z", docs[-1], "y"]), "\n".join(["y", *docs[-2].split("\n")[20:], "v"]), *texts]
    frame = table(spark, docs)
    done = linedup.dedup(frame, report=True).collect()
    got = {r["doc_id"]: r["text"] for r in done}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in done)
    want, runs = brute_runs([(k, x) for k, x in enumerate(docs) if x is not None])
    assert got == {k: want.get(k) for k in range(len(docs))}
    assert {(r["doc"], r["i"], r["n"], r["chars"]) for r in linedup.maximal_runs(frame).collect()} == runs
    assert sum(r["n_maximal"] for r in done) == len(runs)
    # Rows that repeat are one document; of two texts of one id, and of null ids, each is its own.
    again = linedup.dedup(table(spark, ["m" * 40, "m" * 40, "m" * 40 + "\nq"], [1, 1, None])).collect()
    assert sorted(r["text"] for r in again) == ["m" * 40, "m" * 40, "q"]
    assert linedup.dedup(table(spark, [])).count() == 0


def test_suffix_ranks_to_full_depth(spark):
    docs = ["a\nb\nc\nd\ne\na\nb\nc\nd\nz", "q\nb\nc\nd\ne\na", *["\n".join(f"{k % 5}" for k in range(23))] * 2]
    suffixes, deepest = [(k, i) for k, x in enumerate(docs) for i in range(len(x.split("\n")))], 0
    for h, level in linedup.levels(table(spark, docs)):
        got = {(r["doc"], r["i"]): r["rank"] for r in level.collect()}
        run = {(k, i): tuple(docs[k].split("\n")[i : i + h]) for k, i in suffixes}
        full = {s: r for s, r in run.items() if len(r) == h}
        repeated = {s: r for s, r in full.items() if list(full.values()).count(r) > 1}
        assert set(got) == set(repeated)
        assert all((got[a] == got[b]) == (repeated[a] == repeated[b]) for a in got for b in got)
        deepest = h
    assert deepest == 16


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    docs = table(spark, ["a" * 40 + "\n" + "b" * 40, "c" * 40, "a" * 40])
    monkeypatch.setattr(linedup, "hashes", lambda c: (F.lit(7).cast("long"), F.xxhash64(F.lit(1), c)))
    assert [r["text"] for r in linedup.dedup(docs).orderBy("doc_id").collect()] == ["a" * 40 + "\n" + "b" * 40, "c" * 40, ""]


def test_mixing(spark):
    docs = table(spark, [f"t{k}" for k in range(400)] + [None, ""], sources=["a"] * 300 + ["b"] * 90 + [None] * 12)
    out = mixing.mix(docs, {"a": 1.0, "b": 3.0, None: 1.0}, total=3000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 600) < 120 and abs(n["b"] - 1800) < 200 and abs(n[None] - 600) < 120
    assert out.where("mix_copy < 1").count() == 0 and out.select("doc_id", "mix_copy").distinct().count() == out.count()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), {"a": 1.0, "b": 3.0, None: 1.0}, total=3000).collect()), key=str)
    assert mixing.mix(docs, {"zzz": 1.0}).count() == 0 and mixing.mix(table(spark, [])).count() == 0


@pytest.mark.parametrize("rate", [0.001, 0.7, 3.0, 150.0, 250.0, 1500.0, 1e5])
def test_poisson_counts(spark, rate):
    us = [0.0, 1e-9, *np.linspace(0.001, 0.999, 23).tolist(), 1 - 1e-9, 1 - 2**-52]
    frame = spark.createDataFrame([(u, rate) for u in us], "u double, rate double").withColumn("start", mixing.start(F.col("rate")))
    got = {r["u"]: r["n"] for r in frame.select("u", mixing.inverse(F.col("u"), F.col("rate"), F.col("start")).alias("n")).collect()}
    logs, total, k, want = math.lgamma, 0.0, 0, {}
    left = sorted(us)
    while left and k < rate + 12 * math.sqrt(rate) + 31:
        total += math.exp(-rate + k * math.log(rate) - logs(k + 1))
        while left and total > left[0]:
            want[left.pop(0)] = k
        k += 1
    assert all(got[u] == n for u, n in want.items() if rate < 200 or 1e-12 < u < 1 - 1e-6)  # further out sums round
    assert all(got[u] >= rate for u in left)


def test_mixing_draws_for_each_text_without_an_id(spark):
    docs = table(spark, [f"t{k}" for k in range(400)], [None] * 400, sources=["a"] * 300 + ["b"] * 100)
    rows = mixing.mix(docs, {"a": 1.0, "b": 1.0}).collect()
    n = {s: sum(r["source"] == s for r in rows) for s in "ab"}
    assert abs(n["a"] - 200) < 60 and abs(n["b"] - 200) < 60  # rates 2/3 and 2
    assert len({r["mix_key"] for r in rows}) == len(rows)


def test_token_counts(spark, texts):
    vocabulary = [x.encode() for x in ("al", "alp", "alpha", " alpha", " b", "beta", "ta", "et", "pha b", "zz", "lta d", "aaaa", "aaa")]
    held, longest = {*vocabulary, *(bytes([b]) for b in range(256))}, max(map(len, vocabulary))
    got = {r["doc_id"]: (r["n_units"], r["n_tokens"]) for r in tokencount.count(table(spark, texts), vocabulary).collect()}
    for k, x in enumerate(texts):
        found = re.findall(rb" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+?(?= [^\x20\x09-\x0d])|[\x20\x09-\x0d]+", (x or "").encode())
        n = 0
        for u in found:
            i = 0
            while i < len(u):
                i += next(m for m in range(longest, 0, -1) if u[i : i + m] in held and i + m <= len(u))
                n += 1
        assert got[k] == (len(found), n)


def test_licenses(spark, texts):
    docs = [x for x in texts if x is None or len(x) < 5000] + ["Released under the MIT License. All Rights\nreserved, cc by cc BY", "GNU Lesser General Public License", "This work is licensed, then, under the GNU General Public License version 3"]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, docs)).collect()}
    for k, x in enumerate(docs):
        w = words(x)
        want = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (got[k]["n_words"], sorted(tuple(p) for p in got[k]["places"])) == (len(w), want)
        assert 0 <= got[k]["score"] <= 1
    assert [s["label"] for s in got[len(docs) - 3]["spans"]] == ["mit"]


def test_automaton_gives_matching_statistics():
    rng = random.Random(8)
    strings = [[rng.randrange(3) for _ in range(rng.randint(2, 9))] for _ in range(6)]
    auto = licenses.Automaton(strings)
    stretches = {tuple(s[a:b]): set() for s in strings for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for k, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                stretches[tuple(s[a:b])].add(k)
    for x, owners in stretches.items():
        state = 0
        for t in x:
            state = auto.next[state][t]
        assert {k for k, _ in auto.places[state]} == owners


def test_language_id(spark):
    rng = random.Random(6)
    make = lambda syllables: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(40))
    texts = [make(["ka", "ro", "mi"]) for _ in range(40)] + [make(["sch", "üb", "en"]) for _ in range(40)]
    langs = ["xx"] * 40 + ["yy"] * 40
    docs = table(spark, texts + [None, "", "12 !!", "karomi"], langs=langs + [None] * 4)
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert [got[k][0] for k in range(80)] == langs and [got[k] for k in (80, 81, 82)] == [("und", 0.0)] * 3 and got[83][0] == "xx"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.predict(docs, langid.fit(docs.where("lang = 'none'")))
    assert nothing.where("lang_pred <> 'und'").count() == 0
    assert langid.keep_known(docs).columns == docs.columns and langid.keep_known(table(spark, [])).count() == 0


def test_languages_of_long_texts_alone_are_learned(spark):
    texts = ["ka ro mi " * 30] * 3 + ["sch üb en " * 40 + "x" * k for k in range(5)]
    docs = table(spark, texts, langs=["xx"] * 3 + ["yy"] * 5)
    (model,) = langid.fit(docs, chars=300)
    assert model.languages == ["xx", "yy"]
    once = langid.train({"xx": texts[:1], "yy": texts[3:4]})
    assert all((k == k1).all() and c == pytest.approx(c1) for (k, c), (k1, c1) in zip(model.strings, once.strings, strict=True))


def test_copies_do_not_grow_what_training_reads(spark):
    texts = ["ka ro mi"] * 400 + [f"sch üb {k}" for k in range(30)]
    docs = table(spark, texts, ids=[1] * 400 + list(range(2, 32)), langs=["xx"] * 400 + ["yy"] * 30)
    once = langid.train({"xx": texts[:1], "yy": sorted(texts[400:])})
    (model,) = langid.fit(docs)
    for (k, c), (k1, c1) in zip(model.strings, once.strings, strict=True):
        assert (k == k1).all() and c == pytest.approx(c1)
    labels = spark.createDataFrame([(k, k % 2) for k in range(32)], "doc_id long, quality int")
    own = quality.train(["ka ro mi", *texts[400:]], [k % 2 for k in range(1, 32)])
    assert all((a == b).all() for a, b in zip(quality.fit(docs, labels).parts(), own.parts(), strict=True))


def test_code_lengths_follow_the_tree():
    model = langid.train({"a": ["abab abac"], "b": ["zz"]}, order=2)

    def bits(text, corpus):
        """The definition, one byte at a time."""
        corpus, text, total = "  " + corpus, "  " + text, 0.0
        for i in range(2, len(text)):
            for k in (2, 1, 0):
                context = text[i - k : i]
                seen = [corpus[j] for j in range(2, len(corpus)) if corpus[j - k : j] == context]
                if text[i] in seen:
                    total -= np.log2(seen.count(text[i]) / (len(seen) + len(set(seen))))
                    break
                total -= np.log2(len(set(seen)) / (len(seen) + len(set(seen)))) if seen else 0
            else:
                total += 8
        return total

    for text in ("abac", "zebra", "a", "bab zz"):
        got = langid.Scorer([model]).costs(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        assert got == pytest.approx([bits(text, "abab abac"), bits(text, "zz")], rel=1e-5)


def test_secrets(spark, texts):
    rng = random.Random(9)
    odd = ["password = 'hunter2hunter2'", "secret=token=abcdefgh", "ſecret=abcdefghij TOKEN:\"abc\"", "api_key:x AKIA" + "A1" * 7 + " AKIAshort", "é" * 9 + "f" * 40 + "G" + "0" * 31, "ghp_" + "a" * 40, "https://me:pw@host"]
    docs = odd + ["".join(rng.choices("abcdef0123456789=: \"AKIpswordtken_", k=300)) for _ in range(30)] + texts
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find(table(spark, docs)).collect()}
    for k, x in enumerate(docs):
        want = []
        for j, rule in enumerate(secrets.RULES):
            want += [(m.start(), j, rule.kind, m.end()) for m in re.compile(rule.pattern, re.ASCII).finditer(x or "") if len(m.group(rule.group)) >= rule.least]
        assert got[k] == [(kind, a, b) for a, _, kind, b in sorted(want)]


def test_trigram_queries():
    assert secrets.literals("abc|xyzw") == [["abc", "xyzw"]] and secrets.literals("[0-9]+") == [] and secrets.literals("ab.cde") == [["cde"]]
    assert secrets.literals("(?i:KEY)x?y") in ([["key"]], [["keyxy", "keyy"]])


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 1, 8).round(1).tolist(), 0, "x") for k in range(500)]
    rows += [(500, None, 0, "x"), (510, [1.0, None] + [0.0] * 6, 0, "x"), (520, [float("nan")] * 8, 0, "x"), (530, [float("inf")] + [0.0] * 7, 0, "x"), (540, rows[3][1], 0, "x"), (20, rows[7][1], 0, "x")]
    rows += [(550, [], 0, "x"), (560, [], 0, "x"), (570, [2.0, 3.0], 0, "x"), (571, [1.0, 0.5], 0, "x"), (580, [1.0], 0, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(3)
    for k, shard, block in ((5, 2048, 1 << 20), (3, 60, 1500)):
        assert {(r["query_id"], r["rank"]): (r["score"], r["vec_id"]) for r in topk.top_k(frame, 10, k, shard, block).collect()} == brute_top(rows, 10, k)
    assert topk.top_k(frame.limit(0), 10).count() == 0


def brute_top(rows, every, k):
    """{(query, rank): (score, id)} in Python's own numbers."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in good if i % every == 0}:
        own = min(v for i, v in good if i == q)
        best = sorted(((sum(a * b for a, b in zip(own, x)), -i) for i, x in good if i != q and len(x) == len(own)), reverse=True)[:k]
        out |= {(q, n + 1): (s, -i) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("size", [2.0**12, 2.0**17, 2.0**20])
def test_top_k_of_large_components(spark, size):
    """Scores that doubles can't tell apart."""
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(0, 1, 64) * size).tolist(), 0, "x") for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(2)
    got = {(r["query_id"], r["rank"]): (r["score"], r["vec_id"]) for r in topk.top_k(frame, 20, 4, 100).collect()}
    assert got == brute_top(rows, 20, 4)
    huge = spark.createDataFrame([(k, [1e200 * (k + 1), 1.0], 0, "x") for k in range(5)], "vec_id long, embedding array<double>, label int, score string")
    assert {r["score"] for r in topk.top_k(huge, 2, 2).collect()} == {topk.LONG}


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choices(["river", "stone", "cloud", "walks"], k=60))
    texts = [good() if k % 2 else good().replace(" ", " | ") for k in range(200)]
    docs = table(spark, [*texts, None, "", "z" * 50_000])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, None), (None, 1)], "doc_id long, quality int")
    net = quality.fit(docs, labels.where("doc_id < 120 or doc_id is null"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, net).collect()}
    assert np.mean([(got[k] > 0.5) == (k % 2 == 1) for k in range(120, 200)]) > 0.95
    assert got[200] == pytest.approx(got[201], abs=1e-5) and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_labels_of_other_documents_take_no_place(spark):
    texts = ["good river stone", "bad | river"] * 20
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)], "doc_id long, quality int")
    docs = table(spark, texts, ids=list(range(2000, 2040)))
    own = quality.train(texts[:1] * 20 + texts[1:2] * 20, [0] * 20 + [1] * 20)
    assert len(own.parts()) == len(quality.fit(docs, labels, rows=40).parts())
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels, rows=40)).collect()}
    assert all((got[k] > 0.5) == (k % 2 == 1) for k in got)


def test_scores_by_definition(spark, texts):
    net = quality.train([x for x in texts if x and len(x) < 2000], [k % 2 for k in range(sum(bool(x) and len(x) < 2000 for x in texts))], epochs=2)

    def score(text):
        raw = list((text or "").encode())
        raw += [256] * ((-len(raw)) % 8 + (8 if raw else 16))
        filters = np.concatenate((net.near, net.far)).astype(np.float64)
        rows = [net.embed[raw[i : i + 16]].reshape(-1) @ filters for i in range(0, len(raw) - 15, 8)]
        hidden = [max(0.0, max(r[f] for r in rows) + float(net.bias[f])) for f in range(len(net.bias))]
        return 1 / (1 + math.exp(-(sum(h * float(w) for h, w in zip(hidden, net.out)) + float(net.base[0]))))

    for r in quality.score(table(spark, texts), net).collect():
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), abs=3e-5)


def test_gradients_follow_the_loss():
    """One step of training goes down the loss's slope, as small changes of each weight show."""
    texts, labels = ["abcdefgh ijkl", "zzzz yyyy xxxx wwww"], [1, 0]
    before, after = quality.train(texts, labels, epochs=0), quality.train(texts, labels, epochs=1)

    def loss(net):
        data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, 13, 32])
        p = quality.probability(net, quality.pooled(net, *quality.chunks(data, at)))
        return -np.log(p[0]) - np.log(1 - p[1])

    assert loss(after) < loss(before)
    for k, part in enumerate(before.parts()):
        moved = (after.parts()[k] - part).ravel()
        for i in np.argsort(-np.abs(moved))[:5].tolist():
            base = part.ravel()[i]
            part.ravel()[i] = base + 1e-3
            up = loss(before)
            part.ravel()[i] = base - 1e-3
            down = loss(before)
            part.ravel()[i] = base
            assert abs(up - down) < 1e-6 or (up - down) * moved[i] < 0


def test_every_chunk_counts():
    net = quality.Network(*[np.random.default_rng(1).normal(0, 1, s).astype(np.float32) for s in ((257, 8), (64, 24), (64, 24), (24,), (24,), (1,))])
    rows = [b"", b"a", b"12345678", b"x" * 37, bytes(range(200))]
    data, at = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    got = quality.pooled(net, *quality.chunks(data, at))
    for k, x in enumerate(rows):
        padded = list(x) + [256] * ((-len(x)) % 8 + 8 + (8 if not x else 0))
        filters = np.concatenate((net.near, net.far))
        best = np.max([net.embed[padded[i : i + 16]].reshape(-1) @ filters for i in range(0, len(padded) - 15, 8)], axis=0) + net.bias
        assert got[k] == pytest.approx(best, rel=1e-4, abs=1e-4)


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    langs = ["xx" if k % 2 else "yy" for k in range(len(texts))]
    ids = [k if k != 5 else None for k in range(len(texts))]
    docs = table(spark, texts, ids, langs, [f"s{k % 3}" if k % 5 else None for k in range(len(texts))])
    spark.createDataFrame([(1, texts[2]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
        assert docs.columns[: len(columns)] == columns
        empty = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
        assert empty.count() == 0
    assert docs.count() >= 0


def test_pipeline_drops_runs_of_any_length(spark):
    import corpus_pipeline

    three, list_ = "\n".join(f"{k}" + "q" * 28 for k in range(3)), "\n".join(f"w{k:02}" for k in range(60))
    docs = table(spark, [f"one\n{three}\n{list_}\nend 1", f"two\n{list_}\n-\n{three}\nend 2"])
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "").collect()}
    assert got == {0: f"one\n{three}\n{list_}\nend 1", 1: "two\n-\nend 2"}


def brute_language(texts, langs, ids, order=4):
    """(language, score) of each text by context trees walked one byte at a time."""

    def folded(text):
        return [32] * order + [b if b > 127 else b | 32 if chr(b).isalpha() else 32 for b in text.encode()]

    trees = {}
    for x, lang, i in zip(texts, langs, ids, strict=True):
        if lang is not None and x and zlib.crc32(str(i).encode()) % 3 != 1:
            raw, tree = folded(x), trees.setdefault(lang, {})
            for at in range(order, len(raw)):
                for k in range(order + 1):
                    seen = tree.setdefault(tuple(raw[at - k : at]), {})
                    seen[raw[at]] = seen.get(raw[at], 0) + 1
    out = []
    for x in texts:
        if not re.search(r"[^\W\d_]", x or ""):
            out.append(("und", 0.0))
            continue
        raw, bits = folded(x), {}
        for lang, tree in trees.items():
            total = 0.0
            for at in range(order, len(raw)):
                for k in range(order, -1, -1):
                    seen = tree.get(tuple(raw[at - k : at]), {})
                    if raw[at] in seen:
                        total -= math.log2(seen[raw[at]] / (sum(seen.values()) + len(seen)))
                        break
                    total -= math.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0
                else:
                    total += 8
            bits[lang] = total
        best = min(sorted(bits), key=bits.get)
        weight = min(1, langid.EVIDENCE_BYTES / (len(raw) - order))
        out.append((best, 1 / sum(2 ** -((b - bits[best]) * weight) for b in bits.values())))
    return out


def brute_cut(text, items):
    """The text without its words in benchmark windows: each stretch of them leaves a line break."""
    found, w, hit = list(re.finditer(WORD, text.translate(FOLD))), words(text), set()
    for x in items:
        v = words(x)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit.update(range(j, j + n))
    out, done = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[done : found[k].start()])
        done = found[k].end()
    return "\n".join([*out, text[done:]])


def brute_mix(rows):
    """(row, copy) of rows (doc_id, source, ...): each source's share is the square root of its size."""
    n = {s: sum(r[1] == s for r in rows) for s in {r[1] for r in rows}}
    share = {s: math.sqrt(k) / sum(map(math.sqrt, n.values())) for s, k in n.items()}
    out = []
    for r in rows:
        rate, k = share[r[1]] * len(rows) / n[r[1]], 0
        u = int(hashlib.md5(f"mix-1|{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        term = total = math.exp(-rate)
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        out += [(r, c + 1) for c in range(k)]
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    make = lambda syllables, n=40: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    one, two = ["ka", "ro", "mi", "to"], ["sch", "üb", "en", "ß"]
    lines = [make(one, 9) for _ in range(6)]
    texts = [make(one if k % 2 else two) for k in range(24)]
    texts += ["\n".join([make(one, 12), *rng.sample(lines, 3), make(two, 3), "short", make(one, 20)]) for _ in range(10)]
    texts += [texts[3].replace(" ", "  "), texts[5].upper(), texts[7] + "\n", None, "", "4711 !", "Ka"]
    items = [" ".join(texts[2].split()[5:25]), " ".join(texts[9].split()[:12]).upper() + "!", texts[11].split()[4] + " " + texts[11].split()[5], None, ""]
    texts += [make(one, 15) + " -- " + items[0].replace(" ", ", ") + "; " + make(two, 15)]
    ids = [3 * k + 1 for k in range(len(texts))]
    langs = [None if k % 6 == 5 else "xx" if k % 2 else "yy" for k in range(len(texts))]
    sources = [None if k % 9 == 8 else "big" if k % 3 else "small" for k in range(len(texts))]
    docs = [(i, x, g, s, None if x is None else len(x)) for i, x, g, s in zip(ids, texts, langs, sources, strict=True)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    known = [d for d, (lang, score) in zip(docs, brute_language(texts, langs, ids), strict=True) if lang != "und" and score >= 0.5]
    kept, _ = brute_runs([(d[0], d[1]) for d in known])
    less = [(d[0], kept[d[0]]) for d in known]
    group, first = brute_groups([brute_fingerprint(x) for _, x in less]), {}
    for (i, _), g in zip(less, group, strict=True):
        first[g] = min(i, first.get(g, i))
    unique = [(i, x) for i, x in less if i in first.values()]
    clean = {i: brute_cut(x, [y for y in items if y]) for i, x in unique}
    assert len(known) < len(docs) and less != [d[:2] for d in known] and len(unique) < len(less) and clean != dict(unique)
    rest = {d[0]: d for d in docs}
    want = [(i, clean[i], rest[i][2], s, len(clean[i]), copy) for (i, s), copy in brute_mix([(i, rest[i][3]) for i in clean])]
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).drop("mix_key").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_clashing_names_are_replaced(spark):
    rows = [(1, "ka ro mi token=abcdefgh", "xx", 7)]
    names = ["score", "Spans", "n_words", "n_hit", "items", "places", "n_units", "n_tokens", "N_BYTES", "lang_pred", "a.b", "mix_copy", "mix_key", "n_lines", "fp", "component_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int").select("*", F.lit("s").alias("source"), *[F.lit("old").alias(c) for c in names])
    bench = spark.createDataFrame([(1, "ka ro")], "item_id long, text string")
    made = {
        quality.score: (None,), licenses.scan: (), secrets.find: (), tokencount.count: (), decontaminate.find: (bench,), langid.predict: (langid.fit(docs),), langid.keep_known: (),
        linedup.dedup: (), simhash.keep_first: (), mixing.mix: (),
    }
    for operator, arguments in made.items():
        out = operator(docs, *arguments)
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower) and "a.b" in lower and {c.lower() for c in docs.columns} <= set(lower)
        assert len(out.collect()) <= 3
    assert simhash.near_duplicates(docs).count() == 1
    assert secrets.find(docs).first()["spans"][0]["kind"] == "assign" and decontaminate.find(docs, bench).first()["n_hit"] == 2
