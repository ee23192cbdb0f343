"""The registered queries themselves, on small tables with awkward rows and on empty ones."""

import hashlib
import random
import re
import zlib

import pytest

from helixframe.llm import queries, quality, tokencount
from tests.llm.test_operators import brute_fingerprint, brute_groups, brute_hits, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    good, bad = ["ka", "ro", "mi", "lo"], ["sch", "üb", "en", "cht"]
    make = lambda s: " ".join("".join(rng.choices(s, k=3)) for _ in range(rng.randint(5, 60)))
    texts = [make(good if k % 2 else bad) for k in range(70)]
    texts[7] = texts[8] = "Released under the MIT License. CC BY 4.0, all rights\nreserved! cc by GNU General Public License cc-by"
    texts[9] += " " + texts[10][:60]
    texts += [None, "", "   ", "12 !!", "x" * 5000, "日本語 テキスト " * 50, "word " * 3000]
    rows = [(k if k != 5 else 4, x, None if k > 66 else ("xx", "yy")[k % 2], None if k % 13 == 0 else "s", None if x is None else len(x)) for k, x in enumerate(texts)]
    rows += [rows[0], (None, "nobody's text cc by", "xx", "s", 3)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 70, 2)] + [(k, k % 2, 0) for k in range(1, 70, 2)] + [(3, None, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, texts[10]), (2, "all rights reserved"), (None, "cc by"), (3, None), (4, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    kinds = {"documents": DOCUMENTS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def remainder(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def rows_of(spark, tables, name):
    return queries.queries()[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    found = rows_of(spark, tables, "op1_quality")
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in tables[1])
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= quality.THRESHOLD) and 0 <= r["score"] <= 1 for r in found)


def test_op3(spark, tables):
    want = sorted((str(i), *(h := brute_hits(x, tables[2]))[:2], len(h[2]), hashlib.sha256(",".join(h[2]).encode()).hexdigest(), h[1] > 0) for i, x, *_ in tables[1])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows_of(spark, tables, "op3_decontaminate")) == want


def test_op4(spark, tables):
    """Greedy longest match over units, one piece after the other, with the file that the query takes."""
    pieces = set(tokencount.load()) | {bytes([b]) for b in range(256)}
    longest = max(map(len, pieces))

    def count(text):
        n = units = 0
        for unit in re.findall(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?= [^\x20\x09-\x0D])|[\x20\x09-\x0D]+", text.encode()):
            units, at = units + 1, 0
            while at < len(unit):
                at += next(k for k in range(min(longest, len(unit) - at), 0, -1) if unit[at : at + k] in pieces)
                n += 1
        return units, n, len(text.encode())

    got = sorted((str(r["doc_id"]), r["n_units"], r["n_tokens"], r["n_bytes"]) for r in rows_of(spark, tables, "op4_tokencount"))
    assert got == sorted((str(i), *count(x or "")) for i, x, *_ in tables[1])


def test_op5(spark, tables):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    found = {}
    for r in rows_of(spark, tables, "op5_licenses"):
        found.setdefault(str(r["doc_id"]), []).append(r)
    for i, x, *_ in tables[1]:
        w = words(x)
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
        base = sorted({label for _, label in places})
        own = [r for r in found[str(i)] if (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)]
        assert own and all(r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) | {""} and r["labels"].split(",") == sorted(set(r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in own)
        assert not places or own[0]["score"] == 1
    assert "mit" in found["7"][0]["labels"].lower()


def test_op6(spark, tables):
    found = rows_of(spark, tables, "op6_langid")
    assert len(found) == len(tables[1])
    texts = {(str(i), x): (i, lang) for i, x, lang, *_ in tables[1]}
    by_id = {str(i): (x, lang) for (i, x), (_, lang) in texts.items()}
    for r in found:
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1) and r["lang_pred"] in ("xx", "yy", "und") and 0 <= r["score"] <= 1
        text, lang = by_id[str(r["doc_id"])]
        if text is None or not re.search(r"[^\W\d_]", text):
            assert r["lang_pred"] == "und" and r["score"] == 0
    sure = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 66 and r["doc_id"] not in (4, 7, 8, 9)]
    assert sum(r["lang_pred"] == by_id[str(r["doc_id"])][1] for r in sure) == len(sure)


def test_op9(spark, tables):
    prints = [brute_fingerprint(x) for _, x, *_ in tables[1]]
    group = brute_groups(prints)
    least = {g: min((r[0] for r, h in zip(tables[1], group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f"{f:016x}", str(least[g])) for r, f, g in zip(tables[1], prints, group, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows_of(spark, tables, "op9_simhash")) == want
