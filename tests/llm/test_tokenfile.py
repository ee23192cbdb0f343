"""Token files against the tokenizers library, and the index against a dictionary."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import queries, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n long, at int, copy string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda x: [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "z") for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    signs = ["a", "Bee", "s", "t", "re", "'", "'s", "5", "12", "!", ".", "<", "|", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "é", "é", "İ", "日本", "́", "\xa0", "\x00", "𝄞", "²", "I'M", "don't", "(x)"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(120)] + [None, "", " ", "word " * 40_000, "x" * 60_000, "é" * 3000]
    ids = [3 * k if k % 11 else 33 for k in range(len(texts))]
    ids[5] = ids[6] = None
    return list(zip(ids, texts, strict=True))


def brute(rows, library):
    """(doc_id, n, crc) of each row, and the sum of lengths below each doc_id."""
    made = [(i, library(x)) for i, x in rows]
    key = lambda i: (i is None, i or 0)
    below = {i: sum(len(x) for j, x in made if key(j) < key(i)) for i, _ in made}
    return Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in made), below


def test_parts_are_encoded_as_the_library_does_whole_texts(rows, library, monkeypatch):
    texts = [x for _, x in rows]
    with open(PATH) as f:
        encoder = tokenfile.Encoder(f.read(), 2)
    for limit, held in ((4 << 20, 1 << 19), (50, 20)):
        monkeypatch.setattr(tokenfile, "ENCODED_BYTES", limit)
        monkeypatch.setattr(tokenfile, "REMEMBERED", held)
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(n).tolist()
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [library(x) for x in texts]


@pytest.mark.parametrize("shard", [64 << 20, 3000])
def test_files_and_index(spark, rows, library, tmp_path, shard):
    store = tokenfile.write(frame(spark, rows), str(tmp_path / "ids"), PATH, shard_bytes=shard, bucket_keys=20)
    want, below = brute(rows, library)
    assert store.buckets > 3 and store.about["docs"] == len(rows) and store.about["ids"] == sum(n * k for (_, n, _), k in want.items())
    assert (len(store.base) > 3) == (shard == 3000)
    read = store.read(store.places(tokenfile.keys_of(frame(spark, rows)))).select("doc_id", "copy", "start", "n", F.crc32("ids").alias("crc")).collect()
    assert Counter((r["doc_id"], r["n"], r["crc"]) for r in read) == want
    starts = sorted((r["start"], r["n"]) for r in read)
    assert [a for a, _ in starts] == [0, *np.cumsum([n for _, n in starts]).tolist()[:-1]]
    first: dict = {}
    for r in read:
        first[r["doc_id"]] = min(first.get(r["doc_id"], r["start"]), r["start"])
    assert first == below
    # By key in one process; keys that aren't there; files hold nothing but the header and the ids.
    once = Counter(i for i, _ in rows)
    for i, x in rows[:12]:
        if once[i] == 1:
            assert store.get(i).tolist() == library(x)
    copies = [store.get(33, k).tolist() for k in range(once[33])]
    assert sorted(copies) == sorted(library(x) for i, x in rows if i == 33)
    assert store.get(None, 1) is not None and all(store.get(*k) is None for k in ((1, 0), (33, once[33]), (None, 2), ("null", 0), (-33, 0)))
    size = sum(p.stat().st_size - tokenfile.HEADER for p in (tmp_path / "ids").glob("shard-*.ids"))
    assert size == 2 * store.about["ids"] and not list((tmp_path / "ids").glob(".*"))
    assert store.places(spark.createDataFrame([(1, 0), (33, 99)], "doc_id long, copy long")).count() == 0


def test_the_query_on_a_small_table(spark, rows, library, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.queries()["op12_tokenfile"](spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()) == brute(rows, library)[0]


def test_one_doc_id_in_many_shards(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "COPIES", 7)
    rows = [(5, f"text {k} " * 20) for k in range(90)] + [(4, "a"), (6, "b"), (None, "c"), (None, "d")]
    store = tokenfile.write(frame(spark, rows), str(tmp_path / "ids"), PATH, shard_bytes=1500, bucket_keys=30)
    assert len(store.base) > 5
    read = store.read(store.places(tokenfile.keys_of(frame(spark, rows)))).select("doc_id", "copy", "n", F.crc32("ids").alias("crc")).collect()
    assert Counter((r["doc_id"], r["n"], r["crc"]) for r in read) == brute(rows, library)[0]
    assert sorted(r["copy"] for r in read if r["doc_id"] == 5) == list(range(90))


def test_text_ids_and_empty_tables(spark, library, tmp_path):
    named = spark.createDataFrame([("b", "x y"), ("a", "z"), ("null", None)], "doc_id string, text string")
    store = tokenfile.write(named, str(tmp_path / "a"), PATH)
    assert {r["doc_id"]: r["n"] for r in store.read(store.places(tokenfile.keys_of(named))).collect()} == {"a": 2, "b": 3, "null": 1}
    assert store.get("b").tolist() == library("x y") and store.get(None) is None
    none = tokenfile.write(frame(spark, []), str(tmp_path / "b"), PATH)
    assert none.get(1) is None and none.read(none.places(tokenfile.keys_of(frame(spark, [])))).count() == 0


def test_minimal_hash_numbers_each_key_once(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys, marks = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
        if n > 60:
            keys[:30] = keys[30]  # alike: told apart by the fingerprint
        for levels in (40, 2):
            monkeypatch.setattr(tokenfile, "LEVELS", levels)
            minimal = tokenfile.MinimalHash.of(keys, marks)
            assert sorted(minimal.find(keys, marks).tolist()) == list(range(n))
            bucket = tokenfile.Bucket.unpack(tokenfile.Bucket.of(keys, marks, np.arange(3 * n).reshape(n, 3)).pack())
            there, entries = bucket.find(keys, marks)
            assert there.all() and (entries[:, 0] == 3 * np.arange(n)).all()
            assert not bucket.find(rng.integers(0, 1 << 63, 2000).astype(np.uint64), rng.integers(0, 1 << 63, 2000).astype(np.uint64))[0].any()
